"""Workbooks on disk -> ingest -> trial-balance flow through the command line."""

import os

from pyspark.sql import functions as F

from tallyspark import cli
from xlsx_writer import write_xlsx

HEAD = ["账户代码", "账户名称", "期初余额_方向", "期初余额_金额", "期初余额_借方金额", "期初余额_贷方金额",
        "期间发生额_借方金额", "期间发生额_贷方金额", "累计发生额_借方金额", "累计发生额_贷方金额",
        "期末余额_方向", "期末余额_金额", "期末余额_借方金额", "期末余额_贷方金额"]


def _balance(code_amounts):
    rows = {1: ["科目余额表"], 2: ["单位"], 3: ["期初", None, "期末"], 4: HEAD}
    r = 5
    for code, closing in code_amounts:
        rows[r] = [code, f"n{code}", "借", 0, None, None, 0, 0, 0, 0, "借", closing, closing, None]
        r += 1
    rows[r] = ["合计"]
    return {"Sheet1": rows}


def test_tb_flow_from_workbooks(spark, scratch):
    bal_dir = os.path.join(scratch, "balances")
    os.makedirs(bal_dir)
    write_xlsx(os.path.join(bal_dir, "甲公司.xlsx"), _balance([("1001", 100.5), ("100101", 60.25), ("100102", 40.25)]))
    write_xlsx(os.path.join(bal_dir, "乙公司.xlsx"), _balance([("1001", 7), ("100101", 7)]))
    map_dir = os.path.join(scratch, "mapping")
    os.makedirs(map_dir)
    write_xlsx(os.path.join(map_dir, "映射表.xlsx"), {
        "1": {1: ["表"], 2: ["行次", "单元格", "账户代码", "运算符", "金额列"],
              3: [1, "E5", "100101|100102", "+|+", "期末余额_金额|期末余额_金额"],
              4: [2, "E6", "100101", "+", "期初余额_金额"]},
        "原报表": {1: ["表"], 2: ["单元格", "账户代码", "运算符", "金额列"],
                 3: ["N8", "100101", "+", "期末余额_金额"]}})
    bal_rows, map_rows, out = (os.path.join(scratch, x) for x in ("bal_rows", "map_rows", "out"))
    cli.run(["ingest", bal_dir, bal_rows])
    cli.run(["ingest", map_dir, map_rows])
    cli.run(["tb", "--balances", bal_rows, "--rules", map_rows, "--out", out,
             "--closing-rate", "2", "--average-rate", "1", "--log", os.path.join(scratch, "log")])
    cells = spark.read.parquet(os.path.join(out, "cells"))
    got = {(r.company, r.sheet, r.cell): float(r.amount) for r in cells.collect()}
    assert got[("甲公司", "1", "E5")] == 201.0      # (60.25 + 40.25) x closing rate 2
    assert got[("乙公司", "1", "E5")] == 14.0
    assert ("甲公司", "1", "E6") not in got         # opening rules dropped by default
    assert got[("甲公司", "原报表", "N8")] == 60.25  # statement sheet: no FX
    log = spark.read.parquet(os.path.join(scratch, "log"))
    # level-1 account 1001: 100.50 in the ledger vs 60.25 mapped -> reported
    assert log.filter((F.col("company") == "甲公司") & (F.col("acct_code") == "1001")).first().diff == 40.25


def test_other_flows_from_workbooks(spark, scratch):
    papers = os.path.join(scratch, "papers")
    os.makedirs(papers)
    cf2_row = [None] * 46
    cf2_row[11], cf2_row[12], cf2_row[13], cf2_row[16] = "客户甲", "往来", 5, 7
    fee = {1: ["类别", "科目编码", "底稿科目", "附注分类", "本期未审", "重分类调整", "审计调整"],
           2: ["销售费用", "6601", "广告费", "销售费用", 12.5, None, 0]}
    yoy = {93: ["项目", "本期发生额", "上期发生额"], 94: ["广告费", 12.5, 10]}
    write_xlsx(os.path.join(papers, "甲公司2024.xlsx"),
               {"CF2": {1: ["b"], 2: ["b"], 3: ["b"], 4: cf2_row}, "8_费用": fee, "8": yoy})
    reports = os.path.join(scratch, "reports")
    os.makedirs(reports)
    bs = {4: ["资产", "期末", "期初", "负债", "期末", "期初"],
          5: ["货币资金", 10, 9, "短期借款", 3, 2], 6: ["流动资产合计", 10, 9, "流动负债合计", 3, 2],
          7: ["固定资产", 4, 4, "非流动负债:", None, None], 8: ["非流动资产合计", 4, 4, "长期借款", 1, 1],
          9: ["x", None, None, "非流动负债合计", 1, 1], 10: ["y", None, None, "所有者权益（或股东权益）:", None, None],
          11: ["z", None, None, "所有者权益（或股东权益）合计", 0, 0]}
    inc = {4: ["项目名称", "本期金额", "本年金额", "上年金额", "上年同期金额"], 5: ["营业收入", 8, 9, 7, 6]}
    write_xlsx(os.path.join(reports, "甲公司报表.xlsx"), {"资产负债表": bs, "利润表": inc})
    maps = os.path.join(scratch, "maps")
    os.makedirs(maps)
    write_xlsx(os.path.join(maps, "m.xlsx"), {"原报表": {
        1: ["t"], 2: ["单元格", "账户代码", "运算符", "金额列"],
        3: ["N8", "货币资金_流动资产|0_营业收入", "+|+", "期末余额|本年金额"]}})
    pr, rr, mr = (os.path.join(scratch, x) for x in ("pr", "rr", "mr"))
    cli.run(["ingest", papers, pr])
    cli.run(["ingest", reports, rr])
    cli.run(["ingest", maps, mr])
    out = os.path.join(scratch, "out")
    cli.run(["statements", "--reports", rr, "--rules", mr, "--out", out + "/st"])
    cells = spark.read.parquet(out + "/st/cells").collect()
    assert [(r.file_name, r.cell, float(r.amount)) for r in cells] == [("甲公司报表", "N8", 19.0)]
    cli.run(["counterparty", "--papers", pr, "--out", out + "/cp"])
    oar = spark.read.parquet(out + "/cp/其他应收款").collect()
    assert [(r["文件名"], r["名称"]) for r in oar] == [("甲公司2024", "客户甲")]
    cli.run(["expense", "--papers", pr, "--out", out + "/ex"])
    aud = spark.read.parquet(out + "/ex/audited").collect()
    assert [(r["公司"], r["底稿科目"], r["本期未审"]) for r in aud] == [("甲公司2024", "广告费", "12.5")]
    cli.run(["range", "--papers", pr, "--sheet", "8", "--start", "A93", "--end", "C123", "--out", out + "/rg"])
    rg = spark.read.parquet(out + "/rg").collect()
    assert [(r["文件名"], r["项目"], r["上期发生额"]) for r in rg] == [("甲公司2024", "广告费", "10")]


def test_group_split_and_ledger_flows(spark, scratch):
    grp = os.path.join(scratch, "group")
    os.makedirs(grp)
    bs = {1: ["公司名称", "项目", "行次", "期末余额", "年初余额", "项目", "行次", "期末余额", "年初余额"],
          2: ["甲", "货币资金", 1, 10.005, 9, "短期借款", 1, 3, 2], 3: ["乙", "货币资金", 1, 5, 4, "短期借款", 1, 1, 1]}
    inc = {1: ["公司名称", "项目", "行次", "本期发生额", "本年累计发生额", "上年同期累计发生额"],
           2: ["甲", "营业收入", 1, 8, 9, 7]}
    fbl = {1: ["公司代码", "功能范围：文本", "总账科目：短文本", "凭证货币价值"],
           2: ["C1", "销售费用", "广告费", "1,000.50"], 3: ["C1", "销售费用", "广告费", "0.50-"],
           4: ["C2", "管理费用", "办公费", "20.00"]}
    tb = {1: ["公司名称", "科目代码", "科目名称", "货币代码", "外币期初", "外币借方", "外币贷方", "外币期末",
              "本位货币代码", "本位币货币期初", "本位货币借方", "本位货币贷方", "本位货币期末"],
          2: ["甲", "100101", "现金-库存", "CNY", "0", "0", "0", "0", "CNY", "1,234.50-", "10", "5", "1,229.50-"]}
    write_xlsx(os.path.join(grp, "多公司报表.xlsx"), {"资产负债表": bs, "利润表": inc, "FBL3H费用": fbl, "科目余额表": tb})
    sc = os.path.join(scratch, "scope")
    os.makedirs(sc)
    write_xlsx(os.path.join(sc, "试算范围.xlsx"), {"范围": {
        1: ["24年试算序号", "公司名称", "报表名称", "SAP代码", "是否外币"],
        2: [1, "甲", "甲报表", "C1", "是"], 3: [2, "乙", "乙报表", "C2", None], 4: [3, "丙", "丙报表", "C3", "否"]}})
    gr, sr, out = (os.path.join(scratch, x) for x in ("gr", "sr", "out"))
    cli.run(["ingest", grp, gr])
    cli.run(["ingest", sc, sr])
    cli.run(["split-group", "--group", gr, "--scope", sr, "--out", out])
    b = spark.read.parquet(out + "/statements/balance_sheet").filter("company = '甲'").first()
    assert (float(b["期末余额"]), float(b["期末余额_2"])) == (10.01, 3.0)   # 2 dp, right panel kept as _2
    led = spark.read.parquet(out + "/ledger")
    assert led.filter("report_name = '丙报表'").count() == 1 and led.filter("report_name = '丙报表'").first().gl_text is None
    assert led.filter("report_name = '甲报表'").count() == 2
    bal = spark.read.parquet(out + "/balances").first()
    assert float(bal.lc_opening) == -1234.5
    cli.run(["ledger", "--ledger", gr, "--scope", sr, "--out", out + "/led", "--average-rate", "7"])
    cells = {(r.paper, r.cell): r for r in spark.read.parquet(out + "/led/cells").collect()}
    assert float(cells[("1-甲2024.xlsx", "E2")].amount) == 7000.0     # (1000.50 - 0.50) x 7, FX entity
    assert float(cells[("2-乙2024.xlsx", "E168")].amount) == 20.0     # not FX; admin block starts at 168


def test_tb_batch_with_relation_and_scope(spark, scratch):
    bal_dir = os.path.join(scratch, "balances")
    os.makedirs(bal_dir)
    write_xlsx(os.path.join(bal_dir, "甲.xlsx"), _balance([("100101", 10)]))
    write_xlsx(os.path.join(bal_dir, "乙.xlsx"), _balance([("100101", 10)]))
    cfg = os.path.join(scratch, "cfg")
    os.makedirs(cfg)
    write_xlsx(os.path.join(cfg, "映射表.xlsx"), {"1": {1: ["t"], 2: ["单元格", "账户代码", "运算符", "金额列"],
                                                    3: ["E5", "100101", "+", "期末余额_金额"]}})
    write_xlsx(os.path.join(cfg, "关系.xlsx"), {"匹配结果": {1: ["科目余额表路径", "试算底稿路径"],
                                                         2: ["D:\\\\tb\\\\甲.xlsx", "1-甲2024.xlsx"],
                                                         3: ["D:\\\\tb\\\\乙.xlsx", "2-乙2024.xlsx"]}})
    write_xlsx(os.path.join(cfg, "范围.xlsx"), {"s": {1: ["24年试算序号", "公司名称", "报表名称", "SAP代码", "是否外币"],
                                                   2: [1, "甲公司", "甲", "C1", "是"], 3: [2, "乙公司", "乙", "C2", "否"]}})
    br, mr, rr, sr, out = (os.path.join(scratch, x) for x in ("br", "mr", "rr", "sr", "out"))
    cli.run(["ingest", bal_dir, br])
    cli.run(["ingest", os.path.join(cfg, "映射表.xlsx"), mr])
    cli.run(["ingest", os.path.join(cfg, "关系.xlsx"), rr])
    cli.run(["ingest", os.path.join(cfg, "范围.xlsx"), sr])
    cli.run(["tb", "--balances", br, "--rules", mr, "--out", out, "--closing-rate", "7", "--average-rate", "6",
             "--relation", rr, "--scope", sr])
    got = {(r.paper, r.cell): float(r.amount) for r in spark.read.parquet(out + "/cells").collect()}
    assert got == {("1-甲2024.xlsx", "E5"): 70.0, ("2-乙2024.xlsx", "E5"): 10.0}


def test_tables_command(spark, scratch):
    bal_dir = os.path.join(scratch, "b")
    os.makedirs(bal_dir)
    write_xlsx(os.path.join(bal_dir, "甲.xlsx"), _balance([("1001", 3)]))
    write_xlsx(os.path.join(bal_dir, "财务分析报表.xlsx"), _balance([("1001", 4)]))
    rows, out = os.path.join(scratch, "rows"), os.path.join(scratch, "out")
    cli.run(["ingest", bal_dir, rows])
    cli.run(["tables", "--kind", "balances", "--rows", rows, "--out", out, "--exclude", "财务分析报表"])
    got = [(r.company, float(r.closing)) for r in spark.read.parquet(out + "/balances").collect()]
    assert got == [("甲", 3.0)]


def test_amounts_are_written_into_the_papers(spark, scratch):
    """Relation, papers and template: the commands end in the papers' cells."""
    dirs = {k: os.path.join(scratch, k) for k in ("bal", "cfg", "papers", "template", "out")}
    for k in ("bal", "cfg", "papers", "template"):
        os.makedirs(dirs[k])
    write_xlsx(os.path.join(dirs["bal"], "甲公司.xlsx"), _balance([("1001", 100.5), ("100101", 60.25)]))
    write_xlsx(os.path.join(dirs["bal"], "无底稿.xlsx"), _balance([("1001", 1), ("100101", 1)]))
    write_xlsx(os.path.join(dirs["cfg"], "映射表.xlsx"), {
        "1": {1: ["表"], 2: ["单元格", "账户代码", "运算符", "金额列"], 3: ["E5", "100101", "+", "期末余额_金额"]}})
    write_xlsx(os.path.join(dirs["cfg"], "关系.xlsx"), {
        "匹配结果": {1: ["科目余额表路径", "试算底稿路径"], 2: ["D:\\x\\甲公司.xlsx", "D:\\y\\1.00 甲公司2024.xlsx"]}})
    fee = {1: [None, "科目编码", "底稿科目", "附注分类", "本期未审", "重分类调整", "审计调整"], 2: [None, "6601", "广告费", "销售费用", 12.5, None, 0]}
    write_xlsx(os.path.join(dirs["papers"], "1.00 甲公司2024.xlsx"), {"1": {5: ["x", None, None, None, "old"], 6: ["kept"]}, "8_费用": fee})
    write_xlsx(os.path.join(dirs["template"], "模板.xlsx"), {"审定表": {1: ["标题"], 10: ["样式"]}, "同期比较": {1: ["标题"]}})
    rows = {}
    for name, folder in (("br", dirs["bal"]), ("mr", os.path.join(dirs["cfg"], "映射表.xlsx")), ("rr", os.path.join(dirs["cfg"], "关系.xlsx")),
                         ("pr", dirs["papers"]), ("tr", dirs["template"])):
        rows[name] = os.path.join(scratch, name)
        cli.run(["ingest", folder, rows[name]])
    cli.run(["tb", "--balances", rows["br"], "--rules", rows["mr"], "--out", dirs["out"], "--relation", rows["rr"], "--papers", rows["pr"]])
    got = {(r.sheet, r.row_no, r.col_no): r.value for r in spark.read.parquet(dirs["out"] + "/papers").filter("file_name = '1.00 甲公司2024'").collect()}
    assert got[("1", 5, 4)] == "60.25" and got[("1", 5, 0)] == "x" and got[("1", 6, 0)] == "kept"
    assert {r.company for r in spark.read.parquet(dirs["out"] + "/cells_without_paper").collect()} == {"无底稿"}
    cli.run(["expense", "--papers", rows["pr"], "--out", dirs["out"] + "/ex", "--template", rows["tr"]])
    pasted = {(r.row_no, r.col_no): r.value for r in spark.read.parquet(dirs["out"] + "/ex/papers").filter("sheet = '审定表_销售费用'").collect()}
    assert pasted[(9, 2)] == "广告费" and pasted[(9, 4)] == "12.5" and pasted[(11, 0)] == "样式" and pasted[(1, 0)] == "销售费用审定表"


def _ingested(scratch, name, books):
    folder, table = os.path.join(scratch, name), os.path.join(scratch, name + "_rows")
    os.makedirs(folder)
    for file, sheets in books.items():
        write_xlsx(os.path.join(folder, file + ".xlsx"), sheets)
    cli.run(["ingest", folder, table])
    return table


SCOPE = {1: ["24年试算序号", "公司名称", "报表名称", "SAP代码", "是否外币"], 2: [1, "甲", "甲报表", "C1", "是"], 3: [2, "乙", "乙报表", "C2", None]}


def test_dynamic_ledger_placement(spark, scratch):
    ledger = {1: ["公司代码", "功能范围：文本", "总账科目：短文本", "凭证货币价值"], 2: ["C1", "销售费用", "广告费", "1,000.50"],
              3: ["C1", "销售费用", "差旅费", "7.00"], 4: ["C2", "管理费用", "办公费", "20.00"]}
    labels = ["销售费用"] * 3 + ["管理费用"] * 4 + ["研发费用"] * 3
    slots = {"8_费用": {r: [a] for r, a in enumerate(labels, 1)}}
    lr = _ingested(scratch, "ledger", {"台账": {"FBL3H费用": ledger}})
    sr = _ingested(scratch, "scope", {"范围": {"范围": SCOPE}})
    tr = _ingested(scratch, "templates", {"甲报表": slots, "乙报表": slots})
    out = os.path.join(scratch, "out")
    cli.run(["ledger", "--ledger", lr, "--scope", sr, "--template", tr, "--out", out])
    got = {(r.company, r.cell): r for r in spark.read.parquet(out + "/cells").collect()}
    # 甲: one slot and two lines, so one row is added; both start at row 2, by text
    assert [got["甲报表", c].text for c in ("C2", "C3")] == ["差旅费", "广告费"] or [got["甲报表", c].text for c in ("C2", "C3")] == ["广告费", "差旅费"]
    assert float(got["乙报表", "E9"].amount) == 20.0  # 2 + 1 slot + 6


def test_group_cells_and_overlay(spark, scratch):
    bs = {1: ["公司名称", "项目", "行次", "期末余额", "年初余额", "项目", "行次", "期末余额", "年初余额"],
          2: ["甲报表", "货币资金", 1, 10.5, 9, "短期借款", 1, 3, 2], 3: ["乙报表", "货币资金", 1, 5, 4, "短期借款", 1, 1, 1]}
    inc = {1: ["公司名称", "项目", "行次", "本期发生额", "本年累计发生额", "上年同期累计发生额"], 2: ["甲报表", "营业收入", 1, 8, 9, 7]}
    gr = _ingested(scratch, "group", {"报表": {"资产负债表": bs, "利润表": inc}})
    sr = _ingested(scratch, "scope", {"范围": {"范围": SCOPE}})
    out = os.path.join(scratch, "out")
    cli.run(["group-cells", "--group", gr, "--scope", sr, "--out", out])
    got = {(r.paper, r.sheet, r.cell): float(r.amount) for r in spark.read.parquet(out + "/cells").collect()}
    assert got["1-甲2024.xlsx", "原报表USD", "N8"] == 10.5 and got["2-乙2024.xlsx", "原报表", "N8"] == 5.0

    papers = _ingested(scratch, "papers", {"p1": {"8": {1: ["x", "old"], 2: ["y", "gone"]}}, "p2": {"8": {9: ["z"]}}})
    template = _ingested(scratch, "template", {"t": {"8": {1: [None, "标签"], 2: ["no"]}}})
    cli.run(["overlay", "--papers", papers, "--template", template, "--template-file", "t", "--sheet", "8", "--ranges", "B1:B2", "--out", out])
    cells = {(r.file_name, r.row_no, r.col_no): r.value for r in spark.read.parquet(out + "/papers").collect()}
    assert cells == {("p1", 1, 0): "x", ("p1", 1, 1): "'标签", ("p1", 2, 0): "y", ("p1", 2, 1): None,
                     ("p2", 1, 1): "'标签", ("p2", 2, 1): None, ("p2", 9, 0): "z"}
