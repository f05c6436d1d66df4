import os

from pyspark.sql import functions as F

from tallyspark.sources import files as FS
from tallyspark.sources import xlsx as XS
from tallyspark.sinks import writers as W
from xlsx_writer import write_xlsx
from conftest import rows_of


def _folder(scratch):
    os.makedirs(os.path.join(scratch, "sub"))
    write_xlsx(os.path.join(scratch, "甲公司.xlsx"),
               {"CF2": {1: ["t"], 4: [None, "a", 1.5, True]}, "其他": {1: ["skip"]}})
    write_xlsx(os.path.join(scratch, "sub", "乙公司.xlsx"), {"CF2": {2: ["x", None, None, "y"]}}, inline=True)
    with open(os.path.join(scratch, "坏.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    write_xlsx(os.path.join(scratch, "~$锁.xlsx"), {"CF2": {1: ["lock"]}})
    write_xlsx(os.path.join(scratch, "合并.xlsx"), {"CF2": {1: ["merged"]}})
    return scratch


def test_scan_round_trip_and_rejects(spark, scratch):
    d = _folder(scratch)
    rows = XS.scan_workbook_cells(spark, d, sheets=["CF2"])
    got = rows_of(rows, "file_name", "sheet", "row_no")
    assert ("甲公司", "CF2", 4) in got and ("乙公司", "CF2", 2) in got
    assert not any(g[1] == "其他" for g in got)
    r4 = [r for r in rows.collect() if r.file_name == "甲公司" and r.row_no == 4][0]
    assert r4.cells == [None, "a", "1.5", "TRUE"]
    r2 = [r for r in rows.collect() if r.file_name == "乙公司"][0]
    assert r2.cells == ["x", None, None, "y"]
    rej = rows_of(XS.scan_rejects(spark, d, sheets=["CF2"]), "file_name")
    assert ("坏",) in rej


def test_list_files_recursive_and_flat(spark, scratch):
    d = _folder(scratch)
    names = {r.name for r in FS.list_files(spark, d, recursive=True).collect()}
    assert names == {"甲公司.xlsx", "乙公司.xlsx", "坏.xlsx", "合并.xlsx"}
    flat = {r.name for r in FS.list_files(spark, d, recursive=False).collect()}
    assert "乙公司.xlsx" not in flat and "甲公司.xlsx" in flat
    papers = {r.name for r in FS.list_papers(spark, d).collect()}
    assert papers == {"甲公司.xlsx", "乙公司.xlsx", "坏.xlsx"}


def test_ledger_csv(spark, scratch):
    p = os.path.join(scratch, "ledger.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("公司代码,功能范围：文本,总账科目：短文本,凭证货币价值\nC1,销售费用,广告,\"1,234.50\"\n")
    r = FS.read_ledger_csv(spark, p).collect()[0]
    assert (r.company_code, r.func_area, r.amount_text) == ("C1", "销售费用", "1,234.50")


def test_partitioned_write_and_replace(spark, scratch):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "company string, v int")
    out = os.path.join(scratch, "split")
    W.write_per_company(df, out)
    back = spark.read.parquet(out)
    assert rows_of(back.filter(F.col("company") == "A"), "v") == [(1,), (3,)]
    t = os.path.join(scratch, "t")
    W.replace_table(df, t)
    W.replace_table(df.limit(1), t)
    assert spark.read.parquet(t).count() == 1
    m = os.path.join(scratch, "merged")
    W.export_merged(df.withColumnRenamed("company", "文件名").select("v", "文件名"), m)
    assert spark.read.parquet(m).columns[0] == "文件名"


def test_streaming_ingest(spark, scratch):
    from tallyspark.streaming.ingest import start_workbook_ingest
    land = os.path.join(scratch, "land")
    os.makedirs(land)
    write_xlsx(os.path.join(land, "a.xlsx"), {"CF2": {1: ["a"], 2: ["b"]}})
    q = start_workbook_ingest(spark, land, os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out"))
    assert got.filter(F.col("error").isNull()).count() == 2


def test_recon_log_replaces_the_companies_it_holds(spark, scratch):
    df = spark.createDataFrame([("007", "1001")], "company string, acct_code string")
    out = os.path.join(scratch, "log")
    W.write_recon_log(df, out)
    W.write_recon_log(spark.createDataFrame([("B", "1002")], df.schema), out)
    W.write_recon_log(df, out)
    assert rows_of(spark.read.parquet(out), "company", "acct_code") == [("007", "1001"), ("B", "1002")]


def test_ingest_jobs_write_tables(spark, scratch):
    from tallyspark.plans import jobs as J
    rows = spark.createDataFrame(
        [("co", "Sheet1", 1, ["t"]), ("co", "Sheet1", 2, ["c"]), ("co", "Sheet1", 3, ["h"]), ("co", "Sheet1", 4, ["h"]),
         ("co", "Sheet1", 5, ["1001", "cash", "借", "1.00"]), ("co", "Sheet1", 9, ["合计"])],
        "file_name string, sheet string, row_no int, cells array<string>")
    t = os.path.join(scratch, "tb")
    J.ingest_balances(rows, t)
    back = spark.read.parquet(t).collect()
    assert [(r.company, r.acct_code, str(r.opening)) for r in back] == [("co", "1001", "1.00")]


def test_ingest_then_flow_reads_the_table(spark, scratch):
    from tallyspark.operators import counterparty as CP
    d = os.path.join(scratch, "papers")
    os.makedirs(d)
    cf2 = {1: ["banner"], 2: ["b"], 3: ["b"]}
    row = [None] * 46
    row[11], row[12], row[13], row[16] = "客户甲", "往来", 5, 7
    cf2[4] = row
    write_xlsx(os.path.join(d, "丙公司.xlsx"), {"CF2": cf2})
    with open(os.path.join(d, "坏.xlsx"), "wb") as fh:
        fh.write(b"junk")
    t = os.path.join(scratch, "sheet_rows")
    XS.ingest_workbooks(spark, d, t, sheets=["CF2"])
    rows = XS.sheet_rows(spark, t, ["CF2"])
    out = CP.extract(rows, "其他应收款").collect()
    assert [(r["文件名"], r["名称"], r["期末余额"]) for r in out] == [("丙公司", "客户甲", "7")]
    assert [r.file_name for r in XS.sheet_rejects(spark, t).collect()] == ["坏"]


def test_used_range_of_first_sheet(spark, scratch):
    from tallyspark.operators import papers as P
    d = os.path.join(scratch, "wb")
    os.makedirs(d)
    write_xlsx(os.path.join(d, "a.xlsx"), {"Z首": {1: ["t"], 2: ["h1", "h2"], 3: ["1", "2"], 4: ["x"]},
                                           "A次": {1: ["other"], 2: ["o"]}})
    t = os.path.join(scratch, "rows")
    XS.ingest_workbooks(spark, d, t)
    rows = XS.sheet_rows(spark, t, with_index=True)
    got = rows_of(P.read_used_range(rows), "sheet", "row_no", "col_name", "value")
    assert got == [("Z首", 3, "h1", "1"), ("Z首", 3, "h2", "2"), ("Z首", 4, "h1", "x")]
    named = rows_of(P.read_used_range(rows, sheet="A次", auto=False), "sheet", "row_no")
    assert named == [("A次", 1), ("A次", 2)]


def test_flat_scan_skips_subfolders(spark, scratch):
    d = _folder(scratch)
    flat = {r.file_name for r in XS.scan_workbook_cells(spark, d, recursive=False).collect()}
    deep = {r.file_name for r in XS.scan_workbook_cells(spark, d, recursive=True).collect()}
    assert "乙公司" in deep and "乙公司" not in flat and "甲公司" in flat
