"""Ordinary workbooks that the fixtures do not hold."""

import os
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from xlsx_writer import write_xlsx

from tallyspark.functions import exprs as X
from tallyspark.operators import balances as B
from tallyspark.operators import ledger as L
from tallyspark.operators import papers as P
from tallyspark.operators import rules as RU
from tallyspark.operators import statements as ST
from tallyspark.plans import jobs as J
from tallyspark.schemas import RULES_SCHEMA
from tallyspark.sinks import writers as W
from tallyspark.sources import xlsx as S

ROWS = "file_name string, sheet string, row_no int, cells array<string>"
SF = "/root/testdata/sf0.001"


def test_every_white_space_is_stripped(spark):
    df = spark.createDataFrame([("　货币资金　",), (" a b\t\n",), ("\x1cx",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(X.strip_text("s")).collect()] == ["货币资金", "a b", "x", None, ""]


def test_indented_items_meet_their_rule(spark):
    rows = [("f", "利润表", 4, ["项目名称", "本期金额", "本年金额", "上年金额", "上年同期金额"]), ("f", "利润表", 5, ["　　收入", "1", "2", "3", "4"])]
    keys = {r.line_key for r in ST.melt_income(ST.read_income(spark.createDataFrame(rows, ROWS))).collect()}
    assert keys == {"0_收入"}


def test_income_columns_are_named_by_their_header(spark):
    rows = [("f", "利润表", 4, ["项目名称", "本年金额", "　本期金额", "上年同期金额"]), ("f", "利润表", 5, ["收入", "2", "1", "4"])]
    r = ST.read_income(spark.createDataFrame(rows, ROWS)).first()
    assert (r.cur, r.ytd, r.prior, r.prior_ytd) == ("1", "2", None, "4")


def test_a_file_whose_sections_cannot_be_cut_has_no_cells(spark):
    rows = spark.createDataFrame([("bad", "资产负债表", 4, ["资产"]), ("bad", "资产负债表", 5, ["货币资金", "1", "2", "x", "3", "4"])], ROWS)
    rules = spark.createDataFrame([("原报表", "N8", "货币资金_流动资产", "+", "期末余额")], RULES_SCHEMA)
    got = J.statements_to_cells(rows, rules)
    assert got.cells.count() == 0 and rows_of(got.problems, "file_name") == [("bad",)]


def test_the_first_account_survives_a_blank_first_row(spark):
    rows = [("co", "s", n, [t]) for n, t in ((2, "title"), (3, "x"), (4, "header"))] + [("co", "s", 5, ["1001", "cash"]), ("co", "s", 6, ["1002", "bank"]), ("co", "s", 7, ["合计"])]
    assert rows_of(B.read_balance_a(spark.createDataFrame(rows, ROWS)), "acct_code") == [("1001",), ("1002",)]


def test_headers_keep_their_order(spark):
    rows = spark.createDataFrame([("g", "科目余额表", 1, ["公司名称", "科目代码", "外币借方", "科目名称"]), ("g", "科目余额表", 2, ["A", "1001", "5", "cash"])], ROWS)
    assert P.read_sheet_table(rows, "科目余额表").columns == ["file_name", "row_no", "公司名称", "科目代码", "外币借方", "科目名称"]


def test_a_range_keeps_all_its_columns(spark):
    rows = spark.createDataFrame([("f", "s", 1, ["金额", "名称", None, "金额"]), ("f", "s", 2, ["1", "a", "b", "2"])], ROWS)
    out = P.read_range(rows, "s", "A1", "D2").drop("row_no")
    assert out.columns == ["文件名", "金额", "名称", "Unnamed: 2", "金额.1"]
    assert tuple(out.first()) == ("f", "1", "a", "b", "2")


def test_thousands_of_header_texts(spark):
    hdr = [f"h{i}" for i in range(2000)]
    rows = spark.createDataFrame([("f", "s", 1, hdr), ("f", "s", 2, [str(i) for i in range(2000)])], ROWS)
    assert P.read_sheet_table(rows, "s").columns[2:] == hdr


def test_files_of_one_name_stay_apart(spark, scratch):
    for folder, code in (("a", "1001"), ("b", "2001")):
        os.makedirs(os.path.join(scratch, folder))
        write_xlsx(os.path.join(scratch, folder, "X.xlsx"), {"01": {1: ["t"], 2: ["t"], 3: ["t"], 4: ["h"], 5: [code], 6: ["合计"]}})
    write_xlsx(os.path.join(scratch, "only.xlsx"), {"8": {1: ["t"], 4: ["h"], 5: ["1"], 6: ["2"]}})
    target = os.path.join(scratch, "rows")
    S.ingest_workbooks(spark, scratch, target)
    rows = S.sheet_rows(spark, target, with_path=True)
    got = B.read_balance_a(rows, record_path=True)
    assert rows_of(got, "acct_code") == [("1",), ("1001",), ("2001",)]
    assert all(r.file_path.endswith(".xlsx") for r in got.collect())
    names = {r.file_name for r in rows.select("file_name").distinct().collect()}
    assert "only" in names and len(names) == 3
    assert {r.sheet for r in S.sheet_rows(spark, target, ["01", "8"]).collect()} == {"01", "8"}  # sheet names stay text


def test_company_codes_stay_text(spark, scratch):
    out = os.path.join(scratch, "out")
    W.write_per_company(spark.createDataFrame([("007", 1), ("0123", 2)], "company string, v int"), out)
    assert rows_of(spark.read.parquet(out), "company", "v") == [("007", 1), ("0123", 2)]


def test_a_hot_company_is_written_whole(spark, scratch):
    out = os.path.join(scratch, "hot")
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), F.col("id") % 40)).alias("company"), "id")
    W.write_per_company(df, out, max_records_per_file=500)
    back = spark.read.parquet(out)
    assert back.count() == 20_000 and back.filter("company = 'HOT'").count() == 6667
    assert len([f for f in os.listdir(os.path.join(out, "company_part=HOT")) if f.endswith(".parquet")]) >= 13


def test_a_bad_amount_is_rejected_not_fatal(spark):
    df = spark.createDataFrame([("A", "销售费用", "x", "abc"), ("A", "销售费用", "x", "1.00-"), ("A", "销售费用", "x", None)], "company string, func_area string, gl_text string, amount_text string")
    assert rows_of(L.ledger_rejects(df), "amount_text") == [("abc",)]
    assert rows_of(L.expense_summary(L.parse_ledger(df)), "amount") == [(Decimal("-1.00"),)]


def test_rejects_try_the_number_once(spark):
    texts = [None, "", " ", "\u3000\n", "1,234.50-", "-1", "--2", ",", "-", "1 2", "12x", " 7 ", "1e3", "9" * 17]
    df = spark.createDataFrame([(t,) for t in texts], "amount_text string")
    assert {r.amount_text for r in L.ledger_rejects(df).collect()} == {",", "-", "1 2", "12x", "9" * 17}
    assert [r[0] for r in L.parse_ledger(df).select(F.col("amount").cast("string")).collect()][4:7] == ["-1234.50", "-1.00", "-2.00"]
    plan = L.ledger_rejects(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_dynamic_placement_loses_no_company(spark):
    rows = [(c, "8_费用", r, [a]) for c in ("both", "sheet only") for r, a in enumerate(["销售费用"] * 3 + ["管理费用"] * 3 + ["研发费用"] * 3, 1)]
    template = spark.createDataFrame(rows, ROWS)
    summary = spark.createDataFrame([("both", "销售费用", f"t{i}", Decimal("1.00")) for i in range(4)] + [("lines only", "销售费用", "t", Decimal("2.00"))],
                                    "company string, func_area string, gl_text string, amount decimal(18,2)")
    slots = L.slot_counts(template)
    assert rows_of(L.placement_rejects(summary, slots), "company", "lines") == [("lines only", 1)]
    cells = P.to_cells(template).select(F.col("file_name").alias("company"), F.col("row_no").cast("long").alias("row_no"), "col_no", "value")
    paper = L.dynamic_paper(cells, summary, slots)
    kept = rows_of(paper.filter("company = 'sheet only'"), "row_no", "col_no", "value")
    assert kept == rows_of(cells.filter("company = 'sheet only'"), "row_no", "col_no", "value")
    assert paper.filter("company = 'both' and value like 't%'").count() == 4


@pytest.mark.parametrize("key", ["tb_to_cells", "tb_to_cells_b", "batch_tb_to_cells", "load_base", "reconcile", "split_ledger", "pair_files", "statements_to_cells"])
def test_no_job_runs_while_a_query_is_built(spark, key):
    from tallyspark.plans import queries  # noqa: F401
    from tallyspark.plans.catalog import QUERIES
    sc = spark.sparkContext
    QUERIES[key](spark, SF)  # the tables' footers are read here
    sc.setJobGroup(f"build-{key}", key)
    QUERIES[key](spark, SF)
    jobs = list(sc.statusTracker().getJobIdsForGroup(f"build-{key}"))
    sc.setJobGroup("after", "after")
    assert jobs == [] and sc._jsc.getPersistentRDDs().size() == 0


def test_rules_without_a_list_of_sheets_reach_every_company(spark):
    long = spark.createDataFrame([("A", "1001", "x", Decimal("1.00")), ("B", "9", "x", Decimal("5.00"))], "company string, acct_code string, item string, amount decimal(18,2)")
    from tallyspark.operators import cells as C
    parts = RU.clean_rules(spark.createDataFrame([("1", "E1", "1001", "+", "x"), ("2", "E2", "1001", "-", "x")], RULES_SCHEMA))
    assert rows_of(C.cell_amounts(long, parts), "company", "cell", "amount") == [
        ("A", "E1", Decimal("1.00")), ("A", "E2", Decimal("-1.00")), ("B", "E1", Decimal("0.00")), ("B", "E2", Decimal("0.00"))]
    assert C.cell_amounts(long, parts.limit(0)).count() == 0
