from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import balances as B
from tallyspark.operators import cells as C
from tallyspark.operators import recon as R
from tallyspark.operators import rules as RU
from tallyspark.schemas import MONEY, RULES_SCHEMA
from conftest import rows_of


def _long(spark, rows):
    return spark.createDataFrame(rows, "company string, acct_code string, item string, amount string") \
        .withColumn("amount", F.col("amount").cast(MONEY)) \
        .withColumn("acct_name", F.lit("n")).withColumn("close_dir", F.lit("借"))


def test_left_join_null_sum_is_zero_and_every_cell_per_company(spark):
    long = _long(spark, [("A", "1001", "x", "10.005"), ("A", "1002", "x", "1.00"), ("B", "1001", "x", "2.50")])
    rules = spark.createDataFrame([("1", "E5", "1001|1002|1009", "+|-|+", "x|x|x"),
                                   ("1", "E6", "9999", "+", "x"),
                                   ("1", "E7", "1001", "?", "x")], RULES_SCHEMA)
    parts = RU.clean_rules(rules)
    out = {(c, cell): a for c, cell, a in rows_of(C.cell_amounts(long, parts), "company", "cell", "amount")}
    assert out[("A", "E5")] == Decimal("9.01")      # 10.01 - 1.00 (money is DECIMAL(18,2))
    assert out[("B", "E5")] == Decimal("2.50")
    assert out[("A", "E6")] == Decimal("0.00") and out[("B", "E6")] == Decimal("0.00")
    assert out[("A", "E7")] == Decimal("0.00")      # unknown operator contributes nothing
    assert len(out) == 6


def test_rate_applied_after_rounding_then_rounded_again(spark):
    long = _long(spark, [("A", "1", "x", "0.125"), ("A", "1", "x", "0.000")])
    rules = spark.createDataFrame([("1", "E1", "1", "+", "x"), ("8", "E1", "1", "+", "x"),
                                   ("原报表", "E1", "1", "+", "x")], RULES_SCHEMA)
    rates = spark.createDataFrame([("1", "7.1884"), ("8", "2.0000")], "sheet string, rate string") \
        .withColumn("rate", F.col("rate").cast("decimal(10,4)"))
    out = {s: a for s, a in rows_of(C.cell_amounts(long, RU.clean_rules(rules), rates), "sheet", "amount")}
    # 0.125 -> DECIMAL(18,2) 0.13 (half away from zero), x 7.1884 = 0.934492 -> 0.93
    assert out["1"] == Decimal("0.93")
    assert out["8"] == Decimal("0.26")
    assert out["原报表"] == Decimal("0.13")


def test_conditional_zero_both_branches(spark):
    cells = spark.createDataFrame(
        [("A", "8_费用", "E30", "5"), ("A", "8_费用", "E31", "1"), ("A", "8_费用", "E141", "7"),
         ("B", "8_费用", "E30", "5"), ("B", "8_费用", "E141", "7"), ("B", "8_费用", "E142", "3"),
         ("C", "8_费用", "E30", "5"), ("C", "8_费用", "E141", "7"),
         ("D", "1", "E30", "5")],
        "company string, sheet string, cell string, amount string").withColumn("amount", F.col("amount").cast(MONEY))
    out = {(c, s, cell): a for c, s, cell, a in rows_of(C.conditional_zero(cells), "company", "sheet", "cell", "amount")}
    assert out[("A", "8_费用", "E30")] == 0 and out[("A", "8_费用", "E141")] == 7
    assert out[("B", "8_费用", "E30")] == 5 and out[("B", "8_费用", "E141")] == 0
    assert out[("C", "8_费用", "E30")] == 5 and out[("C", "8_费用", "E141")] == 7
    assert out[("D", "1", "E30")] == 5


def test_reconcile_unmapped_or_different(spark):
    long = _long(spark, [("A", "1001", "期末余额_金额", "100.00"), ("A", "100101", "期末余额_金额", "-100.00"),
                         ("A", "2001", "期末余额_金额", "50.00"), ("A", "200101", "期末余额_金额", "40.00"),
                         ("A", "3001", "期末余额_金额", "9.00")])
    rules = spark.createDataFrame([("原报表", "E1", "100101", "+", "期末余额_金额"),
                                   ("原报表", "E2", "200101", "+", "期末余额_金额")], RULES_SCHEMA)
    out = rows_of(R.reconcile(long, RU.clean_rules(rules)), "acct_code", "diff", "account_class")
    assert out == [("2001", Decimal("10.00"), "负债"), ("3001", None, None)]


def test_unpivot_drops_nulls_melt_keeps(spark):
    wide = spark.createDataFrame([("A", "1", "1.00", None)], "company string, acct_code string, a string, b string")
    kept = B.unpivot_amounts(wide, ["a", "b"], ["company", "acct_code"], drop_nulls=False)
    dropped = B.unpivot_amounts(wide, ["a", "b"], ["company", "acct_code"], drop_nulls=True)
    assert kept.count() == 2 and dropped.count() == 1


def test_prefix_rollup_collision_counts_twice(spark):
    from tallyspark.schemas import LAYOUT_B_COLUMNS
    cols = [c for c, _ in LAYOUT_B_COLUMNS]
    vals = {"acct_code": "100101", "acct_name": "A-B", "currency": "CNY", "local_currency": "CNY"}
    row = ["A"] + [vals.get(c, "1.00") for c in cols]
    df = spark.createDataFrame([row], "company string, " + ", ".join(f"{c} string" for c in cols))
    for c in cols:
        if c.startswith(("fc_", "lc_")):
            df = df.withColumn(c, F.col(c).cast(MONEY))
    six = B.prefix_rollup(df, 6)
    assert six.agg(F.sum("lc_closing")).first()[0] == Decimal("2.00")   # the source's double count
    assert B.prefix_rollup(df, 6, skip_existing=True).count() == 1
    four = B.prefix_rollup(df, 4)
    assert sorted(r.acct_code for r in four.collect()) == ["1001", "100101"]
    assert [r.acct_name for r in four.collect() if r.acct_code == "1001"] == ["A"]


def test_reconcile_empty_when_rules_cover_all_accounts(spark):
    from tallyspark.plans import fixtures as X
    sf = "/root/testdata/sf0.001"
    bal = X.bal_a(spark, sf)
    long = B.unpivot_a(bal)
    detail = [r.acct_code for r in bal.select("acct_code").distinct().collect() if len(r.acct_code) == 6]
    rules = spark.createDataFrame([("原报表", f"R{i}", c, "+", "期末余额_金额") for i, c in enumerate(sorted(detail))],
                                  RULES_SCHEMA)
    assert R.reconcile(long, RU.clean_rules(rules)).count() == 0
    # dropping one account's rule makes exactly its level-1 account differ in every company holding it
    partial = rules.filter(F.col("accts") != sorted(detail)[0])
    off = R.reconcile(long, RU.clean_rules(partial)).select("acct_code").distinct().collect()
    assert [r.acct_code for r in off] == [sorted(detail)[0][:4]]


def test_no_reconciliation_without_statement_rules(spark):
    from tallyspark.plans import jobs as J
    from tallyspark.plans import fixtures as X
    sf = "/root/testdata/sf0.001"
    rules = X.rules(spark, sf).filter(F.col("sheet") != "原报表")
    assert J.tb_to_cells(X.bal_a(spark, sf), rules).recon.count() == 0
    assert J.tb_to_cells(X.bal_a(spark, sf), rules, sheets=["1"]).recon is None
    assert J.tb_to_cells(X.bal_a(spark, sf), X.rules(spark, sf), sheets=["1"]).recon is None
    assert J.tb_to_cells(X.bal_a(spark, sf), X.rules(spark, sf)).recon is not None
