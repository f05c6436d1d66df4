"""A company holding a third of all rows: results equal a brute-force
pandas computation, and the plan pre-aggregates before its shuffles."""

import contextlib
import io
import random
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from tallyspark.operators import cells as C
from tallyspark.operators import ledger as L
from tallyspark.operators import rules as RU
from tallyspark.schemas import MONEY, RULES_SCHEMA


def _skewed_long(spark, n=30_000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        company = "HOT" if i % 3 == 0 else f"C{rnd.randrange(200)}"
        code = f"{rnd.choice('12456')}00{rnd.randrange(1, 6)}0{rnd.randrange(1, 5)}"
        item = rnd.choice(["期末余额_金额", "期间发生额_贷方金额"])
        rows.append((company, code, item, f"{rnd.randrange(-10**6, 10**6) / 100:.2f}"))
    df = spark.createDataFrame(rows, "company string, acct_code string, item string, amount string")
    return df.withColumn("amount", F.col("amount").cast(MONEY)), pd.DataFrame(rows, columns=df.columns)


def test_cell_amounts_with_a_hot_company(spark):
    long, pdf = _skewed_long(spark)
    rules = spark.createDataFrame([("1", "E5", "100101|100102", "+|-", "期末余额_金额|期末余额_金额"),
                                   ("2", "E6", "200301", "+", "期间发生额_贷方金额"),
                                   ("2", "E7", "999999", "+", "期末余额_金额")], RULES_SCHEMA)
    got = {(r.company, r.cell): r.amount for r in C.cell_amounts(long, RU.clean_rules(rules)).collect()}
    pdf["amount"] = pdf["amount"].map(Decimal)
    rule_parts = [("E5", "100101", "期末余额_金额", 1), ("E5", "100102", "期末余额_金额", -1),
                  ("E6", "200301", "期间发生额_贷方金额", 1), ("E7", "999999", "期末余额_金额", 1)]
    expect = {}
    for company in pdf["company"].unique():
        sub = pdf[pdf["company"] == company]
        for cell in ["E5", "E6", "E7"]:
            tot = Decimal("0")
            for c, code, item, sign in rule_parts:
                if c == cell:
                    m = sub[(sub["acct_code"] == code) & (sub["item"] == item)]["amount"]
                    tot += sum(m, Decimal("0")) * sign
            expect[(company, cell)] = tot.quantize(Decimal("0.01"))
    assert got == expect


def test_hot_company_is_pre_aggregated_before_the_shuffle(spark):
    ledger = spark.range(0, 60_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("C"), (F.col("id") % 97).cast("string"))).alias("company"),
        F.lit("销售费用").alias("func_area"), (F.col("id") % 50).cast("string").alias("gl_text"),
        F.format_string("%d.50", F.col("id") % 1000).alias("amount_text"))
    summary = L.expense_summary(L.parse_ledger(ledger))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        summary.explain()
    plan = buf.getvalue()
    assert "partial_sum" in plan            # map-side combine: HOT sends one row per GL text per task
    hot = summary.filter("company = 'HOT'").agg(F.sum("amount")).first()[0]
    brute = sum(Decimal(f"{i % 1000}.50") for i in range(0, 60_000, 3))
    assert hot == brute
