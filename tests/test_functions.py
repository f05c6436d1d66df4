from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import exprs as X


def test_trailing_minus_and_thousands(spark):
    df = spark.createDataFrame([("1,234.50-",), ("12.00",), ("1-2",)], "s string")
    got = [r[0] for r in df.select(X.parse_trailing_minus("s")).collect()]
    assert got == [Decimal("-1234.50"), Decimal("12.00"), Decimal("-12.00")]
    assert [r[0] for r in df.select(X.parse_thousands("s")).collect()] == [None, Decimal("12.00"), None]
    assert spark.createDataFrame([("abc",)], "s string").select(X.parse_trailing_minus("s")).first()[0] is None


def test_null_safe_predicates(spark):
    df = spark.createDataFrame([("a", 0.0), (None, None), ("b", 1.0)], "k string, v double")
    assert df.filter(X.not_in("k", ["a"])).count() == 2          # keeps the null row
    assert df.filter(X.ne_zero_keep_null("v")).count() == 2      # keeps the null row


def test_cell_refs_round_trip(spark):
    df = spark.range(0, 800).select(F.col("id").cast("int").alias("c"))
    back = df.select("c", X.col_letters_to_no(X.col_no_to_letters("c")).alias("b")).filter("b <> c")
    assert back.count() == 0
    one = spark.createDataFrame([("AB12",)], "r string").select(X.cell_ref_col("r"), X.cell_ref_row("r")).first()
    assert tuple(one) == (27, 12)


def test_account_class(spark):
    df = spark.createDataFrame([("1001",), ("3001",), ("6601",)], "c string")
    assert [r[0] for r in df.select(X.account_class("c")).collect()] == ["资产", None, "损益"]


def test_cluster_conf_scales_with_input():
    from tallyspark.session import cluster_conf
    big = cluster_conf(100 * 1024 ** 4)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    assert int(cluster_conf(10 ** 6)["spark.sql.shuffle.partitions"]) == 200
