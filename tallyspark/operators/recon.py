"""Reconciliation of mapped statement totals against the ledger balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import account_class
from tallyspark.schemas import CLOSING_ITEM, MONEY, SHEET_STATEMENT


def join_matched_only(long: DataFrame, parts: DataFrame, keys=("company",)) -> DataFrame:
    """Left join then ``amount IS NOT NULL`` is an inner join (D3)."""
    keys = list(keys)
    return (long.select(*keys, "acct_code", "item", "amount")
            .join(parts, ["acct_code", "item"], "inner")
            .filter(F.col("amount").isNotNull()))


def mapped_by_l1(long: DataFrame, parts: DataFrame, keys=("company",),
                 sheet: str = SHEET_STATEMENT) -> DataFrame:
    """Signed mapped total per 4-character code, with the account class."""
    keys = list(keys)
    p = parts.filter(F.col("sheet") == sheet)
    m = join_matched_only(long, p, keys)
    agg = (m.groupBy(*keys, F.substring("acct_code", 1, 4).alias("acct_code"))
           .agg(F.coalesce(F.round(F.sum(F.col("amount") * F.col("sign")), 2),
                           F.lit(0).cast(MONEY)).cast(MONEY).alias("amount")))
    return agg.withColumn("account_class", account_class("acct_code"))


def reconcile(long: DataFrame, parts: DataFrame, keys=("company",),
              sheet: str = SHEET_STATEMENT) -> DataFrame:
    """Level-1 accounts (4-character code, closing amount) that no statement
    rule maps, or whose absolute amount differs from the mapped one (D4)."""
    keys = list(keys)
    mapped = mapped_by_l1(long, parts, keys, sheet).select(
        *keys, "acct_code", F.col("amount").alias("_mapped"))
    a = long.filter((F.col("item") == CLOSING_ITEM) & (F.length("acct_code") == 4))
    j = a.join(mapped, keys + ["acct_code"], "left")
    diff = F.abs(F.col("amount")) - F.abs(F.col("_mapped"))
    return (j.filter(F.col("_mapped").isNull() | (diff != 0))
            .select(*keys, "acct_code", "acct_name", "close_dir",
                    F.col("amount").alias("closing"), diff.cast(MONEY).alias("diff"),
                    account_class("acct_code").alias("account_class")))
