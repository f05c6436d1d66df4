"""Group workbook splits (per-company outputs) and statement placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.exprs import parse_trailing_minus
from tallyspark.schemas import LAYOUT_B_COLUMNS, MONEY


def _suffix_free(name: str) -> str:
    """'期末余额.1' -> '期末余额_2': the source strips '.1', which leaves
    duplicate names that a columnar writer refuses; the right panel gets a
    '_2' suffix instead (C21)."""
    return name[:-2] + "_2" if name.endswith(".1") else name


def split_statements(balance: DataFrame, income: DataFrame, company_col: str = "公司名称"):
    """Group statements -> per-company balance sheet and income statement:
    money to 2 dp, company column becomes the partition key, prior-YTD income
    column dropped, '.1' suffix handled (B2)."""
    money_b = ["期末余额", "年初余额", "期末余额.1", "年初余额.1"]
    b = balance.select(F.col(company_col).alias("company"),
                       *[(F.col(f"`{c}`").cast(MONEY) if c in money_b else F.col(f"`{c}`")).alias(_suffix_free(c))
                         for c in balance.columns if c != company_col])
    money_i = ["本期发生额", "本年累计发生额"]
    i = income.drop("上年同期累计发生额").select(
        F.col(company_col).alias("company"),
        *[(F.col(c).cast(MONEY) if c in money_i else F.col(c)).alias(c)
          for c in income.columns if c not in (company_col, "上年同期累计发生额")])
    return b, i


def split_balances(group_balances: DataFrame, company_col: str = "公司名称") -> DataFrame:
    """Group balance export with trailing-minus text -> numbers in the eight
    amount columns, keyed by company for a partitioned write (B4)."""
    out = [F.col(company_col).alias("company")]
    for c, h in LAYOUT_B_COLUMNS:
        v = F.col(h)
        out.append((parse_trailing_minus(v) if c.startswith(("fc_", "lc_")) else v).alias(c))
    return group_balances.select(*out)


def place_statement(balance: DataFrame, income: DataFrame, bal_cols=(2, 6), inc_col: int = 3,
                    order_col: str = "行次", n_income: int = 27, sheet: str = "原报表",
                    starts=("N8", "P8", "N84")) -> DataFrame:
    """Statement columns by position -> cells: balance column ``bal_cols[0]``
    down from N8, ``bal_cols[1]`` down from P8, the first ``n_income``
    income lines of column ``inc_col`` down from N84 (G5). Positions count
    the per-company columns (company key excluded). Line order per company
    is a window over one statement (bounded by its line count)."""
    def col_at(df, i):
        cols = [c for c in df.columns if c != "company"]
        return cols[i]

    from tallyspark.operators.papers import parse_ref

    def positioned(df, limit=None):
        w = Window.partitionBy("company").orderBy(order_col)
        d = df.withColumn("_k", F.row_number().over(w) - 1)
        return d.filter(F.col("_k") < limit) if limit is not None else d

    def cell(start, value_col):
        r, _ = parse_ref(start)
        letter = start.rstrip("0123456789")
        return F.struct(F.concat(F.lit(letter), (F.col("_k") + r).cast("string")).alias("cell"),
                        F.col(f"`{value_col}`").cast(MONEY).alias("amount"))

    # both balance columns from one numbered pass; the income column from another
    bal = positioned(balance).select(
        "company", F.lit(sheet).alias("sheet"),
        F.inline(F.array(cell(starts[0], col_at(balance, bal_cols[0])), cell(starts[1], col_at(balance, bal_cols[1])))))
    inc = positioned(income, n_income).select(
        "company", F.lit(sheet).alias("sheet"), F.inline(F.array(cell(starts[2], col_at(income, inc_col)))))
    return bal.unionByName(inc)
