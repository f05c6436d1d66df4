"""Mapping-rule cleaning: pipe explosion, operator signs, opening-rule removal,
sheet selection.

A rule row is ``(sheet, cell, accts, ops, items)``; ``accts``, ``ops`` and
``items`` may be ``|``-joined lists that are split in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import op_to_sign, strip_text
from tallyspark.schemas import OPENING_MARKER, SHEET_STATEMENT


def _split_or_single(c: str, is_split):
    cleaned = F.regexp_replace(F.col(c), "\n", "")
    return F.when(is_split, F.split(cleaned, r"\|")).otherwise(F.array(F.col(c)))


def _prepared(rules: DataFrame) -> DataFrame:
    is_split = F.coalesce(F.col("accts").contains("|"), F.lit(False))
    return rules.select(
        "*", is_split.alias("_split"),
        _split_or_single("accts", is_split).alias("_a"),
        _split_or_single("ops", is_split).alias("_o"),
        _split_or_single("items", is_split).alias("_i"),
        F.when(is_split, F.regexp_replace("cell", "\n", "")).otherwise(F.col("cell")).alias("_cell"))


def _valid(df: DataFrame):
    # A split row needs all four fields and lists of equal length.
    complete = (F.col("cell").isNotNull() & F.col("ops").isNotNull()
                & F.col("items").isNotNull())
    same_len = ((F.size("_a") == F.size("_o")) & (F.size("_a") == F.size("_i")))
    return ~F.col("_split") | (complete & F.coalesce(same_len, F.lit(False)))


def rule_rejects(rules: DataFrame) -> DataFrame:
    """Rule rows the source would fail on (unequal list lengths, missing
    fields in a split row), with a reason."""
    p = _prepared(rules)
    return (p.filter(~_valid(p))
            .select("sheet", "cell", "accts", "ops", "items",
                    F.lit("pipe lists of unequal length or missing field").alias("reason")))


def explode_pipe_rules(rules: DataFrame) -> DataFrame:
    """One row per rule part: ``(sheet, cell, acct_code, op, item, part_no)``.

    Splitting happens only when ``accts`` contains ``|``; newlines are removed
    in split rows only; parts are trimmed afterwards (the operator is kept raw
    so that ``' +'`` stays unknown). Invalid rows go to :func:`rule_rejects`.
    """
    p = _prepared(rules)
    p = p.filter(_valid(p))
    z = p.select("sheet", "_cell", F.posexplode(F.arrays_zip("_a", "_o", "_i")).alias("part_no", "z"))
    return z.select(
        strip_text("sheet").alias("sheet"),
        strip_text("_cell").alias("cell"),
        strip_text(F.col("z._a")).alias("acct_code"),
        F.col("z._o").alias("op"),
        strip_text(F.col("z._i")).alias("item"),
        F.col("part_no").cast("int").alias("part_no"))


def with_sign(parts: DataFrame) -> DataFrame:
    """Replace the raw operator with its sign."""
    return parts.withColumn("sign", op_to_sign("op")).drop("op")


def clean_rules(rules: DataFrame) -> DataFrame:
    """Explode and sign: ``(sheet, cell, acct_code, item, part_no, sign)``."""
    return with_sign(explode_pipe_rules(rules))


def drop_opening_rules(parts: DataFrame) -> DataFrame:
    """Remove parts whose item contains the opening-balance marker; on every
    sheet but the statement sheet also remove parts without code or item."""
    no_opening = ~F.coalesce(F.col("item").contains(OPENING_MARKER), F.lit(False))
    keep_rest = ((F.col("sheet") == SHEET_STATEMENT)
                 | (F.col("acct_code").isNotNull() & F.col("item").isNotNull()))
    return parts.filter(no_opening & keep_rest)


def select_sheets(parts: DataFrame, sheets) -> DataFrame:
    return parts.filter(F.col("sheet").isin(list(sheets)))


RULE_COLUMNS = [("cell", "单元格"), ("accts", "账户代码"), ("ops", "运算符"), ("items", "金额列")]


def read_rules(rows: DataFrame, header_row: int = 2) -> DataFrame:
    """All sheets of the mapping workbook -> one rule table with a ``sheet``
    column (A12). The header is in ``header_row``; the four required
    columns are found by header text on each sheet."""
    hdr = (rows.filter(F.col("row_no") == header_row)
           .select("file_name", "sheet", F.transform("cells", lambda x: strip_text(x)).alias("_hdr")))
    body = rows.filter(F.col("row_no") > header_row).join(hdr, ["file_name", "sheet"])
    out = [F.col("sheet")]
    for c, h in RULE_COLUMNS:
        pos = F.array_position("_hdr", F.lit(h))
        out.append(F.when(pos > 0, F.try_element_at("cells", pos.cast("int"))).alias(c))
    return body.select(*out, "row_no")
