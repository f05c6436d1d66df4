"""Counterparty tables harvested from working-paper sheet rows.

Input: sheet rows ``(file_name, sheet, row_no, cells ARRAY<STRING>)`` of many
papers (one Spark task per file split; no driver-side stacking). Each output
is a positional slice of one sheet, cleaned of helper rows and renamed.
Everything is narrow (filter/project): no shuffle at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import ne_zero_keep_null, not_in
from tallyspark.schemas import (ADVANCES_HEADERS, CF2_HELPER_VALUES, CURRENCY_LABEL,
                                CUSTOMER_CODE_LABEL, FILL_LABELS, OTHER_PAYABLES_HEADERS,
                                OTHER_RECEIVABLES_HEADERS, PAYABLES_HEADERS, RECEIVABLES_HEADERS,
                                SUPPLIER_CODE_LABEL, MARK_TOTAL)


def cell(i: int) -> Column:
    """Zero-based grid column ``i`` of the row; null when the row is shorter."""
    return F.get(F.col("cells"), i)


def num(i: int) -> Column:
    return cell(i).try_cast("double")


@dataclass(frozen=True)
class Extract:
    name: str            # output table name
    sheet: str           # source sheet
    skip: int            # leading sheet rows dropped
    first: int           # first grid column
    last: int            # last grid column (inclusive)
    headers: tuple       # output names, file name first

    def keep(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Cf2Extract(Extract):
    key_col: int = 0      # nature column
    any_cols: tuple = ()  # at least one not null
    nz_col: int = 0       # != 0, null kept

    def keep(self) -> Column:
        k = self.key_col
        anyc = None
        for c in self.any_cols:
            anyc = cell(c).isNotNull() if anyc is None else (anyc | cell(c).isNotNull())
        return (not_in(cell(k), CF2_HELPER_VALUES) & cell(k).isNotNull() & anyc
                & ne_zero_keep_null(num(self.nz_col)))


@dataclass(frozen=True)
class GridExtract(Extract):
    helper_labels: tuple = ()
    cur_col: int = 0
    amount_col: int = 0

    def keep(self) -> Column:
        return (not_in(cell(0), self.helper_labels) & not_in(cell(self.cur_col), [CURRENCY_LABEL])
                & cell(self.amount_col).isNotNull() & ne_zero_keep_null(num(self.amount_col)))


_SUPPLIER_HELPERS = tuple([SUPPLIER_CODE_LABEL, MARK_TOTAL] + FILL_LABELS)
_CUSTOMER_HELPERS = tuple([CUSTOMER_CODE_LABEL, MARK_TOTAL] + FILL_LABELS)

EXTRACTS = [
    Cf2Extract("其他应收款", "CF2", 3, 11, 29, tuple(OTHER_RECEIVABLES_HEADERS),
               key_col=12, any_cols=(13, 14, 15), nz_col=16),
    Cf2Extract("其他应付款", "CF2", 3, 30, 45, tuple(OTHER_PAYABLES_HEADERS),
               key_col=31, any_cols=(32, 33, 34), nz_col=35),
    GridExtract("应付账款", "应付账款", 4, 0, 14, tuple(PAYABLES_HEADERS),
                helper_labels=_SUPPLIER_HELPERS, cur_col=6, amount_col=7),
    GridExtract("预付账款", "预付账款", 4, 0, 14, tuple(PAYABLES_HEADERS),
                helper_labels=_SUPPLIER_HELPERS, cur_col=6, amount_col=7),
    GridExtract("其他非流动资产", "其他非流动资产", 4, 0, 14, tuple(PAYABLES_HEADERS),
                helper_labels=_SUPPLIER_HELPERS, cur_col=6, amount_col=7),
    GridExtract("应收账款", "应收账款", 3, 0, 16, tuple(RECEIVABLES_HEADERS),
                helper_labels=_CUSTOMER_HELPERS, cur_col=5, amount_col=6),
    GridExtract("预收账款", "预收账款", 3, 0, 16, tuple(ADVANCES_HEADERS),
                helper_labels=_CUSTOMER_HELPERS, cur_col=5, amount_col=6),
]
EXTRACT_BY_NAME = {e.name: e for e in EXTRACTS}


def skip_rows(rows: DataFrame, n: int) -> DataFrame:
    """Drop the first ``n`` sheet rows of every file (the source drops them
    once after stacking; per file is the intent)."""
    return rows.filter(F.col("row_no") > n)


def project_positional(rows: DataFrame, first: int, last: int, prefix: str = "c") -> DataFrame:
    """Grid columns ``first..last`` as named columns."""
    return rows.select("file_name", "row_no",
                       *[cell(i).alias(f"{prefix}{i}") for i in range(first, last + 1)])


def rename_positional(rows: DataFrame, first: int, headers) -> DataFrame:
    """Assign business names by position, with an arity check."""
    headers = list(headers)
    n = len(headers) - 1
    return rows.select(F.col("file_name").alias(headers[0]), "row_no",
                       *[cell(first + i).alias(headers[1 + i]) for i in range(n)])


def extract(rows: DataFrame, spec: Extract | str) -> DataFrame:
    """One counterparty table from stacked sheet rows (H3)."""
    if isinstance(spec, str):
        spec = EXTRACT_BY_NAME[spec]
    if len(spec.headers) - 1 != spec.last - spec.first + 1:
        raise ValueError(f"{spec.name}: {len(spec.headers) - 1} names for "
                         f"{spec.last - spec.first + 1} columns")
    src = skip_rows(rows.filter(F.col("sheet") == spec.sheet), spec.skip)
    return rename_positional(src.filter(spec.keep()), spec.first, spec.headers)


def extract_all(rows: DataFrame) -> dict:
    """The seven tables as separate DataFrames (one output each)."""
    return {e.name: extract(rows, e) for e in EXTRACTS}


def extract_all_long(rows: DataFrame, specs=None) -> DataFrame:
    """All tables in one pass: ``(table, file_name, row_no, values)`` where
    ``values`` is the table's column slice in header order. Each row is
    exploded into the (fixed, short) list of tables of its sheet and kept by
    that table's own rule."""
    specs = list(specs or EXTRACTS)
    arr = F.array(*[F.struct(F.lit(e.name).alias("name"), F.lit(e.sheet).alias("sheet"),
                             F.lit(e.skip).alias("skip"), F.lit(e.first).alias("first"),
                             F.lit(e.last).alias("last")) for e in specs])
    x = (rows.filter(F.col("sheet").isin(sorted({e.sheet for e in specs})))
         .select("file_name", "sheet", "row_no", "cells", F.explode(arr).alias("_s"))
         .filter((F.col("sheet") == F.col("_s.sheet")) & (F.col("row_no") > F.col("_s.skip"))))
    keep = None
    for e in specs:
        keep = (F.when(F.col("_s.name") == e.name, e.keep()) if keep is None
                else keep.when(F.col("_s.name") == e.name, e.keep()))
    x = x.filter(F.coalesce(keep, F.lit(False)))
    values = F.transform(F.sequence(F.col("_s.first"), F.col("_s.last")), lambda i: F.get(F.col("cells"), i))
    return x.select(F.col("_s.name").alias("table"), "file_name", "row_no", values.alias("values"))
