"""Financial statements: two-panel balance sheet and income statement read from
sheet rows, cut into sections, melted to long form, and mapped to cells.

Row order is data here: ``row_no`` comes from the sheet. Section cuts use a
per-file aggregate of marker row numbers joined back, never a window over a
whole file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import not_contains, strip_text
from tallyspark.schemas import (BALANCE_AMOUNT_TYPES, INCOME_AMOUNT_TYPES, MARK_CUR_ASSETS_TOTAL,
                                MARK_CUR_LIAB_TOTAL, MARK_EQUITY_START, MARK_EQUITY_TOTAL,
                                MARK_NONCUR_ASSETS_TOTAL, MARK_NONCUR_LIAB_START, MARK_NONCUR_LIAB_TOTAL,
                                MARK_PREPARER, MARK_TOTAL, MONEY, SECTION_CUR_ASSETS, SECTION_CUR_LIAB,
                                SECTION_EQUITY, SECTION_INCOME, SECTION_NONCUR_ASSETS, SECTION_NONCUR_LIAB,
                                SECTION_TOTAL, STATEMENT_BALANCE, STATEMENT_INCOME)

BALANCE_RANGE = ("资产负债表", 4, 68)   # sheet, first row (header), last row; columns A..F
INCOME_RANGE = ("利润表", 4, 79)        # columns A..E


def _cell(i):
    return F.get(F.col("cells"), i)


def read_range_rows(rows: DataFrame, sheet: str, first_row: int, last_row: int) -> DataFrame:
    """Data rows of a fixed range whose first row is the header."""
    return rows.filter((F.col("sheet") == sheet) & (F.col("row_no") > first_row)
                       & (F.col("row_no") <= last_row))


def read_balance_panels(rows: DataFrame, rng=BALANCE_RANGE) -> DataFrame:
    """``A4:F68`` of the balance sheet: rows without an asset name, and rows
    whose asset name contains the preparer marker, are dropped (A5)."""
    r = read_range_rows(rows, *rng).select(
        "file_name", "row_no",
        _cell(0).alias("asset"), _cell(1).alias("asset_close"), _cell(2).alias("asset_open"),
        _cell(3).alias("liab"), _cell(4).alias("liab_close"), _cell(5).alias("liab_open"))
    return r.filter(F.col("asset").isNotNull() & not_contains("asset", MARK_PREPARER))


def read_income(rows: DataFrame, rng=INCOME_RANGE) -> DataFrame:
    """``A4:E79`` of the income statement; ``line_idx`` is the zero-based
    position of the row inside the range's data (A5)."""
    sheet, first, _ = rng
    # amounts are named by the header row, in whatever order a file has them
    hdr = rows.filter((F.col("sheet") == sheet) & (F.col("row_no") == first)).select(
        "file_name", F.transform(F.slice("cells", 1, 5), lambda x: strip_text(x)).alias("_hdr"))
    r = read_range_rows(rows, *rng).join(hdr, "file_name", "left")
    amounts = []
    for c, h in INCOME_AMOUNT_TYPES:
        pos = F.array_position("_hdr", F.lit(h))
        amounts.append(F.when(pos > 0, F.try_element_at("cells", pos.cast("int"))).alias(c))
    r = r.select("file_name", "row_no", (F.col("row_no") - first - 1).alias("line_idx"), _cell(0).alias("item"), *amounts)
    return r.filter(F.col("item").isNotNull() & not_contains("item", MARK_PREPARER))


def stack_panels(panels: DataFrame) -> DataFrame:
    """Side-by-side assets / liabilities -> one column set with ``panel``;
    null names become '' and names are trimmed (F5, C8). One pass: each row
    is exploded into its two panels."""
    def side(name, close, open_, tag):
        return F.struct(F.lit(tag).alias("panel"),
                        strip_text(F.coalesce(F.col(name), F.lit(""))).alias("item"),
                        F.col(close).try_cast(MONEY).alias("close"),
                        F.col(open_).try_cast(MONEY).alias("open"))
    return panels.select("file_name", "row_no", F.inline(F.array(
        side("asset", "asset_close", "asset_open", "assets"),
        side("liab", "liab_close", "liab_open", "liab"))))


def _first(panel: str, marker: str):
    return F.min(F.when((F.col("panel") == panel) & F.col("item").contains(marker), F.col("row_no")))


def marker_rows(stacked: DataFrame) -> DataFrame:
    """First row number of every section marker, per file (null if absent)."""
    return stacked.groupBy("file_name").agg(
        _first("assets", MARK_CUR_ASSETS_TOTAL).alias("m_ca"),
        _first("assets", MARK_NONCUR_ASSETS_TOTAL).alias("m_nca"),
        _first("liab", MARK_CUR_LIAB_TOTAL).alias("m_cl"),
        _first("liab", MARK_NONCUR_LIAB_START).alias("m_ncl0"),
        _first("liab", MARK_NONCUR_LIAB_TOTAL).alias("m_ncl"),
        _first("liab", MARK_EQUITY_START).alias("m_eq0"),
        _first("liab", MARK_EQUITY_TOTAL).alias("m_eq"))


def missing_markers(stacked: DataFrame) -> DataFrame:
    """Validation rows: files where a section marker is absent (the source
    raises on the first one)."""
    m = marker_rows(stacked)
    cols = ["m_ca", "m_nca", "m_cl", "m_ncl0", "m_ncl", "m_eq0", "m_eq"]
    return m.select("file_name", F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]),
                                          lambda x: x.isNotNull()).alias("missing")) \
        .filter(F.size("missing") > 0)


def section_lines(stacked: DataFrame) -> DataFrame:
    """Cut ordered lines into sections, plus a second copy of every line whose
    name contains the total marker (F6). Output: ``file_name, row_no, panel,
    item, category, line_key, close, open``."""
    j = stacked.join(marker_rows(stacked), "file_name")
    rn, a, l_ = F.col("row_no"), F.col("panel") == "assets", F.col("panel") == "liab"
    cat = (F.when(a & (rn < F.col("m_ca")), SECTION_CUR_ASSETS)
           .when(a & (rn > F.col("m_ca")) & (rn < F.col("m_nca")), SECTION_NONCUR_ASSETS)
           .when(l_ & (rn < F.col("m_cl")), SECTION_CUR_LIAB)
           .when(l_ & (rn >= F.col("m_ncl0")) & (rn < F.col("m_ncl")), SECTION_NONCUR_LIAB)
           .when(l_ & (rn >= F.col("m_eq0")) & (rn < F.col("m_eq")), SECTION_EQUITY))
    # one pass: every line yields its section and, if it is a total line, a
    # second copy in the totals section
    total = F.when(F.col("item").contains(MARK_TOTAL), F.lit(SECTION_TOTAL))
    out = (j.select("file_name", "row_no", "panel", "item", "close", "open",
                    F.explode(F.array(cat, total)).alias("category"))
           .filter(F.col("category").isNotNull()))
    return out.withColumn("line_key", F.concat_ws("_", "item", "category"))


def melt_balance_sheet(lines: DataFrame) -> DataFrame:
    """Closing/opening columns -> ``(amount_type, amount)``, nulls kept."""
    long = lines.unpivot(ids=["file_name", "row_no", "item", "category", "line_key"],
                         values=["close", "open"], variableColumnName="_c", valueColumnName="amount")
    labels = F.create_map(*[x for c, lbl in BALANCE_AMOUNT_TYPES for x in (F.lit(c), F.lit(lbl))])
    return long.withColumn("amount_type", labels[F.col("_c")]).drop("_c")


def melt_income(income: DataFrame) -> DataFrame:
    """Four amount columns -> long, nulls kept; category 损益; key is the
    zero-based range position and the trimmed name (F4, C18)."""
    i = income.select("file_name", "row_no", strip_text("item").alias("item"),
                      F.lit(SECTION_INCOME).alias("category"),
                      *[F.col(c).try_cast(MONEY).alias(c) for c, _ in INCOME_AMOUNT_TYPES],
                      "line_idx")
    i = i.withColumn("line_key", F.concat(F.col("line_idx").cast("string"), F.lit("_"), F.col("item")))
    long = i.unpivot(ids=["file_name", "row_no", "item", "category", "line_key"],
                     values=[c for c, _ in INCOME_AMOUNT_TYPES], variableColumnName="_c",
                     valueColumnName="amount")
    labels = F.create_map(*[x for c, lbl in INCOME_AMOUNT_TYPES for x in (F.lit(c), F.lit(lbl))])
    return long.withColumn("amount_type", labels[F.col("_c")]).drop("_c")


def concat_statements(balance_long: DataFrame, income_long: DataFrame) -> DataFrame:
    """Long balance sheet + long income statement with the statement name."""
    cols = ["item", "category", "amount_type", "amount", "line_key", "file_name", "row_no"]
    return (balance_long.select(*cols).withColumn("statement", F.lit(STATEMENT_BALANCE))
            .unionByName(income_long.select(*cols).withColumn("statement", F.lit(STATEMENT_INCOME))))


def long_statements(rows: DataFrame) -> DataFrame:
    """Sheet rows -> the concatenated long statements."""
    bal = melt_balance_sheet(section_lines(stack_panels(read_balance_panels(rows))))
    inc = melt_income(read_income(rows))
    return concat_statements(bal, inc)


def statement_cells(long: DataFrame, parts: DataFrame, sheet: str = "原报表",
                    files: DataFrame | None = None) -> DataFrame:
    """Rules LEFT JOIN long statements on (line key, amount type), summed per
    cell, null -> 0, no FX (E4). Same plan as the balance cells: join the
    rules, partial aggregate, fill unmatched cells per file."""
    from tallyspark.operators.cells import job_grid
    p = parts.filter(F.col("sheet") == sheet)
    matched = (long.select("file_name", F.col("line_key").alias("acct_code"),
                           F.col("amount_type").alias("item"), "amount")
               .join(p, ["acct_code", "item"])
               .groupBy("file_name", "sheet", "cell")
               .agg(F.sum(F.col("amount") * F.col("sign")).alias("_raw")))
    cells = p.select("sheet", "cell").distinct()
    files = files if files is not None else long.select("file_name").distinct()
    grid = job_grid(files, p, ["file_name"], files, [sheet]).join(cells, "sheet")
    out = grid.join(matched, ["file_name", "sheet", "cell"], "left")
    return out.select("file_name", "sheet", "cell",
                      F.coalesce(F.round("_raw", 2), F.lit(0).cast(MONEY)).cast(MONEY).alias("amount"))
