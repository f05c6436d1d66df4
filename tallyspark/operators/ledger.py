"""Expense ledger: parse, summarise by function area and GL text, translate,
and place the lines into working-paper cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.functions.exprs import magnitude, parse_trailing_minus, strip_text
from tallyspark.schemas import (EXPENSE_AREAS, EXPENSE_FIXED_STARTS, FX_YES, MONEY, RATE,
                                SHEET_EXPENSE)


def parse_ledger(ledger: DataFrame, text_col: str = "amount_text") -> DataFrame:
    """Amount text ('1,234.50', '1,234.50-') -> DECIMAL(18,2) ``amount``."""
    return ledger.withColumn("amount", parse_trailing_minus(text_col))


def ledger_rejects(ledger: DataFrame, text_col: str = "amount_text") -> DataFrame:
    """Ledger lines whose amount text is no number; they count as null. The number is
    tried first: few lines have none, and only these are searched for white space."""
    bad = magnitude(text_col).isNull() & (strip_text(text_col) != "")
    return ledger.filter(bad).withColumn("reason", F.lit("amount is no number"))


def semi_categories(ledger: DataFrame, areas=EXPENSE_AREAS) -> DataFrame:
    """Keep lines of the listed function areas."""
    return ledger.filter(F.col("func_area").isin(list(areas)))


def expense_summary(ledger: DataFrame, keys=("company",), areas=EXPENSE_AREAS) -> DataFrame:
    """``round(sum(amount), 2)`` by company, function area and GL text for the
    three expense areas (E5). Partial aggregation happens map-side, so a
    company holding a third of all lines still spreads over many tasks."""
    keys = list(keys)
    return (semi_categories(ledger, areas)
            .groupBy(*keys, "func_area", "gl_text")
            .agg(F.round(F.sum("amount"), 2).cast(MONEY).alias("amount")))


def expense_fx(summary: DataFrame, scope: DataFrame | None, average_rate,
               key: str = "company") -> DataFrame:
    """Summary x average rate for foreign-currency entities, 1 otherwise; not
    re-rounded (G2). ``scope`` carries ``(key, fx_flag)``."""
    rate = F.lit(str(average_rate)).cast(RATE)
    if scope is None:
        return summary.withColumn("amount", F.col("amount") * rate)
    flags = scope.select(key, F.col("fx_flag").eqNullSafe(FX_YES).alias("_fx")).groupBy(key).agg(F.max("_fx").alias("_fx"))
    out = summary.join(flags, key, "left")
    return out.withColumn("amount", F.when(F.coalesce("_fx", F.lit(False)), F.col("amount") * rate)
                          .otherwise(F.col("amount") * F.lit(1).cast(RATE))).drop("_fx")


def _numbered(summary: DataFrame, keys) -> DataFrame:
    # Lines per (company, area) are already aggregated (one per GL text), so
    # this window runs over small, bounded groups.
    w = Window.partitionBy(*keys, "func_area").orderBy("gl_text")
    return summary.withColumn("line_no", F.row_number().over(w))


def _cells_from_lines(lines: DataFrame, keys, sheet: str) -> DataFrame:
    """Line rows with ``row_no`` -> cell rows: text in C, amount in E (one
    pass: each line yields its two cells)."""
    amount_type = lines.schema["amount"].dataType
    text = F.struct(F.concat(F.lit("C"), F.col("row_no").cast("string")).alias("cell"),
                    F.col("gl_text").alias("text"), F.lit(None).cast(amount_type).alias("amount"))
    amt = F.struct(F.concat(F.lit("E"), F.col("row_no").cast("string")).alias("cell"),
                   F.lit(None).cast("string").alias("text"), F.col("amount").alias("amount"))
    return lines.select(*keys, F.lit(sheet).alias("sheet"), F.inline(F.array(text, amt)))


def place_fixed(summary: DataFrame, keys=("company",), starts=None,
                sheet: str = SHEET_EXPENSE) -> DataFrame:
    """Lines to cells from fixed start rows per area (G3), ordered by GL text."""
    keys = list(keys)
    starts = starts or EXPENSE_FIXED_STARTS
    start = F.create_map(*[x for a, r in starts.items() for x in (F.lit(a), F.lit(r))])
    lines = _numbered(summary.filter(F.col("func_area").isin(list(starts))), keys)
    lines = lines.withColumn("row_no", start[F.col("func_area")] + F.col("line_no") - 1)
    return _cells_from_lines(lines, keys, sheet)


def slot_counts(template_rows: DataFrame, areas=EXPENSE_AREAS, max_row: int | None = None,
                sheet: str = SHEET_EXPENSE) -> DataFrame:
    """Template slots per area: occurrences of the area label in column A of
    the expense sheet, minus 2 (E7), over the whole column; ``max_row`` limits
    the scanned range (600 or 500 in the desktop flows)."""
    r = template_rows.filter(F.col("sheet") == sheet)
    if max_row is not None:
        r = r.filter(F.col("row_no") <= max_row)
    a = F.get(F.col("cells"), 0)
    return (r.groupBy(F.col("file_name").alias("company"))
            .agg(*[(F.count(F.when(a == area, 1)) - 2).alias(f"slots_{i}")
                   for i, area in enumerate(areas)]))


def dynamic_plan(summary: DataFrame, slots: DataFrame, areas=EXPENSE_AREAS,
                 legacy_offsets: bool = False) -> DataFrame:
    """Per company and area: slots, lines, rows to add, start row and the row
    to copy (G4). ``legacy_offsets`` reproduces the source's double-counted
    offset for the third area; the default is the commented intent."""
    counts = (summary.groupBy("company")
              .agg(*[F.count(F.when(F.col("func_area") == a, 1)).alias(f"lines_{i}")
                     for i, a in enumerate(areas)]))
    # a company without lines keeps its sheet as it is; one without a template
    # can't be placed (see placement_rejects)
    j = slots.join(counts, "company", "left").na.fill(0, [f"lines_{i}" for i in range(len(areas))])
    s, a_, r = F.col("slots_0"), F.col("slots_1"), F.col("slots_2")
    some = F.col("lines_0") + F.col("lines_1") + F.col("lines_2") > 0
    add0 = F.when(some, F.greatest(F.col("lines_0") - s, F.lit(0))).otherwise(F.lit(0))
    add1 = F.when(some, F.greatest(F.col("lines_1") - a_, F.lit(0))).otherwise(F.lit(0))
    add2 = F.when(some, F.greatest(F.col("lines_2") - r, F.lit(0))).otherwise(F.lit(0))
    start0 = F.lit(2)
    start1 = 2 + s + 6 + add0
    copy0 = s
    copy1 = s + a_ + 6 + add0
    if legacy_offsets:
        start2 = (start1 + a_ + 6) + add0 + add1
        copy2 = (copy1 + r + 6) + add0 + add1
    else:
        start2 = 2 + s + 6 + a_ + 6 + add0 + add1
        copy2 = s + a_ + 6 + r + 6 + add0 + add1
    plans = [
        F.struct(F.lit(areas[0]).alias("func_area"), s.alias("slots"), F.col("lines_0").alias("lines"),
                 add0.alias("rows_added"), start0.alias("start_row"), copy0.alias("copy_row")),
        F.struct(F.lit(areas[1]).alias("func_area"), a_.alias("slots"), F.col("lines_1").alias("lines"),
                 add1.alias("rows_added"), start1.alias("start_row"), copy1.alias("copy_row")),
        F.struct(F.lit(areas[2]).alias("func_area"), r.alias("slots"), F.col("lines_2").alias("lines"),
                 add2.alias("rows_added"), start2.alias("start_row"), copy2.alias("copy_row")),
    ]
    return j.select("company", F.inline(F.array(*plans)))


def place_dynamic(summary: DataFrame, slots: DataFrame, legacy_offsets: bool = False,
                  sheet: str = SHEET_EXPENSE) -> DataFrame:
    """Lines to cells with start rows from :func:`dynamic_plan`."""
    plan = dynamic_plan(summary, slots, legacy_offsets=legacy_offsets)
    lines = _numbered(summary, ["company"]).join(plan.select("company", "func_area", "start_row"),
                                                 ["company", "func_area"])
    lines = lines.withColumn("row_no", F.col("start_row") + F.col("line_no") - 1)
    return _cells_from_lines(lines, ["company"], sheet)


def placement_rejects(summary: DataFrame, slots: DataFrame) -> DataFrame:
    """Companies with lines but without a template sheet, and the number of
    lines that so have no place."""
    missing = summary.join(slots.select("company"), "company", "left_anti")
    return missing.groupBy("company").agg(F.count(F.lit(1)).alias("lines"), F.lit("no template sheet").alias("reason"))


# ---------------------------------------------------------------------------
# Scope (entity list) helpers.
# ---------------------------------------------------------------------------

SCOPE_HEADERS = [("serial", "24年试算序号"), ("company", "公司名称"), ("report_name", "报表名称"),
                 ("sap_code", "SAP代码"), ("fx_flag", "是否外币")]


def read_scope(rows: DataFrame) -> DataFrame:
    """Scope workbook (A13): each file's first sheet (``rows`` carry
    ``sheet_idx``), header in its first row, columns by header text; ``seq``
    is the row number (a later duplicate code wins)."""
    from tallyspark.operators import papers as P
    first = P.read_used_range(rows, auto=False)
    t = P.read_sheet_table(first, None, names=[h for _, h in SCOPE_HEADERS])
    return t.select(*[F.col(h).alias(c) for c, h in SCOPE_HEADERS], F.col("row_no").cast("bigint").alias("seq"))


def lookup_report_name(scope: DataFrame, code_col: str = "sap_code",
                       order_col: str = "seq") -> DataFrame:
    """Company code -> report name; for a duplicated code the last row wins
    (D5). The scope is a config table, so the window is over tiny groups."""
    w = Window.partitionBy(code_col).orderBy(F.col(order_col).desc())
    return (scope.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select(code_col, "report_name"))


def fx_entities(scope: DataFrame, foreign: bool = True) -> DataFrame:
    """Entities flagged foreign-currency (``是``); null counts as not."""
    flag = F.col("fx_flag").eqNullSafe(FX_YES)
    return scope.filter(flag if foreign else ~flag)


def paper_name(serial, company, year: str = "2024", suffix: str = ".xlsx"):
    """``serial-company2024.xlsx``."""
    return F.concat(F.col(serial).cast("string"), F.lit("-"), F.col(company), F.lit(year + suffix))


def dynamic_layout(template_cells: DataFrame, plan: DataFrame, areas=EXPENSE_AREAS) -> DataFrame:
    """The expense sheet after the row insertions of the dynamic placement
    (G4): for each area in order, ``rows_added`` rows are inserted at its copy
    row (rows from there move down) and filled with copies of that row.

    ``template_cells(company, row_no, col_no, value)``; ``plan`` from
    :func:`dynamic_plan`, whose copy rows already count the rows added by the
    earlier areas, so the three steps compose in order. Each step is narrow
    over the template cells plus one small per-company row of the plan."""
    p = plan.groupBy("company").agg(
        *[F.max(F.when(F.col("func_area") == a, F.col("copy_row"))).alias(f"_c{i}") for i, a in enumerate(areas)],
        *[F.max(F.when(F.col("func_area") == a, F.col("rows_added"))).alias(f"_a{i}") for i, a in enumerate(areas)])
    cols = ["company", "row_no", "col_no", "value"]
    cells = template_cells.select(*cols).join(p, "company", "left")
    for i in range(len(areas)):
        c, a = F.col(f"_c{i}"), F.coalesce(F.col(f"_a{i}"), F.lit(0))
        moved = F.when((a > 0) & (F.col("row_no") >= c), F.col("row_no") + a).otherwise(F.col("row_no"))
        # one pass per step: every cell keeps its (moved) row; the copied row,
        # now at c + a, also fills the inserted rows c .. c + a - 1
        rows = F.when((a > 0) & (moved == c + a), F.concat(F.array(moved), F.sequence(c, c + a - 1))) \
            .otherwise(F.array(moved))
        cells = cells.withColumn("row_no", F.explode(rows))
    return cells.select(*cols)


def dynamic_paper(template_cells: DataFrame, summary: DataFrame, slots: DataFrame,
                  legacy_offsets: bool = False) -> DataFrame:
    """Expense sheet cells after inserting rows and pasting the lines (G4 + G3):
    ``(company, row_no, col_no, value)``; pasted text/amounts win."""
    from tallyspark.functions.exprs import cell_ref_col, cell_ref_row
    plan = dynamic_plan(summary, slots, legacy_offsets=legacy_offsets)
    laid = dynamic_layout(template_cells, plan)
    placed = place_dynamic(summary, slots, legacy_offsets).select(
        "company", cell_ref_row("cell").cast("long").alias("row_no"), cell_ref_col("cell").alias("col_no"),
        F.coalesce(F.col("text"), F.col("amount").cast(MONEY).cast("string")).alias("_new"))
    keys = ["company", "row_no", "col_no"]
    j = laid.withColumn("row_no", F.col("row_no").cast("long")).join(
        placed.withColumn("_w", F.lit(True)), keys, "full_outer")
    return j.select(*keys, F.when(F.coalesce("_w", F.lit(False)), F.col("_new")).otherwise(F.col("value"))
                    .alias("value"))
