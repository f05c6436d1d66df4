"""Composite jobs: the public entry points, one run for all companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import balances as B
from tallyspark.operators import cells as C
from tallyspark.operators import ledger as L
from tallyspark.operators.joins import any_row
from tallyspark.operators import recon as R
from tallyspark.operators import rules as RU
from tallyspark.schemas import (AUDIT_RANGES, EXP_NAMES, EXPENSE_SHEET_TITLES, FX_YES, RATE, SHEET_STATEMENT,
                                YOY_NAMES, YOY_RANGES)


@dataclass
class TbResult:
    cells: DataFrame          # (company, sheet, cell, amount)
    recon: DataFrame | None   # reconciliation rows, layout A with statement rules only
    rejects: DataFrame        # rule rows the source would fail on


def tb_to_cells(bal: DataFrame, rules: DataFrame, rates: DataFrame | None = None,
                layout: str = "A", sheets=None, drop_opening: bool = True,
                keys=("company",), log_path: str | None = None, rollup: int | None = None) -> TbResult:
    """Balances + rules + rates -> cell amounts and reconciliation (H1).

    ``layout`` "A" takes the 14-column export, "B" the 12-column one; with ``rollup``
    its codes also count under their first ``rollup`` characters (E1). Every company
    of the balance table gets every rule cell. With ``log_path`` the reconciliation
    rows are appended there per company (B6)."""
    keys = list(keys)
    if rollup is not None:
        bal = B.rolled_rows(bal, rollup)
    unpivot = B.unpivot_a if layout == "A" else B.unpivot_b
    parts = RU.clean_rules(rules)
    if drop_opening:
        parts = RU.drop_opening_rules(parts)
    if sheets is not None:
        parts = RU.select_sheets(parts, sheets)
    # nulls stay: a company without any amount is a company
    cells = C.conditional_zero(C.cell_amounts(unpivot(bal, keys, drop_nulls=False), parts, rates, keys), keys)
    # verification runs only for layout A, and gives rows only when the statement
    # sheet is among the (selected) rule sheets, as in the source
    recon = None
    if layout == "A" and (sheets is None or SHEET_STATEMENT in sheets):
        has_statement = any_row(parts.filter(F.col("sheet") == SHEET_STATEMENT))
        recon = R.reconcile(unpivot(bal, keys), parts, keys, SHEET_STATEMENT).filter(has_statement)
    if log_path and recon is not None:
        from tallyspark.sinks.writers import write_recon_log
        write_recon_log(recon, log_path, by=keys[0], companies=bal.select(keys[0]))
    return TbResult(cells=cells, recon=recon, rejects=RU.rule_rejects(rules))


def ledger_to_cells(ledger: DataFrame, scope: DataFrame | None, average_rate,
                    starts=None) -> DataFrame:
    """Ledger -> summary -> FX by entity flag -> cells at fixed starts (H6)."""
    summary = L.expense_summary(L.parse_ledger(ledger))
    return L.place_fixed(L.expense_fx(summary, scope, average_rate), starts=starts)


def ledger_to_cells_dynamic(ledger: DataFrame, template_rows: DataFrame,
                            legacy_offsets: bool = False, max_row: int | None = None) -> DataFrame:
    """Ledger -> summary -> cells with slot-driven starts (H6, second form)."""
    summary = L.expense_summary(L.parse_ledger(ledger))
    return L.place_dynamic(summary, L.slot_counts(template_rows, max_row=max_row), legacy_offsets)


def split_ledger(ledger: DataFrame, scope: DataFrame) -> DataFrame:
    """Scope LEFT JOIN ledger on company code, tagged with the report name
    that names each output part (B3). Codes without lines keep one row with
    null ledger columns, so the empty outputs are visible."""
    names = L.lookup_report_name(scope).withColumnRenamed("sap_code", "company_code")
    lines = ledger.join(names, "company_code", "inner")
    empty = names.join(ledger.select("company_code").distinct(), "company_code", "left_anti")
    cols = [c for c in ledger.columns if c != "company_code"]
    return lines.select("report_name", "company_code", *cols).unionByName(
        empty.select("report_name", "company_code", *[F.lit(None).cast("string").alias(c) for c in cols]))


def batch_entities(ledger: DataFrame, scope: DataFrame, average_rate) -> DataFrame:
    """Run the ledger job for every scope row: the per-entity loop becomes a
    join. Lines are summarised by company code *before* the join with the
    (small) scope, and each scope row names one paper (H8)."""
    summary = L.expense_summary(L.parse_ledger(ledger), keys=["company_code"])
    papers = scope.select(F.col("sap_code").alias("company_code"), L.paper_name("serial", "company").alias("paper"), "fx_flag")
    j = summary.join(papers, "company_code")
    rate = F.lit(str(average_rate)).cast(RATE)
    j = j.withColumn("amount", F.when(F.col("fx_flag").eqNullSafe(FX_YES), F.col("amount") * rate)
                     .otherwise(F.col("amount") * F.lit(1).cast(RATE)))
    return L.place_fixed(j, keys=["paper"])


@dataclass
class StatementResult:
    cells: DataFrame      # (file_name, sheet, cell, amount)
    long: DataFrame       # concatenated long statements
    problems: DataFrame   # files with a missing section marker


def statements_to_cells(rows: DataFrame, rules: DataFrame, drop_opening: bool = False) -> StatementResult:
    """Statement sheet rows + statement-sheet rules -> cells (H2). Opening
    rules are kept unless ``drop_opening`` (the "no opening" mode)."""
    from tallyspark.operators import statements as ST
    parts = RU.clean_rules(rules)
    if drop_opening:
        parts = RU.drop_opening_rules(parts)
    long = ST.long_statements(rows)
    stacked = ST.stack_panels(ST.read_balance_panels(rows))
    files = rows.filter(F.col("sheet").isin(ST.BALANCE_RANGE[0], ST.INCOME_RANGE[0])).select("file_name").distinct()
    # a file whose sections can't be cut has no cells; it is listed in problems
    problems = ST.missing_markers(stacked)
    files = files.join(problems, "file_name", "left_anti")
    return StatementResult(cells=ST.statement_cells(long, parts, files=files), long=long, problems=problems)


def report_to_cells(group_balance: DataFrame, group_income: DataFrame, **kw) -> DataFrame:
    """Group statements -> per-company split -> placed statement cells (H7)."""
    from tallyspark.operators import group as G
    b, i = G.split_statements(group_balance, group_income)
    return G.place_statement(b, i, **kw)


def pair_files(cells: DataFrame, relation: DataFrame) -> DataFrame:
    """Attach each company's cells to its paper through the relation table
    (balance file <-> paper): the index-paired loop becomes a join (D6)."""
    rel = relation.select("company", L.paper_name("serial", "company").alias("paper"))
    return cells.join(rel, "company").select("paper", "company", "sheet", "cell", "amount")


def read_expense_papers(papers: DataFrame) -> DataFrame:
    """The six ranges of the expense papers in one pass; audited lines without
    an amount left out."""
    from tallyspark.operators import papers as P
    specs = [(n, "8_费用", a, b) for n, a, b in AUDIT_RANGES] + [(n, "8", a, b) for n, a, b in YOY_RANGES]
    both = P.read_ranges(papers, specs, EXP_NAMES + YOY_NAMES, file_col="公司")
    return both.filter(~F.col("table").isin([n for n, _, _ in AUDIT_RANGES]) | F.col("本期未审").isNotNull())


def expense_papers(papers: DataFrame, targets: DataFrame) -> DataFrame:
    """The three audited and the three year-on-year tables pasted at A9 of
    titled copies of their template sheets, rows inserted (H4). ``targets``:
    the copies' cells ``(sheet, row_no, col_no, value)``, named by table. The lines are
    written once: their counts, positions and cells are read from there."""
    from tallyspark.operators import papers as P
    from tallyspark.session import written
    lines = written(read_expense_papers(papers), "expense-lines")
    titles = F.create_map(*[x for k, v in EXPENSE_SHEET_TITLES.items() for x in (F.lit(k), F.lit(v))])
    targets = targets.withColumn("value", F.when((F.col("row_no") == 1) & (F.col("col_no") == 0), titles[F.col("sheet")])
                                 .otherwise(F.col("value")))

    def block(columns):
        return F.array(*[F.struct(F.lit(i).alias("col_off"), F.col(c).alias("value")) for i, c in columns])

    audited = block(enumerate(["公司"] + EXP_NAMES))
    yoy = block([(0, "公司"), (1, "项目"), (2, "本期发生额"), (4, "上期发生额")])
    pos = P.block_positions(lines, ("公司", "row_no"), by=["table"])
    cells = pos.select(F.col("table").alias("sheet"), "pos",
                       F.inline(F.when(F.col("table").isin([n for n, _, _ in AUDIT_RANGES]), audited).otherwise(yoy)))
    sizes = lines.groupBy(F.col("table").alias("sheet")).agg(F.count(F.lit(1)).alias("n"))
    return P.append_block(targets, cells, "A9", sizes)


def cells_to_papers(cells: DataFrame, papers: DataFrame) -> DataFrame:
    """The write step of the composite jobs (B7): set the cells
    ``(paper, sheet, cell, amount)`` in the papers' cells ``(file_name, sheet,
    row_no, col_no, value)``; all other cells stay."""
    from tallyspark.functions.exprs import cell_ref_col, cell_ref_row
    from tallyspark.operators import papers as P
    updates = cells.select(F.col("paper").alias("file_name"), "sheet", cell_ref_row("cell").alias("row_no"),
                           cell_ref_col("cell").alias("col_no"), F.col("amount").cast("string").alias("value"), F.lit(1).alias("seq"))
    return P.apply_cell_updates(papers, updates)


def ingest_balances(rows: DataFrame, target: str | None = None) -> DataFrame:
    """Folder of layout-A balance exports (sheet rows) -> one table with the
    source file recorded; written as a replaced table when ``target`` is
    given (H9)."""
    from tallyspark.sinks.writers import replace_table
    out = B.read_balance_a(rows, record_path=True)
    if target:
        replace_table(out, target)
    return out


def ingest_statements(rows: DataFrame, target_balance: str | None = None,
                      target_income: str | None = None):
    """Folder of statement files -> balance-sheet panels and income lines as
    two tables (H10)."""
    from tallyspark.operators import statements as ST
    from tallyspark.sinks.writers import replace_table
    bal, inc = ST.read_balance_panels(rows), ST.read_income(rows)
    if target_balance:
        replace_table(bal, target_balance)
    if target_income:
        replace_table(inc, target_income)
    return bal, inc


def ingest_group(group_balances: DataFrame, n_cols: int = 8, target: str | None = None) -> DataFrame:
    """Group balance export -> its first ``n_cols`` columns as a table."""
    from tallyspark.sinks.writers import replace_table
    out = group_balances.select(*group_balances.columns[:n_cols])
    if target:
        replace_table(out, target)
    return out


def entity_rates(scope: DataFrame, closing_rate, average_rate, key: str = "company") -> DataFrame:
    """``(company, sheet, rate)`` for foreign-currency entities of the scope;
    the others are absent and so translate at 1. The sheet-to-rate rule is a
    fixed short list, exploded per entity."""
    pairs = C.sheet_rates(closing_rate, average_rate)
    arr = F.array(*[F.struct(F.lit(sh).alias("sheet"), F.lit(str(r)).cast(RATE).alias("rate")) for sh, r in pairs])
    fx = L.fx_entities(scope, True).select(key).distinct()
    return fx.select(key, F.inline(arr))


def batch_tb_to_cells(bal: DataFrame, rules: DataFrame, scope: DataFrame, closing_rate, average_rate,
                      layout: str = "A") -> DataFrame:
    """The balances job for every scope row at once (H8). A row's balance
    file is found by its report name and its paper is
    ``serial-company2024.xlsx``; foreign-currency rows get the closing /
    average rates, the others 1. Balances outside the scope are left out.
    Output ``(paper, company, sheet, cell, amount)``."""
    sc = scope.select(F.col("report_name").alias("company"), L.paper_name("serial", "company").alias("paper"), "fx_flag")
    in_scope = bal.join(sc.select("company").distinct(), "company", "left_semi")
    rates = entity_rates(sc, closing_rate, average_rate)
    cells = tb_to_cells(in_scope, rules, rates, layout=layout).cells
    return cells.join(sc.select("company", "paper"), "company").select("paper", "company", "sheet", "cell", "amount")


def batch_report_to_cells(group_balance: DataFrame, group_income: DataFrame, scope: DataFrame,
                          fx_sheet: str = "原报表USD") -> DataFrame:
    """Statement placement for every scope row (H8 with H7): a row's
    statements are found by its report name, its paper is
    ``serial-company2024.xlsx``, and foreign-currency rows are placed on
    ``fx_sheet`` instead of the statement sheet."""
    cells = report_to_cells(group_balance, group_income)
    sc = scope.select(F.col("report_name").alias("company"), L.paper_name("serial", "company").alias("paper"),
                      F.col("fx_flag").eqNullSafe(FX_YES).alias("_fx"))
    j = cells.join(sc, "company")
    return j.select("paper", "company", F.when(F.col("_fx"), F.lit(fx_sheet)).otherwise(F.col("sheet")).alias("sheet"),
                    "cell", "amount")
