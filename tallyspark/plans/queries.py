"""Inventory keys wired to fixtures (registered into ``catalog.QUERIES``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.exprs import account_class, parse_thousands
from tallyspark.operators import balances as B
from tallyspark.operators import cells as C
from tallyspark.operators import counterparty as CP
from tallyspark.operators import ledger as L
from tallyspark.operators import papers as P
from tallyspark.operators import recon as R
from tallyspark.operators import rules as RU
from tallyspark.operators import statements as ST
from tallyspark.plans import fixtures as X
from tallyspark.plans import jobs as J
from tallyspark.plans.catalog import register
from tallyspark.schemas import AUDIT_RANGES, EXP_NAMES, YOY_NAMES, YOY_RANGES
from tallyspark.sources.files import read_ledger_rows


def _parts(spark, d):
    return RU.drop_opening_rules(RU.clean_rules(X.rules(spark, d)))


def _long_a(spark, d):
    return B.unpivot_a(X.bal_a(spark, d))


# --- rules ----------------------------------------------------------------

@register("explode_pipe_rules")
def q_explode(spark, d):
    return RU.explode_pipe_rules(X.rules(spark, d))


@register("op_to_sign")
def q_sign(spark, d):
    return RU.clean_rules(X.rules(spark, d))


@register("drop_opening_rules")
def q_drop_opening(spark, d):
    return _parts(spark, d)


@register("select_sheets")
def q_select_sheets(spark, d):
    return RU.select_sheets(_parts(spark, d), ["原报表", "1"])


# --- balances -------------------------------------------------------------

@register("unpivot_a")
def q_unpivot_a(spark, d):
    return _long_a(spark, d)


@register("account_class")
def q_account_class(spark, d):
    a = X.bal_a(spark, d)
    return a.select("company", "acct_code", account_class("acct_code").alias("account_class"))


@register("distinct_companies")
def q_companies(spark, d):
    return X.bal_a(spark, d).select("company").distinct()


# --- cells ----------------------------------------------------------------

@register("join_rules_balances")
def q_join_rules_balances(spark, d):
    return C.join_rules_balances(_long_a(spark, d), _parts(spark, d))


@register("cell_amounts")
def q_cell_amounts(spark, d):
    return C.cell_amounts(_long_a(spark, d), _parts(spark, d))


@register("rate_by_sheet")
def q_rate_by_sheet(spark, d):
    return C.cell_amounts(_long_a(spark, d), _parts(spark, d), rates=X.rates(spark))


@register("conditional_zero")
def q_conditional_zero(spark, d):
    return C.conditional_zero(C.cell_amounts(_long_a(spark, d), _parts(spark, d)))


@register("tb_to_cells")
def q_tb_to_cells(spark, d):
    return J.tb_to_cells(X.bal_a(spark, d), X.rules(spark, d), X.rates(spark), layout="A").cells


# --- reconciliation -------------------------------------------------------

@register("join_matched_only")
def q_matched_only(spark, d):
    return R.join_matched_only(_long_a(spark, d), _parts(spark, d))


@register("mapped_by_l1")
def q_mapped_by_l1(spark, d):
    return R.mapped_by_l1(_long_a(spark, d), _parts(spark, d))


@register("reconcile")
def q_reconcile(spark, d):
    return R.reconcile(_long_a(spark, d), _parts(spark, d))



# --- layout B and sheet readers -------------------------------------------

@register("prefix_rollup")
def q_prefix_rollup(spark, d):
    return B.prefix_rollup(X.bal_b(spark, d), n=4)


@register("prefix_rollup_collide")
def q_prefix_rollup_collide(spark, d):
    """Source default length 6 on 6-character codes: each code counts twice."""
    return B.prefix_rollup(X.bal_b(spark, d), n=6)


@register("prefix_rollup_skip_existing")
def q_prefix_rollup_skip(spark, d):
    return B.prefix_rollup(X.bal_b(spark, d), n=6, skip_existing=True)


@register("unpivot_b")
def q_unpivot_b(spark, d):
    return B.unpivot_b(B.prefix_rollup(X.bal_b(spark, d), n=4))


@register("tb_to_cells_b")
def q_tb_to_cells_b(spark, d):
    return J.tb_to_cells(X.bal_b(spark, d), X.rules_b(spark, d), X.rates(spark), layout="B", rollup=4).cells


@register("assert_single_sheet")
def q_single_sheet(spark, d):
    return B.single_sheet_files(X.rows_a(spark, d))


@register("read_balance_a")
def q_read_balance_a(spark, d):
    return B.read_balance_a(X.rows_a(spark, d))


@register("read_balance_b")
def q_read_balance_b(spark, d):
    return B.read_balance_b(X.rows_b(spark, d))


@register("load_base")
def q_load_base(spark, d):
    """Rules and layout-A balances loaded together, joined into cells."""
    return J.tb_to_cells(B.read_balance_a(X.rows_a(spark, d)), X.rules(spark, d), None, layout="A").cells


# --- ledger ---------------------------------------------------------------

def _summary(spark, d):
    return L.expense_summary(L.parse_ledger(X.ledger(spark, d)))


@register("parse_thousands")
def q_parse_thousands(spark, d):
    lg = X.ledger(spark, d)
    return lg.select("company", "amount_text", parse_thousands("amount_text").alias("amount"))


@register("parse_trailing_minus")
def q_parse_trailing_minus(spark, d):
    return L.parse_ledger(X.ledger(spark, d)).select("company", "amount_text", "amount")


@register("semi_categories")
def q_semi_categories(spark, d):
    return L.semi_categories(L.parse_ledger(X.ledger(spark, d))).select(
        "company", "func_area", "gl_text", "amount")


@register("expense_summary")
def q_expense_summary(spark, d):
    return _summary(spark, d)


@register("expense_fx")
def q_expense_fx(spark, d):
    return L.expense_fx(_summary(spark, d), X.scope(spark, d), "7.1140")


@register("place_fixed")
def q_place_fixed(spark, d):
    return L.place_fixed(_summary(spark, d))


@register("slot_counts")
def q_slot_counts(spark, d):
    return L.slot_counts(X.expense_template(spark, d), max_row=None)


@register("place_dynamic_plan")
def q_dynamic_plan(spark, d):
    return L.dynamic_plan(_summary(spark, d), L.slot_counts(X.expense_template(spark, d), max_row=None))


@register("place_dynamic")
def q_place_dynamic(spark, d):
    return L.place_dynamic(_summary(spark, d), L.slot_counts(X.expense_template(spark, d), max_row=None))


@register("ledger_to_cells")
def q_ledger_to_cells(spark, d):
    return J.ledger_to_cells(X.ledger(spark, d), X.scope(spark, d), "7.1140")


@register("read_scope")
def q_read_scope(spark, d):
    return L.read_scope(X.scope_rows(spark, d)).withColumn("serial", F.col("serial").cast("bigint"))


@register("read_ledger")
def q_read_ledger(spark, d):
    return read_ledger_rows(X.ledger_rows(spark, d)).drop("row_no")


@register("ledger_rejects")
def q_ledger_rejects(spark, d):
    """Lines whose amount text is no number: here those of one area, an x added."""
    lines = X.ledger(spark, d).withColumn("amount_text", F.concat("amount_text", F.when(F.col("func_area") == "研发费用", "x").otherwise("")))
    return L.ledger_rejects(lines).select("company", "func_area", "gl_text", "amount_text", "reason")


@register("placement_rejects")
def q_placement_rejects(spark, d):
    """Companies with lines but without a template: here those of even codes have none."""
    slots = L.slot_counts(X.expense_template(spark, d).filter("cast(substring(file_name, 8) as int) % 2 = 1"))
    return L.placement_rejects(_summary(spark, d), slots)


@register("lookup_report_name")
def q_lookup_report_name(spark, d):
    return L.lookup_report_name(X.scope(spark, d))


@register("fx_entity_filter")
def q_fx_entity_filter(spark, d):
    s = X.scope(spark, d)
    return (L.fx_entities(s, True).withColumn("is_fx", F.lit(True))
            .unionByName(L.fx_entities(s, False).withColumn("is_fx", F.lit(False))))


@register("paper_name")
def q_paper_name(spark, d):
    return X.scope(spark, d).select("sap_code", L.paper_name("serial", "company").alias("paper"))


@register("split_ledger")
def q_split_ledger(spark, d):
    return J.split_ledger(X.ledger(spark, d), X.scope(spark, d))


@register("batch_entities")
def q_batch_entities(spark, d):
    return J.batch_entities(X.ledger(spark, d), X.scope(spark, d), "7.1140")


# --- counterparty ---------------------------------------------------------

def _cp(spark, d):
    return X.counterparty_rows(spark, d)


def _register_extract(key, name):
    @register(key)
    def q(spark, d):
        return CP.extract(_cp(spark, d), name)
    q.__name__ = f"q_{key}"
    return q


for _key, _name in [("counterparty_other_receivables", "其他应收款"),
                    ("counterparty_other_payables", "其他应付款"),
                    ("counterparty_payables", "应付账款"),
                    ("counterparty_prepayments", "预付账款"),
                    ("counterparty_other_noncurrent", "其他非流动资产"),
                    ("counterparty_receivables", "应收账款"),
                    ("counterparty_advances", "预收账款")]:
    _register_extract(_key, _name)


@register("counterparty_extract")
def q_counterparty_extract(spark, d):
    """All seven tables in one pass over the sheet rows, tagged by table."""
    x = CP.extract_all_long(_cp(spark, d))
    return x.select("table", "file_name", "row_no", F.concat_ws("|", "values").alias("values"))


@register("project_positional")
def q_project_positional(spark, d):
    rows = CP.skip_rows(_cp(spark, d).filter(F.col("sheet") == "CF2"), 3)
    return CP.project_positional(rows, 11, 29)


@register("rename_positional")
def q_rename_positional(spark, d):
    from tallyspark.schemas import PAYABLES_HEADERS
    rows = CP.skip_rows(_cp(spark, d).filter(F.col("sheet") == "应付账款"), 4)
    return CP.rename_positional(rows, 0, PAYABLES_HEADERS)


@register("drop_marker_rows")
def q_drop_marker_rows(spark, d):
    from tallyspark.functions.exprs import not_in
    from tallyspark.schemas import PAYABLES_HEADERS
    rows = CP.skip_rows(_cp(spark, d).filter(F.col("sheet") == "应付账款"), 4)
    kept = rows.filter(not_in(CP.cell(0), ["供应商编码", "合计", "下方填写合并关联方", "下方填写非合并关联方", "下方填写其他"])
                       & not_in(CP.cell(6), ["币种"]))
    return CP.rename_positional(kept, 0, PAYABLES_HEADERS)


@register("require_any")
def q_require_any(spark, d):
    rows = CP.skip_rows(_cp(spark, d).filter(F.col("sheet") == "CF2"), 3)
    keep = CP.cell(12).isNotNull() & (CP.cell(13).isNotNull() | CP.cell(14).isNotNull() | CP.cell(15).isNotNull())
    return CP.project_positional(rows.filter(keep), 11, 16)


@register("nonzero")
def q_nonzero(spark, d):
    from tallyspark.functions.exprs import ne_zero_keep_null
    rows = CP.skip_rows(_cp(spark, d), 3)
    cf2 = rows.filter((F.col("sheet") == "CF2") & ne_zero_keep_null(CP.num(16))).select(
        F.lit("keep_null").alias("mode"), "file_name", "row_no", CP.cell(16).alias("amount_text"))
    ar = rows.filter((F.col("sheet") == "应收账款") & CP.cell(6).isNotNull()
                     & ne_zero_keep_null(CP.num(6))).select(
        F.lit("not_null").alias("mode"), "file_name", "row_no", CP.cell(6).alias("amount_text"))
    return cf2.unionByName(ar)


# --- statements -----------------------------------------------------------

def _stmt_rows(spark, d):
    return X.statement_rows(spark, d)


@register("read_statement_ranges")
def q_read_statement_ranges(spark, d):
    return ST.read_balance_panels(_stmt_rows(spark, d))


@register("drop_contains")
def q_drop_contains(spark, d):
    return ST.read_income(_stmt_rows(spark, d))


@register("stack_panels")
def q_stack_panels(spark, d):
    return ST.stack_panels(ST.read_balance_panels(_stmt_rows(spark, d)))


@register("strip_text")
def q_strip_text(spark, d):
    return ST.stack_panels(ST.read_balance_panels(_stmt_rows(spark, d))).select("file_name", "row_no", "panel", "item")


@register("section_lines")
def q_section_lines(spark, d):
    return ST.section_lines(ST.stack_panels(ST.read_balance_panels(_stmt_rows(spark, d))))


@register("melt_balance_sheet")
def q_melt_balance(spark, d):
    return ST.melt_balance_sheet(ST.section_lines(ST.stack_panels(ST.read_balance_panels(_stmt_rows(spark, d)))))


@register("melt_income")
def q_melt_income(spark, d):
    return ST.melt_income(ST.read_income(_stmt_rows(spark, d)))


@register("concat_statements")
def q_concat_statements(spark, d):
    return ST.long_statements(_stmt_rows(spark, d))


@register("line_keys")
def q_line_keys(spark, d):
    return ST.long_statements(_stmt_rows(spark, d)).select("file_name", "statement", "line_key").distinct()


@register("tag_literals")
def q_tag_literals(spark, d):
    return ST.long_statements(_stmt_rows(spark, d)).select("file_name", "row_no", "line_key", "category",
                                                             "statement").distinct()


@register("statement_cells")
def q_statement_cells(spark, d):
    parts = RU.clean_rules(X.statement_rules(spark))
    rows = _stmt_rows(spark, d)
    files = rows.select("file_name").distinct()
    return ST.statement_cells(ST.long_statements(rows), parts, files=files)


@register("statements_to_cells")
def q_statements_to_cells(spark, d):
    return J.statements_to_cells(_stmt_rows(spark, d), X.statement_rules(spark)).cells


@register("tb_to_papers")
def q_tb_to_papers(spark, d):
    """The balances job down to the written cells of every paper."""
    cells = J.tb_to_cells(X.bal_a(spark, d), X.rules(spark, d), X.rates(spark), layout="A").cells
    names = X.paper_names(spark, d)
    return J.cells_to_papers(cells.join(names, "company"), P.to_cells(X.paper_rows(spark, d)))


@register("statements_to_papers")
def q_statements_to_papers(spark, d):
    """The statement job, opening rules dropped, down to the written cells."""
    cells = J.statements_to_cells(_stmt_rows(spark, d), X.statement_rules(spark), drop_opening=True).cells
    papers = cells.withColumn("paper", F.concat("file_name", F.lit("公司2024")))
    return J.cells_to_papers(papers, P.to_cells(X.paper_rows(spark, d)))


# --- working papers -------------------------------------------------------

PAPER_RULE = dict(must=["公司"], must_not=["日志", "~$", "小合并"])
EXTRACT_RULE = dict(must_not=["合并", "日志", "~$"])


def _papers(spark, d, rule=None):
    return P.filter_files(X.paper_rows(spark, d), **(rule or PAPER_RULE))


@register("filter_files")
def q_filter_files(spark, d):
    return P.filter_files(X.paper_rows(spark, d).select("file_name").distinct(), **PAPER_RULE)


@register("read_range")
def q_read_range(spark, d):
    return P.read_range(_papers(spark, d), "8_费用", "B1", "G61", names=EXP_NAMES)


def _audited(spark, d):
    specs = [(name, "8_费用", a, b) for name, a, b in AUDIT_RANGES]
    return (P.read_ranges(_papers(spark, d), specs, EXP_NAMES, file_col="公司")
            .filter(F.col("本期未审").isNotNull()))


@register("expense_papers_audited")
def q_expense_audited(spark, d):
    return _audited(spark, d)


@register("expense_papers_yoy")
def q_expense_yoy(spark, d):
    return _yoy(spark, d)


@register("range_export")
def q_range_export(spark, d):
    return P.read_range(_papers(spark, d, EXTRACT_RULE), "8", "A93", "C123", names=YOY_NAMES)


@register("stack_by_name")
def q_stack_by_name(spark, d):
    rows = _papers(spark, d)
    a = P.read_range(rows, "8_费用", "B1", "G61", names=EXP_NAMES)
    b = P.read_range(rows, "8", "A93", "C123", names=YOY_NAMES)
    return a.unionByName(b, allowMissingColumns=True)


def _block_cells(audited):
    """Audited rows -> (sheet, pos, col_off, value), one sheet per table."""
    cols = ["公司"] + EXP_NAMES
    pos = P.block_positions(audited, ("公司", "row_no"), by=["table"])
    return pos.select(F.col("table").alias("sheet"), "pos",
                      F.inline(F.array(*[F.struct(F.lit(i).alias("col_off"), F.col(c).alias("value"))
                                         for i, c in enumerate(cols)])))


def _template_copies(spark, sheets):
    """The template sheet copied under each output sheet name (a fixed list)."""
    return X.audit_template(spark).select(F.explode(F.array(*[F.lit(s) for s in sheets])).alias("sheet"),
                                          "row_no", "col_no", "value")


@register("append_block")
def q_append_block(spark, d):
    audited = _audited(spark, d).filter(F.col("table") == "审定表_销售费用")
    return P.append_block(_template_copies(spark, ["审定表_销售费用"]), _block_cells(audited), "A9")


def _yoy(spark, d):
    specs = [(name, "8", a, b) for name, a, b in YOY_RANGES]
    return P.read_ranges(_papers(spark, d), specs, YOY_NAMES, file_col="公司")


@register("expense_papers")
def q_expense_papers(spark, d):
    """The three audited tables and the three year-on-year tables pasted into
    titled copies of their template sheets (H4)."""
    audit_sheets = [name for name, _, _ in AUDIT_RANGES]
    yoy_sheets = [name for name, _, _ in YOY_RANGES]
    targets = _template_copies(spark, audit_sheets).unionByName(
        X.yoy_template(spark).select(F.explode(F.array(*[F.lit(s) for s in yoy_sheets])).alias("sheet"),
                                     "row_no", "col_no", "value"))
    return J.expense_papers(_papers(spark, d), targets)


@register("auto_header")
def q_auto_header(spark, d):
    return P.auto_header(X.rows_a(spark, d))


@register("read_used_range")
def q_used_range(spark, d):
    rows = X.rows_a(spark, d).withColumn("sheet_idx", F.lit(0))
    return P.used_range(P.read_used_range(rows, auto=False))


@register("scan_many")
def q_scan_many(spark, d):
    return B.read_balance_a(X.rows_a(spark, d), record_path=True)


@register("apply_cell_updates")
def q_apply_cell_updates(spark, d):
    return P.apply_cell_updates(P.to_cells(X.paper_rows(spark, d)), X.paper_updates(spark, d))


OVERLAY_RANGES = [("B2", "D58"), ("B68", "D113")]


@register("overlay_block")
def q_overlay_block(spark, d):
    rows = X.paper_rows(spark, d)
    papers = _papers(spark, d).select("file_name").distinct()
    return P.overlay_block(P.to_cells(rows), rows, "NATION_0公司2024", "8_费用", OVERLAY_RANGES, papers)


@register("as_text_label")
def q_as_text_label(spark, d):
    return P.template_block(X.paper_rows(spark, d), "NATION_0公司2024", "8_费用", OVERLAY_RANGES)


# --- group workbook -------------------------------------------------------

def _split(spark, d):
    from tallyspark.operators import group as G
    bal, inc = X.group_statements(spark, d)
    return G.split_statements(bal, inc)


@register("split_statements")
def q_split_statements(spark, d):
    return _split(spark, d)[0]


@register("split_statements_income")
def q_split_statements_income(spark, d):
    return _split(spark, d)[1]


@register("split_balances")
def q_split_balances(spark, d):
    from tallyspark.operators import group as G
    return G.split_balances(X.group_balances_text(spark, d))


@register("place_statement")
def q_place_statement(spark, d):
    from tallyspark.operators import group as G
    b, i = _split(spark, d)
    return G.place_statement(b, i)


@register("report_to_cells")
def q_report_to_cells(spark, d):
    bal, inc = X.group_statements(spark, d)
    return J.report_to_cells(bal, inc)


@register("split_group")
def q_split_group(spark, d):
    """Rows per company in each of the three per-company outputs."""
    from tallyspark.operators import group as G
    b, i = _split(spark, d)
    led = J.split_ledger(X.ledger(spark, d), X.scope(spark, d))
    bal = G.split_balances(X.group_balances_text(spark, d))
    return (b.groupBy("company").count().withColumn("output", F.lit("statements"))
            .unionByName(i.groupBy("company").count().withColumn("output", F.lit("income")))
            .unionByName(led.groupBy(F.col("report_name").alias("company"))
                         .agg(F.count("gl_text").alias("count")).withColumn("output", F.lit("ledger")))
            .unionByName(bal.groupBy("company").count().withColumn("output", F.lit("balances"))))


@register("join_rules_statements")
def q_join_rules_statements(spark, d):
    long = ST.long_statements(_stmt_rows(spark, d)).select(
        "file_name", F.col("line_key").alias("acct_code"), F.col("amount_type").alias("item"), "amount")
    parts = RU.clean_rules(X.statement_rules(spark))
    return C.join_rules_balances(long, parts, keys=["file_name"])


@register("pair_files")
def q_pair_files(spark, d):
    cells = J.tb_to_cells(X.bal_a(spark, d), X.rules(spark, d), X.rates(spark), layout="A").cells
    return J.pair_files(cells, X.scope(spark, d))


@register("read_rules")
def q_read_rules(spark, d):
    return RU.read_rules(X.rule_rows(spark, d)).drop("row_no")


# --- remaining inventory keys ---------------------------------------------

@register("project_named")
def q_project_named(spark, d):
    """Required rule columns, in order."""
    return X.rules(spark, d).select("cell", "accts", "ops", "items")


@register("coalesce_zero")
def q_coalesce_zero(spark, d):
    """Cell amounts the way the source writes them: rules LEFT JOIN balances,
    ``round(sum(amount * sign), 2)``, null -> 0 (a second plan for E2)."""
    j = C.join_rules_balances(_long_a(spark, d), _parts(spark, d))
    return (j.groupBy("company", "sheet", "cell")
            .agg(F.coalesce(F.round(F.sum(F.col("amount") * F.col("sign")), 2), F.lit(0))
                 .cast("decimal(18,2)").alias("amount")))


@register("ledger_to_cells_dynamic")
def q_ledger_to_cells_dynamic(spark, d):
    # the fixture's template column covers every customer row: count all of it
    return J.ledger_to_cells_dynamic(X.ledger(spark, d), X.expense_template(spark, d), max_row=None)


@register("ingest_balances")
def q_ingest_balances(spark, d):
    return J.ingest_balances(X.rows_a(spark, d))


@register("ingest_statements")
def q_ingest_statements(spark, d):
    return J.ingest_statements(_stmt_rows(spark, d))[0]


@register("ingest_group")
def q_ingest_group(spark, d):
    from tallyspark.operators import group as G
    return J.ingest_group(G.split_balances(X.group_balances_text(spark, d)))


@register("list_files")
def q_list_files(spark, d):
    """The folder of the given tables, listed without reading contents."""
    from tallyspark.sources.files import list_files
    return list_files(spark, d, recursive=True, suffixes=("parquet",)).select("name", "length")


@register("rule_rejects")
def q_rule_rejects(spark, d):
    """Rule rows the source would fail on (C12 guard)."""
    return RU.rule_rejects(X.rules(spark, d))


@register("batch_tb_to_cells")
def q_batch_tb_to_cells(spark, d):
    return J.batch_tb_to_cells(X.bal_a(spark, d), X.rules(spark, d), X.scope(spark, d), "7.1884", "7.1140")


@register("dynamic_paper")
def q_dynamic_paper(spark, d):
    """Expense sheets after row insertion and paste (the dynamic ledger flow)."""
    tmpl = P.to_cells(X.expense_template(spark, d)).select(
        F.col("file_name").alias("company"), "row_no", "col_no", "value")
    return L.dynamic_paper(tmpl, _summary(spark, d), L.slot_counts(X.expense_template(spark, d), max_row=None))


@register("batch_report_to_cells")
def q_batch_report_to_cells(spark, d):
    bal, inc = X.group_statements(spark, d)
    # the group statements are per supplier; entities are named after them in this scope
    sc = X.supplier_scope(spark, d)
    return J.batch_report_to_cells(bal, inc, sc)


from tallyspark.plans import written  # noqa: E402,F401  (registers its keys)
