"""Command line for the flows a user of the desktop toolkit runs, on folders of
workbooks at cluster scale.

    python -m tallyspark ingest  <folder> <rows_table> [--sheets CF2 ...] [--flat]
    python -m tallyspark tb      --balances <rows_table> --rules <rows_table> --out <dir>
                                 [--layout A|B] [--closing-rate R --average-rate R]
                                 [--keep-opening] [--sheets 1 8 ...] [--log <dir>]
                                 [--relation <rows_table>] [--scope <rows_table>] [--papers <rows_table>]
    python -m tallyspark statements   --reports <rows_table> --rules <rows_table> --out <dir> [--keep-opening]
                                 [--sheets S ...] [--relation <rows_table>] [--papers <rows_table>]
    python -m tallyspark counterparty --papers <rows_table> --out <dir>
    python -m tallyspark expense      --papers <rows_table> --out <dir> [--template <rows_table>]
    python -m tallyspark range        --papers <rows_table> --sheet S --start B1 --end G61 --out <dir> [--header N]
    python -m tallyspark split-group  --group <rows_table> --scope <rows_table> --out <dir>
    python -m tallyspark ledger       --ledger <rows_table or .csv> --scope <rows_table> --out <dir> [--average-rate R]
                                      [--template <rows_table> [--legacy-offsets]]
    python -m tallyspark group-cells  --group <rows_table> --scope <rows_table> --out <dir>
    python -m tallyspark overlay      --papers <rows_table> --template <rows_table> --template-file F --sheet S
                                      --ranges B2:D58 ... --out <dir>
    python -m tallyspark tables       --kind balances|statements|group --rows <rows_table> --out <dir>
                                      [--exclude FRAGMENT ...]

Workbooks are parsed once by ``ingest`` into a Parquet sheet-rows table; every
other command reads such tables and writes Parquet outputs (cell tables rather
than edited workbooks).
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tallyspark.session import get_spark


def _rates(spark, closing, average):
    from tallyspark.operators.cells import sheet_rates
    if closing is None and average is None:
        return None
    rows = [(s, str(r)) for s, r in sheet_rates(closing or 1, average or 1)]
    return spark.createDataFrame(rows, "sheet string, rate string").select(
        "sheet", F.col("rate").cast("decimal(10,4)").alias("rate"))


def _rules(spark, path):
    from tallyspark.operators.rules import read_rules
    from tallyspark.sources.xlsx import sheet_rows
    return read_rules(sheet_rows(spark, path)).drop("row_no")


def _scope(spark, path):
    from tallyspark.operators.ledger import read_scope
    from tallyspark.sources.xlsx import sheet_rows
    return read_scope(sheet_rows(spark, path, with_index=True))


def _ledger(spark, path, sheet):
    """Ledger lines of an ingested table, or of CSV files."""
    from tallyspark.sources.files import read_ledger_csv, read_ledger_rows
    from tallyspark.sources.xlsx import sheet_rows
    if path.lower().rstrip("/").endswith(".csv"):
        return read_ledger_csv(spark, path).drop("file_path")
    return read_ledger_rows(sheet_rows(spark, path, [sheet])).drop("file_name", "row_no")


RELATION_HEADERS = [("balance_path", "科目余额表路径"), ("paper_path", "试算底稿路径")]


def _relation(spark, path, sheet="匹配结果"):
    """Relation sheet: balance file path <-> working-paper path; the balance
    file's base name (suffix dropped) is the company key of the cells."""
    from tallyspark.functions.exprs import base_name
    from tallyspark.operators import papers as P
    from tallyspark.sources.xlsx import sheet_rows
    t = P.read_sheet_table(sheet_rows(spark, path, [sheet]), sheet, names=[h for _, h in RELATION_HEADERS])
    name = base_name(F.col("科目余额表路径"))
    return t.select(F.regexp_replace(name, r"\.(xlsx|xlsm|xls)$", "").alias("company"),
                    F.col("试算底稿路径").alias("paper"))


def _write_papers(spark, cells, papers, out) -> None:
    """The papers' cells with the amounts set; a paper is found by its file name."""
    from tallyspark.functions.exprs import base_name
    from tallyspark.operators import papers as P
    from tallyspark.plans.jobs import cells_to_papers
    from tallyspark.sinks.writers import write_per_company
    from tallyspark.sources.xlsx import sheet_rows
    named = cells.withColumn("paper", F.regexp_replace(base_name("paper"), r"\.(xlsx|xlsm|xls)$", ""))
    write_per_company(cells_to_papers(named, P.to_cells(sheet_rows(spark, papers))), f"{out}/papers", by="file_name")


def run(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tallyspark")
    p.add_argument("--input-gb", type=float, help="size of the input, for shuffle sizing where the submit configuration sets none")
    sub = p.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("target")
    a.add_argument("--sheets", nargs="*")
    a.add_argument("--flat", action="store_true", help="only the folder itself, not its subfolders")
    t = sub.add_parser("tb")
    t.add_argument("--balances", required=True)
    t.add_argument("--rules", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--layout", choices=["A", "B"], default="A")
    t.add_argument("--prefix", type=int, default=6, help="layout B roll-up length")
    t.add_argument("--closing-rate", type=float)
    t.add_argument("--average-rate", type=float)
    t.add_argument("--keep-opening", action="store_true")
    t.add_argument("--sheets", nargs="*")
    t.add_argument("--log")
    t.add_argument("--relation", help="pairs balance files with papers; cells keyed by paper")
    t.add_argument("--papers", help="ingested papers (with --relation); their cells with the amounts set go to <out>/papers")
    t.add_argument("--scope", help="FX rates only for entities flagged foreign-currency")
    s = sub.add_parser("statements")
    s.add_argument("--reports", required=True)
    s.add_argument("--rules", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--keep-opening", action="store_true")
    s.add_argument("--sheets", nargs="*")
    s.add_argument("--relation", help="pairs report files with papers; cells keyed by paper")
    s.add_argument("--papers", help="ingested papers; their cells with the amounts set go to <out>/papers")
    c = sub.add_parser("counterparty")
    c.add_argument("--papers", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--skip-trial", action="store_true",
                   help="also skip file names containing 试算 (the recursive-folder rule)")
    e = sub.add_parser("expense")
    e.add_argument("--papers", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--template", help="ingested template workbook; the tables pasted into copies of its sheets go to <out>/papers")
    e.add_argument("--audit-sheet", default="审定表")
    e.add_argument("--yoy-sheet", default="同期比较")
    r = sub.add_parser("range")
    r.add_argument("--papers", required=True)
    r.add_argument("--sheet", required=True)
    r.add_argument("--start", required=True)
    r.add_argument("--end", required=True)
    r.add_argument("--header", type=int, default=0, help="row of the range holding the header")
    r.add_argument("--out", required=True)
    g = sub.add_parser("split-group")
    g.add_argument("--group", required=True)
    g.add_argument("--scope", required=True)
    g.add_argument("--out", required=True)
    lg = sub.add_parser("ledger")
    lg.add_argument("--ledger", required=True)
    lg.add_argument("--sheet", default="FBL3H费用")
    lg.add_argument("--scope", required=True)
    lg.add_argument("--out", required=True)
    lg.add_argument("--average-rate", type=float, default=1.0)
    lg.add_argument("--template", help="ingested expense sheets, one file a company: lines go where their slots are (dynamic placement)")
    lg.add_argument("--legacy-offsets", action="store_true")
    gc = sub.add_parser("group-cells")
    gc.add_argument("--group", required=True)
    gc.add_argument("--scope", required=True)
    gc.add_argument("--out", required=True)
    ov = sub.add_parser("overlay")
    ov.add_argument("--papers", required=True)
    ov.add_argument("--template", required=True)
    ov.add_argument("--template-file", required=True, help="name of the template workbook, without suffix")
    ov.add_argument("--sheet", required=True)
    ov.add_argument("--ranges", nargs="+", required=True, help="label blocks, as B2:D58")
    ov.add_argument("--out", required=True)
    tb_ = sub.add_parser("tables")
    tb_.add_argument("--kind", choices=["balances", "statements", "group"], required=True)
    tb_.add_argument("--rows", required=True)
    tb_.add_argument("--out", required=True)
    tb_.add_argument("--exclude", nargs="*", default=[], help="skip files whose name contains these")
    args = p.parse_args(argv)
    spark = get_spark(input_bytes=None if args.input_gb is None else int(args.input_gb * 1e9))

    from tallyspark.sinks.writers import export_merged, replace_table, write_per_company
    from tallyspark.sources.xlsx import ingest_workbooks, sheet_rows

    if args.cmd == "ingest":
        ingest_workbooks(spark, args.folder, args.target, sheets=args.sheets, recursive=not args.flat)
    elif args.cmd == "tb":
        from tallyspark.operators import balances as B
        from tallyspark.plans.jobs import tb_to_cells
        rows = sheet_rows(spark, args.balances)
        bal = B.read_balance_a(rows) if args.layout == "A" else B.read_balance_b(rows)
        rates = _rates(spark, args.closing_rate, args.average_rate)
        if args.scope:
            from tallyspark.plans.jobs import entity_rates
            # an entity's balance file is named by its report name
            sc = _scope(spark, args.scope).select(F.col("report_name").alias("company"), "fx_flag")
            rates = entity_rates(sc, args.closing_rate or 1, args.average_rate or 1)
        res = tb_to_cells(bal, _rules(spark, args.rules), rates,
                          layout=args.layout, sheets=args.sheets, drop_opening=not args.keep_opening,
                          rollup=args.prefix if args.layout == "B" else None)
        rel = None
        if args.relation:
            rel = _relation(spark, args.relation)
            paired = res.cells.join(rel, "company")
            write_per_company(paired, f"{args.out}/cells", by="paper")
            replace_table(res.cells.join(rel, "company", "left_anti"), f"{args.out}/cells_without_paper")
            if args.papers:
                _write_papers(spark, paired, args.papers, args.out)
        else:
            write_per_company(res.cells, f"{args.out}/cells")
        if args.log and res.recon is not None:
            from tallyspark.sinks.writers import write_recon_log
            # the log carries the paper it belongs to when the relation is known
            write_recon_log(res.recon.join(rel, "company", "left") if rel is not None else res.recon, args.log,
                            companies=bal.select("company"))
        replace_table(res.rejects, f"{args.out}/rule_rejects")
    elif args.cmd == "statements":
        from tallyspark.plans.jobs import statements_to_cells
        rules = _rules(spark, args.rules)
        if args.sheets is not None:
            rules = rules.filter(F.col("sheet").isin(args.sheets))
        res = statements_to_cells(sheet_rows(spark, args.reports), rules, drop_opening=not args.keep_opening)
        if args.relation:
            rel = _relation(spark, args.relation).withColumnRenamed("company", "file_name")
            paired = res.cells.join(rel, "file_name")
            write_per_company(paired, f"{args.out}/cells", by="paper")
            replace_table(res.cells.join(rel, "file_name", "left_anti"), f"{args.out}/cells_without_paper")
            if args.papers:
                _write_papers(spark, paired, args.papers, args.out)
        else:
            write_per_company(res.cells, f"{args.out}/cells", by="file_name")
        replace_table(res.long, f"{args.out}/statements_long")
        replace_table(res.problems, f"{args.out}/problems")
    elif args.cmd == "counterparty":
        from tallyspark.operators.counterparty import EXTRACTS, extract
        from tallyspark.schemas import COUNTERPARTY_SHEETS
        from tallyspark.operators import papers as P
        from tallyspark.schemas import SKIP_NAME_FRAGMENT_RECURSIVE, SKIP_NAME_FRAGMENTS_EXTRACT
        skip = list(SKIP_NAME_FRAGMENTS_EXTRACT) + ([SKIP_NAME_FRAGMENT_RECURSIVE] if args.skip_trial else [])
        rows = P.filter_files(sheet_rows(spark, args.papers, COUNTERPARTY_SHEETS), must_not=skip)
        for spec in EXTRACTS:  # one output per table, named like the table
            export_merged(extract(rows, spec).drop("row_no"), f"{args.out}/{spec.name}")
    elif args.cmd == "expense":
        from tallyspark.operators import papers as P
        from tallyspark.plans import jobs as J
        from tallyspark.schemas import AUDIT_RANGES, EXP_NAMES, YOY_NAMES, YOY_RANGES
        rows = P.filter_files(sheet_rows(spark, args.papers, ["8_费用", "8"]),
                              must=["公司"], must_not=["日志", "~$", "小合并"])
        both = J.read_expense_papers(rows)
        is_audit = F.col("table").isin([n for n, _, _ in AUDIT_RANGES])
        replace_table(both.filter(is_audit).select("公司", "row_no", *EXP_NAMES, "table"), f"{args.out}/audited")
        replace_table(both.filter(~is_audit).select("公司", "row_no", *YOY_NAMES, "table"), f"{args.out}/year_on_year")
        if args.template:
            cells = P.to_cells(sheet_rows(spark, args.template, [args.audit_sheet, args.yoy_sheet]))
            copies = F.create_map(F.lit(args.audit_sheet), F.array(*[F.lit(n) for n, _, _ in AUDIT_RANGES]),
                                  F.lit(args.yoy_sheet), F.array(*[F.lit(n) for n, _, _ in YOY_RANGES]))
            targets = cells.select(F.explode(copies[F.col("sheet")]).alias("sheet"), "row_no", "col_no", "value")
            replace_table(J.expense_papers(rows, targets), f"{args.out}/papers")
    elif args.cmd == "split-group":
        from tallyspark.operators import group as G
        from tallyspark.operators import papers as P
        from tallyspark.plans.jobs import split_ledger
        rows = sheet_rows(spark, args.group)
        bal = P.read_sheet_table(rows, "资产负债表").drop("file_name", "row_no")
        inc = P.read_sheet_table(rows, "利润表").drop("file_name", "row_no")
        b, i = G.split_statements(bal, inc)
        write_per_company(b, f"{args.out}/statements/balance_sheet")
        write_per_company(i, f"{args.out}/statements/income")
        led = _ledger(spark, args.group, "FBL3H费用")
        write_per_company(split_ledger(led, _scope(spark, args.scope)), f"{args.out}/ledger", by="report_name")
        grp = P.read_sheet_table(rows, "科目余额表").drop("file_name", "row_no")
        write_per_company(G.split_balances(grp), f"{args.out}/balances")
    elif args.cmd == "ledger":
        from tallyspark.operators import ledger as L
        from tallyspark.plans.jobs import batch_entities, ledger_to_cells_dynamic
        led, scope = _ledger(spark, args.ledger, args.sheet), _scope(spark, args.scope)
        if args.template:
            # a line's company is the report name of its code
            names = L.lookup_report_name(scope).select(F.col("sap_code").alias("company_code"), F.col("report_name").alias("company"))
            slots = sheet_rows(spark, args.template, ["8_费用"])
            cells = ledger_to_cells_dynamic(led.drop("company").join(names, "company_code"), slots, args.legacy_offsets)
            write_per_company(cells, f"{args.out}/cells")
        else:
            write_per_company(batch_entities(led, scope, args.average_rate), f"{args.out}/cells", by="paper")
    elif args.cmd == "group-cells":
        from tallyspark.operators import papers as P
        from tallyspark.plans.jobs import batch_report_to_cells
        rows = sheet_rows(spark, args.group)
        bal, inc = (P.read_sheet_table(rows, sheet).drop("file_name", "row_no") for sheet in ("资产负债表", "利润表"))
        write_per_company(batch_report_to_cells(bal, inc, _scope(spark, args.scope)), f"{args.out}/cells", by="paper")
    elif args.cmd == "overlay":
        from tallyspark.operators import papers as P
        rows = sheet_rows(spark, args.papers)
        ranges = [tuple(r.split(":")) for r in args.ranges]
        out = P.overlay_block(P.to_cells(rows), sheet_rows(spark, args.template), args.template_file, args.sheet, ranges, rows)
        write_per_company(out, f"{args.out}/papers", by="file_name")
    elif args.cmd == "tables":
        from tallyspark.operators import papers as P
        from tallyspark.plans import jobs as J
        rows = P.filter_files(sheet_rows(spark, args.rows), must_not=args.exclude)
        if args.kind == "balances":
            J.ingest_balances(rows, f"{args.out}/balances")
        elif args.kind == "statements":
            J.ingest_statements(rows, f"{args.out}/balance_sheet", f"{args.out}/income")
        else:
            grp = P.read_sheet_table(rows, "科目余额表").drop("file_name", "row_no")
            J.ingest_group(grp, target=f"{args.out}/group_balances")
            for sheet, name in (("资产负债表", "group_balance_sheet"), ("利润表", "group_income")):
                replace_table(P.read_sheet_table(rows, sheet).drop("file_name", "row_no"), f"{args.out}/{name}")
    elif args.cmd == "range":
        from tallyspark.operators import papers as P
        rows = P.filter_files(sheet_rows(spark, args.papers, [args.sheet]), must_not=["合并", "日志", "~$"])
        export_merged(P.read_range(rows, args.sheet, args.start, args.end, header=args.header).drop("row_no"), args.out)


if __name__ == "__main__":
    run()
