"""Keys that write: what a sink or a scan of files gives, read back. Each writes
fixtures of the given tables into a new shared folder and returns what a reader
finds there."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.functions.exprs import parse_trailing_minus
from tallyspark.operators import balances as B
from tallyspark.operators import group as G
from tallyspark.operators import papers as P
from tallyspark.operators import recon as R
from tallyspark.operators import rules as RU
from tallyspark.plans import fixtures as X
from tallyspark.plans import jobs as J
from tallyspark.plans.catalog import register
from tallyspark.schemas import MONEY
from tallyspark.session import shared_folder
from tallyspark.sinks import writers as W
from tallyspark.sinks.workbooks import write_workbooks
from tallyspark.sources import files as FS
from tallyspark.sources import stack as S
from tallyspark.sources.xlsx import read_workbooks, scan_workbook_cells

SCAN_SHEETS = ["CF2", "应收账款"]
SCAN_FIRST_ROW = 4


@register("scan_workbook_cells")
def q_scan_workbook_cells(spark, d):
    """The counterparty papers as .xlsx files, and the cells of two of their six sheets
    below the banner; sheets and rows are pushed into the scan (A3)."""
    folder = shared_folder(spark, "workbooks")
    write_workbooks(X.counterparty_papers(spark, d), folder, goes_on=True).write.format("noop").mode("overwrite").save()
    rows = scan_workbook_cells(spark, folder, once=True).where(F.col("sheet").isin(SCAN_SHEETS) & (F.col("row_no") >= SCAN_FIRST_ROW))
    return P.to_cells(rows)


@register("scan_workbook_counts")
def q_scan_workbook_counts(spark, d):
    """Rows and rejects of every file and sheet of a folder that also holds a workbook
    without sheets and a file that isn't one (A3)."""
    folder = shared_folder(spark, "workbooks")
    write_workbooks(X.counterparty_papers(spark, d), folder, goes_on=True).write.format("noop").mode("overwrite").save()
    nations = X.table(spark, d, "nation").select(F.concat(F.lit("坏"), F.col("n_name")).alias("file_name"))
    _write_texts(nations.select("file_name", F.lit("not a workbook").alias("text")), folder, ".xlsx")
    rows = read_workbooks(spark, folder)
    return rows.groupBy("file_name", "sheet").agg(F.count("row_no").alias("n_rows"), F.count("error").alias("n_errors"))


def _write_texts(texts, folder, suffix):
    """One small file each: ``file_name``, ``text``."""
    import pandas as pd

    from tallyspark.sinks.workbooks import _put

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"path": [_put(folder, n + suffix, t.encode()) for n, t in zip(pdf["file_name"], pdf["text"])]})

    texts.mapInPandas(run, "path string").write.format("noop").mode("overwrite").save()


# --- replaced tables --------------------------------------------------------

@register("replace_table")
def q_replace_table(spark, d):
    """Layout-A balances published, then replaced by those of the level-1 codes alone;
    what readers find after each (B1)."""
    target = shared_folder(spark, "balances")
    bal = X.bal_a(spark, d).select("company", "acct_code", "closing")
    W.publish(bal, target)
    W.publish(bal.where(F.length("acct_code") == 4), target)
    both = W.published(spark, target, 1).withColumn("version", F.lit(1))
    return both.unionByName(W.published(spark, target).withColumn("version", F.lit(2)))


# --- one output per company -------------------------------------------------

def _with_counts(rows, manifest, by):
    return rows.join(manifest.select(F.col("part").alias(by), F.col("n_rows").alias("part_rows")), by, "full_outer")


@register("split_statements_written")
def q_split_statements_written(spark, d):
    b, _ = G.split_statements(*X.group_statements(spark, d))
    path = shared_folder(spark, "statements")
    manifest = W.write_parts(b, path)
    return _with_counts(W.read_parts(spark, path, b.schema), manifest, "company")


@register("split_ledger_written")
def q_split_ledger_written(spark, d):
    """Amounts as numbers of 2 decimals; codes without lines are parts of no rows."""
    split = J.split_ledger(X.ledger(spark, d), X.scope(spark, d))
    lines = split.where("company is not null").withColumn("amount", parse_trailing_minus("amount_text").cast(MONEY)).drop("amount_text")
    path = shared_folder(spark, "ledger")
    manifest = W.write_parts(lines, path, "report_name", expected=split)
    return _with_counts(W.read_parts(spark, path, lines.schema, "report_name"), manifest, "report_name")


@register("split_balances_written")
def q_split_balances_written(spark, d):
    b = G.split_balances(X.group_balances_text(spark, d))
    path = shared_folder(spark, "balances")
    manifest = W.write_parts(b, path)
    return _with_counts(W.read_parts(spark, path, b.schema), manifest, "company")


@register("read_one_part")
def q_read_one_part(spark, d):
    """One company's written balances: only its folder is read."""
    b = G.split_balances(X.group_balances_text(spark, d)).select("company", "acct_code", "currency", "lc_closing")
    path = shared_folder(spark, "balances")
    W.write_parts(b, path)
    return W.read_parts(spark, path, b.schema, parts=["NATION_3"])


# --- reconciliation log -----------------------------------------------------

@register("write_recon_log")
def q_write_recon_log(spark, d):
    """Two runs: all companies; then those of regions 1 and 2, where only differences
    above a million are left and region 2 agrees wholly. Readers find each company's
    last run (B6)."""
    path = shared_folder(spark, "recon-log")
    parts = RU.drop_opening_rules(RU.clean_rules(X.rules(spark, d)))
    recon = R.reconcile(B.unpivot_a(X.bal_a(spark, d)), parts).select("company", "acct_code", "closing", "diff")
    everyone = X.bal_a(spark, d).select("company").distinct()
    W.write_recon_log(recon, path, run=1, companies=everyone)
    n = X.table(spark, d, "nation")
    again = everyone.join(n.select(F.col("n_name").alias("company"), "n_regionkey"), "company").where("n_regionkey in (1, 2)")
    left = recon.join(again.where("n_regionkey = 1").select("company"), "company").where("abs(diff) > 1000000")
    W.write_recon_log(left, path, run=2, companies=again.select("company"))
    return W.read_recon_log(spark, path)


# --- stacks of unlike files -------------------------------------------------

def _unlike_files(spark, d):
    """The balances of each company as it keeps them: all columns, no codes' names, or
    no movements; (region key, DataFrame) each."""
    n = X.table(spark, d, "nation").select(F.col("n_name").alias("company"), "n_regionkey")
    bal = X.bal_a(spark, d).select("company", "acct_code", "acct_name", "opening", "period_debit", "closing").join(n, "company")
    kinds = [(bal.n_regionkey <= 1, ["acct_code", "acct_name", "opening", "period_debit", "closing"]),
             (bal.n_regionkey == 2, ["closing", "acct_code"]), (bal.n_regionkey >= 3, ["acct_code", "opening", "closing", "company"])]
    return [(i, bal.where(cond).select(F.col("company").alias("part"), *cols)) for i, (cond, cols) in enumerate(kinds)]


@register("scan_many_columns")
def q_scan_many_columns(spark, d):
    """CSV files of three kinds of columns in one folder, stacked by name."""
    folder = shared_folder(spark, "unlike")
    for i, df in _unlike_files(spark, d):
        df.write.partitionBy("part").option("header", "true").csv(f"{folder}/kind={i}")
    out = S.stack_csv(spark, folder)
    part = F.regexp_extract(S.FILE_COL, "part=([^/]+)/", 1)
    money = [F.col(c).cast(MONEY).alias(c) for c in ("opening", "period_debit", "closing")]
    return out.select(part.alias("file_company"), "acct_code", "acct_name", "company", *money)


@register("export_merged")
def q_export_merged(spark, d):
    """Parquet files of three kinds of columns merged into one output, the file first."""
    folder, out = shared_folder(spark, "unlike"), shared_folder(spark, "merged")
    for i, df in _unlike_files(spark, d):
        df.write.partitionBy("part").parquet(f"{folder}/kind={i}")
    stack = S.stack_parquet(spark, folder)
    W.export_merged(stack.withColumn(S.FILE_COL, F.regexp_extract(S.FILE_COL, "part=([^/]+)/", 1)), out)
    return spark.read.parquet(out)


# --- checks and CSV ledger --------------------------------------------------

@register("single_sheet_metrics")
def q_single_sheet_metrics(spark, d):
    """Files, sheets and violations, measured while the balances are read (A10)."""
    seen = Observation()
    B.read_balance_a(X.rows_a(spark, d), observation=seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(got["files"], got["sheets"], got["violations"])], "files long, sheets long, violations long")


def _csv_ledger(spark, d):
    """The ledger as CSV files, its texts quoted and over two lines here and there, and
    one line a nation that doesn't fit the header."""
    folder = shared_folder(spark, "ledger-csv")
    headers = dict(FS.LEDGER_HEADERS)
    text = F.when(F.length("gl_text") % 3 == 0, F.concat(F.lit('"'), "gl_text", F.lit('",\n'), "func_area")).otherwise(F.col("gl_text"))
    led = X.ledger(spark, d).withColumn("gl_text", text)
    led.select(*[F.col(c).alias(h) for c, h in headers.items()]).write.option("header", "true").option("escape", '"').csv(f"{folder}/good")
    bad = X.table(spark, d, "nation").select(F.concat(F.lit(",".join(headers.values())), F.lit("\nX"), F.col("n_nationkey").cast("string"),
                                                      F.lit(",销售费用,a,1.00,"), F.col("n_name"), F.lit("\n")).alias("text"),
                                             F.concat(F.lit("bad-"), F.col("n_name")).alias("file_name"))
    _write_texts(bad, f"{folder}/bad", ".csv")
    return f"{folder}/*"


@register("read_ledger_csv")
def q_read_ledger_csv(spark, d):
    """The ledger through CSV and back, its lines whole."""
    return FS.read_ledger_csv(spark, _csv_ledger(spark, d)).select(
        "company_code", "func_area", "gl_text", parse_trailing_minus("amount_text").cast(MONEY).alias("amount"))


@register("ledger_csv_rejects")
def q_ledger_csv_rejects(spark, d):
    return FS.ledger_csv_rejects(spark, _csv_ledger(spark, d)).select("first_field", "line")


# --- papers -----------------------------------------------------------------

@register("update_papers")
def q_update_papers(spark, d):
    """Written papers after the updates of the papers of regions 0 and 1."""
    path = shared_folder(spark, "papers")
    W.write_per_company(P.to_cells(X.paper_rows(spark, d)), path, by="file_name")
    some = X.paper_names(spark, d).join(X.table(spark, d, "nation").where("n_regionkey <= 1"), F.col("company") == F.col("n_name"))
    updates = X.paper_updates(spark, d).join(some.select(F.col("paper").alias("file_name")), "file_name", "left_semi")
    P.update_papers(spark, path, updates)
    cells = "file_name", "sheet", "row_no", "col_no", "value"
    return spark.read.parquet(path).select(*cells)


@register("ingest_statements_income")
def q_ingest_statements_income(spark, d):
    """The second table of the statement ingest."""
    return J.ingest_statements(X.statement_rows(spark, d))[1]
