"""Working-paper grids: range reads, header detection, cell updates, template
overlays and row-inserting appends, all as set-based DataFrame transforms.

Two shapes are used:
* sheet rows ``(file_name, sheet, row_no, cells ARRAY<STRING>)`` (row_no is
  1-based, array index 0 is column A) - what a scan emits;
* cells ``(file_name, sheet, row_no, col_no, value)`` (col_no 0-based) - what
  cell-addressed updates need. Conversion rows -> cells is a narrow
  ``posexplode``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.functions.exprs import as_text_label, not_contains, strip_text
from tallyspark.operators.joins import header_names
from tallyspark.session import written


def parse_ref(ref: str) -> tuple[int, int]:
    """'B12' -> (row 12, zero-based column 1)."""
    m = re.fullmatch(r"([A-Za-z]+)(\d+)", ref.strip())
    if not m:
        raise ValueError(f"bad cell reference {ref!r}")
    col = 0
    for ch in m.group(1).upper():
        col = col * 26 + (ord(ch) - 64)
    return int(m.group(2)), col - 1


def to_cells(rows: DataFrame, keep_nulls: bool = False) -> DataFrame:
    """Sheet rows -> one row per cell (narrow)."""
    c = rows.select("file_name", "sheet", "row_no", F.posexplode("cells").alias("col_no", "value"))
    c = c.withColumn("col_no", F.col("col_no").cast("int"))
    return c if keep_nulls else c.filter(F.col("value").isNotNull())


# ---------------------------------------------------------------------------
# Reading ranges
# ---------------------------------------------------------------------------

def range_rows(rows: DataFrame, sheet: str, start: str, end: str) -> DataFrame:
    """Rows of rectangle ``start:end`` with ``cells`` cut to its columns."""
    r1, c1 = parse_ref(start)
    r2, c2 = parse_ref(end)
    sel = rows.filter((F.col("sheet") == sheet) & F.col("row_no").between(r1, r2))
    return sel.select("file_name", "sheet", "row_no",
                      F.transform(F.sequence(F.lit(c1), F.lit(c2)), lambda i: F.get(F.col("cells"), i)).alias("cells"))


def read_ranges(rows: DataFrame, specs, names, header: int = 0, file_col: str = "文件名",
                tag_col: str = "table") -> DataFrame:
    """Several rectangles read in one pass (A4 for many ranges at once).

    ``specs`` is a list of ``(tag, sheet, start, end)``; every range's row
    ``header`` is its header and columns are located by header text per file,
    so files whose columns moved still line up. Each sheet row is matched to
    the ranges that contain it by exploding the (fixed, short) range list;
    the header arrays come from one aggregate per (file, range) joined back.
    A file without the sheet gives no rows."""
    ranges = []
    for tag, sheet, start, end in specs:
        (r1, c1), (r2, c2) = parse_ref(start), parse_ref(end)
        ranges.append(F.struct(F.lit(tag).alias("tag"), F.lit(sheet).alias("sheet"), F.lit(r1).alias("r1"),
                               F.lit(r2).alias("r2"), F.lit(c1).alias("c1"), F.lit(c2).alias("c2")))
    sheets = sorted({sp[1] for sp in specs})
    cand = (rows.filter(F.col("sheet").isin(sheets))
            .select("file_name", "sheet", "row_no", "cells", F.explode(F.array(*ranges)).alias("_s"))
            .filter((F.col("sheet") == F.col("_s.sheet")) & F.col("row_no").between(F.col("_s.r1"), F.col("_s.r2")))
            .select("file_name", "row_no", F.col("_s.tag").alias("_tag"),
                    (F.col("_s.r1") + header).alias("_hdr_row"),
                    F.transform(F.sequence(F.col("_s.c1"), F.col("_s.c2")),
                                lambda i: F.get(F.col("cells"), i)).alias("cells")))
    hdr = (cand.filter(F.col("row_no") == F.col("_hdr_row")).groupBy("file_name", "_tag")
           .agg(F.first("cells", ignorenulls=True).alias("_hdr")))
    if names is None:
        hdr = hdr.withColumn("_hdr", mangle_duplicates(name_blanks(F.col("_hdr"))))
        names = header_names(hdr, "_hdr")
    body = cand.filter(F.col("row_no") > F.col("_hdr_row")).join(hdr, ["file_name", "_tag"])
    cols = []
    for n in names:
        pos = F.array_position("_hdr", F.lit(n))
        cols.append(F.when(pos > 0, F.try_element_at("cells", pos.cast("int"))).alias(n))
    return body.select(F.col("file_name").alias(file_col), "row_no", *cols, F.col("_tag").alias(tag_col))


def read_range(rows: DataFrame, sheet: str, start: str, end: str, header: int = 0,
               names=None, file_col: str = "文件名") -> DataFrame:
    """Rectangle ``start:end`` of one sheet from many files, header row
    ``header`` of the range (A4); see :func:`read_ranges`."""
    return read_ranges(rows, [("_", sheet, start, end)], names, header, file_col).drop("table")


def used_range(rows: DataFrame) -> DataFrame:
    """Bounding box of the non-empty cells of every sheet."""
    # position of the last non-empty cell of each row
    last_col = F.array_max(F.filter(F.transform("cells", lambda v, i: F.when(v.isNotNull(), i)),
                                    lambda i: i.isNotNull()))
    r = rows.withColumn("_last", last_col).filter(F.col("_last").isNotNull())
    return r.groupBy("file_name", "sheet").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
                                               (F.max("_last") + 1).alias("n_cols"))


def read_used_range(rows: DataFrame, sheet: str | None = None, auto: bool = True) -> DataFrame:
    """Used range of a named sheet, or of each file's first sheet (needs the
    scan's ``sheet_idx``), optionally with the header detected (A7). Empty
    rows and cells are absent from sheet rows, so the used range is the rows
    themselves; :func:`used_range` reports its bounds."""
    if sheet is not None:
        picked = rows.filter(F.col("sheet") == sheet)
    else:
        if "sheet_idx" not in rows.columns:
            raise ValueError("first-sheet selection needs sheet_idx from the workbook scan")
        first = rows.groupBy("file_name").agg(F.min("sheet_idx").alias("_first"))
        picked = rows.join(first, "file_name").where(F.col("sheet_idx") == F.col("_first"))
    picked = picked.select("file_name", "sheet", "row_no", "cells")
    return auto_header(picked) if auto else picked


def auto_header(rows: DataFrame) -> DataFrame:
    """Header row = the first row with the fewest empty cells, the last row
    not eligible; body = rows after it, as long ``(file_name, sheet, row_no,
    col_name, value)`` with trimmed header texts (A6).

    One pass picks the header of every sheet: the rows of one sheet with equally many
    values are one group, whose first row stands for it (a sheet has at most one group
    a column). The groups know the sheet's last row; the fullest group that begins
    before it holds the header: a row with the fewest empty cells is one with the most
    values. Joined back, so no window spans a whole sheet."""
    filled = F.size(F.filter("cells", lambda v: v.isNotNull()))
    groups = rows.groupBy("file_name", "sheet", filled.alias("_filled")).agg(
        F.min(F.struct(F.col("row_no").alias("r"), F.col("cells").alias("c"))).alias("_first"), F.max("row_no").alias("_last"))
    ranked = F.struct((-F.col("_filled")).alias("n"), F.col("_first.r").alias("r"), F.col("_first.c").alias("c"))
    pick = groups.groupBy("file_name", "sheet").agg(F.max("_last").alias("_last"), F.array_sort(F.collect_list(ranked)).alias("_g"))
    pick = pick.withColumn("_m", F.get(F.filter("_g", lambda g: g["r"] < F.col("_last")), F.lit(0)))
    pick = pick.where("_m is not null").select("file_name", "sheet", F.col("_m.r").alias("_hdr_row"), F.col("_m.c").alias("_hdr"))
    body = rows.join(pick, ["file_name", "sheet"]).filter(F.col("row_no") > F.col("_hdr_row"))
    c = body.select("file_name", "sheet", "row_no", "_hdr", F.posexplode("cells").alias("col_no", "value"))
    return c.filter(F.col("value").isNotNull()).select(
        "file_name", "sheet", "row_no", strip_text(F.get(F.col("_hdr"), F.col("col_no"))).alias("col_name"), "value")


def filter_files(files: DataFrame, must: list | None = None, must_not: list | None = None,
                 name_col: str = "file_name") -> DataFrame:
    """File-name rules (A2): every ``must`` fragment present, no ``must_not``."""
    cond = F.lit(True)
    for m in must or []:
        cond = cond & F.coalesce(F.col(name_col).contains(m), F.lit(False))
    for m in must_not or []:
        cond = cond & not_contains(name_col, m)
    return files.filter(cond)


# ---------------------------------------------------------------------------
# Writing cells
# ---------------------------------------------------------------------------

def latest_updates(updates: DataFrame, keys=("file_name", "sheet", "row_no", "col_no")) -> DataFrame:
    """Last update wins per cell, by explicit ``seq`` (a row_number, not
    max_by, so a null new value is kept). Groups are per cell: tiny."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return updates.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "seq")


def apply_cell_updates(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """Set cells from ``updates(file_name, sheet, row_no, col_no, value, seq)``;
    other cells untouched; a null value clears the cell (B7). Full outer join
    on the cell key."""
    keys = ["file_name", "sheet", "row_no", "col_no"]
    u = latest_updates(updates).select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_upd"))
    e = existing.select(*keys, F.col("value").alias("_old"))
    j = e.join(u, keys, "full_outer")
    v = F.when(F.coalesce("_upd", F.lit(False)), F.col("_new")).otherwise(F.col("_old"))
    return j.select(*keys, v.alias("value"))


def rectangle(spark, start: str, end: str) -> DataFrame:
    """Every (row_no, col_no) of a fixed rectangle (its size is the bound)."""
    r1, c1 = parse_ref(start)
    r2, c2 = parse_ref(end)
    return spark.range(r1, r2 + 1).select(F.col("id").cast("int").alias("row_no"),
                                          F.explode(F.sequence(F.lit(c1), F.lit(c2))).alias("col_no"))


def template_block(template_rows: DataFrame, template_file: str, sheet: str, ranges) -> DataFrame:
    """Full rectangles of one template sheet, empty cells included, text
    prefixed with "'" (C22): ``(sheet, row_no, col_no, value)``."""
    spark = template_rows.sparkSession
    cells = to_cells(template_rows.filter((F.col("file_name") == template_file) & (F.col("sheet") == sheet)))
    blocks = None
    for start, end in ranges:
        b = rectangle(spark, start, end).join(cells.select("row_no", "col_no", "value"),
                                              ["row_no", "col_no"], "left")
        blocks = b if blocks is None else blocks.unionByName(b)
    return blocks.select(F.lit(sheet).alias("sheet"), "row_no", "col_no", as_text_label("value").alias("value"))


def overlay_block(existing: DataFrame, template_rows: DataFrame, template_file: str, sheet: str,
                  ranges, papers: DataFrame) -> DataFrame:
    """Copy label blocks of one template paper into every listed paper; text
    gets a leading "'"; nulls stay null and still overwrite (B8).

    The block is one array, bounded by its ranges: an uncorrelated subquery that runs
    inside the query, exploded per paper. So no join without a key, and no job while
    the query is built."""
    block = template_block(template_rows, template_file, sheet, ranges)
    cells = block.agg(F.collect_list(F.struct("row_no", "col_no", "value")).alias("_cells")).scalar()
    upd = (papers.select("file_name").distinct().withColumn("_cells", cells)
           .select("file_name", F.lit(sheet).alias("sheet"), F.inline("_cells")).withColumn("seq", F.lit(1)))
    return apply_cell_updates(existing, upd)


def update_papers(spark, path: str, updates: DataFrame, by: str = "file_name") -> None:
    """The cell updates (see :func:`apply_cell_updates`) applied to written papers, one
    folder a paper under ``path`` (B7): only the folders of papers with updates are
    read, and only they are replaced (dynamic partition overwrite); a paper that isn't
    there yet gets a folder. The new cells are written aside first, so that a paper is
    never read and replaced by one job."""
    part = f"{by}_part"
    schema = T.StructType.fromDDL(f"{by} string, sheet string, row_no int, col_no int, value string, {part} string")
    updates = written(updates, "cell-updates")
    touched = updates.select(F.col(by).alias(part)).distinct()
    held = spark.read.schema(schema).parquet(path).join(touched, part, "left_semi")  # pruned by the touched papers at run time
    new = written(apply_cell_updates(held, updates), "updated-papers")
    (new.withColumn(part, F.col(by)).hint("rebalance", part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))


def block_positions(block: DataFrame, order_cols=("file_name", "row_no"), by=()) -> DataFrame:
    """Global 0-based position of each block row in ``order_cols`` order (within each
    ``by`` group): a two-level prefix sum over the files' row counts
    (:func:`file_offsets`), joined back, plus a rank inside the file (bounded by the
    range height)."""
    by = list(by)
    first, second = order_cols
    counts = block.groupBy(*by, first).agg(F.count(F.lit(1)).alias("_n"))
    wi = Window.partitionBy(*by, first).orderBy(second)
    b = block.join(file_offsets(counts, first, by), by + [first])
    return b.withColumn("pos", (F.col("_off") + F.row_number().over(wi) - 1).cast("long")).drop("_off")


FILES_A_RANGE = 10_000


def file_offsets(counts: DataFrame, first: str, by=(), n: str = "_n") -> DataFrame:
    """``counts`` (by, first, n) with ``_off``, the sum of ``n`` of all files before, in
    order of ``first`` within ``by``. The files are cut into ranges of about
    FILES_A_RANGE; a window sums within a range, another over one total a range, and
    the offsets of the ranges are joined back. The ranges are written before both sums
    read them, as a range partitioning may be cut differently each time it is run."""
    by = list(by)
    counts = written(counts, "file-counts")
    ranges = 1 + counts.count() // FILES_A_RANGE
    if ranges > 1:
        cut = counts.repartitionByRange(ranges, *by, first).withColumn("_range", F.spark_partition_id())
        counts = written(cut, "file-ranges")
    else:
        counts = counts.withColumn("_range", F.lit(0))
    before = lambda *part: Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("_in", F.coalesce(F.sum(n).over(before(*by, "_range").orderBy(first)), F.lit(0)))
    totals = counts.groupBy(*by, "_range").agg(F.sum(n).alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before(*by).orderBy("_range")), F.lit(0))).drop("_total")
    return inner.join(totals, by + ["_range"]).select(*by, first, (F.col("_in") + F.col("_before")).alias("_off"))


def append_block(target: DataFrame, block_cells: DataFrame, anchor: str, sizes: DataFrame | None = None) -> DataFrame:
    """Insert ``n`` rows below the anchor row (cells at or below
    ``anchor_row + 1`` move down ``n``), then write the block from the
    anchor cell (G6), for every sheet at once.

    ``target(sheet, row_no, col_no, value)``: the sheets' cells;
    ``block_cells(sheet, pos, col_off, value)``: block row position and
    column offset. ``n`` per sheet is an aggregate joined on the sheet name;
    ``sizes(sheet, n)`` gives it where it is known from less than the cells."""
    ar, ac = parse_ref(anchor)
    start_row = ar + 1
    if sizes is None:
        sizes = block_cells.groupBy("sheet").agg((F.max("pos") + 1).alias("n"))
    n = sizes.select("sheet", F.col("n").alias("_n"))
    t = target.join(n, "sheet", "left")
    moved = t.select("sheet", F.when(F.col("row_no") >= start_row, F.col("row_no") + F.coalesce("_n", F.lit(0)))
                     .otherwise(F.col("row_no")).cast("long").alias("row_no"),
                     F.col("col_no").cast("int").alias("col_no"), "value")
    new = block_cells.select("sheet", (F.lit(ar) + F.col("pos")).cast("long").alias("row_no"),
                             (F.lit(ac) + F.col("col_off")).cast("int").alias("col_no"), "value")
    keys = ["sheet", "row_no", "col_no"]
    j = moved.select(*keys, F.col("value").alias("_old")).join(
        new.select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_w")), keys, "full_outer")
    return j.select(*keys, F.when(F.coalesce("_w", F.lit(False)), F.col("_new")).otherwise(F.col("_old"))
                    .alias("value"))


def name_blanks(hdr):
    """Header array with blank texts named by their position."""
    return F.transform(hdr, lambda x, i: F.when(F.coalesce(strip_text(x), F.lit("")) == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(x))


def mangle_duplicates(hdr):
    """Header array with repeats renamed ``name.1``, ``name.2``, … in order,
    as a header-row reader does (Column expression)."""
    def one(x, i):
        seen = F.size(F.filter(F.slice(hdr, 1, i), lambda y: y == x))
        return F.when(seen > 0, F.concat(x, F.lit("."), seen.cast("string"))).otherwise(x)
    return F.transform(hdr, one)


def read_sheet_table(rows: DataFrame, sheet: str | None, names=None) -> DataFrame:
    """A whole sheet as a table whose header is its first used row, repeated
    header texts mangled (``期末余额``, ``期末余额.1``); ``names`` defaults to the
    distinct header texts in column order. Per-file header from a small
    aggregate joined back; file name kept as ``file_name``. ``sheet=None``
    takes the rows as given (e.g. each file's first sheet)."""
    s = rows if sheet is None else rows.filter(F.col("sheet") == sheet)
    hdr = (s.groupBy("file_name").agg(F.min("row_no").alias("_h"), F.min_by("cells", "row_no").alias("_raw"))
           .select("file_name", "_h", mangle_duplicates(F.col("_raw")).alias("_hdr")))
    if names is None:
        names = header_names(hdr, "_hdr")
    body = s.join(hdr, "file_name").filter(F.col("row_no") > F.col("_h"))
    cols = []
    for n in names:
        pos = F.array_position("_hdr", F.lit(n))
        cols.append(F.when(pos > 0, F.try_element_at("cells", pos.cast("int"))).alias(n))
    return body.select("file_name", "row_no", *cols)
