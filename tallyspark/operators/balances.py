"""Account-balance shaping: positional readers over sheet rows, prefix
roll-up, unpivot to the long ``(item, amount)`` form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyspark.functions.exprs import strip_text

from tallyspark.schemas import (HEADER_OF, LAYOUT_A_AMOUNTS, LAYOUT_A_BANNER_ROWS,
                                LAYOUT_A_COLUMNS, LAYOUT_B_AMOUNTS, LAYOUT_B_COLUMNS, MONEY)


def unpivot_amounts(wide: DataFrame, amount_cols, keep_cols, labels: dict | None = None,
                    drop_nulls: bool = True) -> DataFrame:
    """Wide amounts -> ``(keep..., item, amount)``.

    ``drop_nulls=True`` is SQL ``UNPIVOT`` semantics (null values vanish);
    ``False`` is a melt that keeps them. ``item`` carries the source header
    label of each column so user rule tables match unchanged.
    """
    labels = labels or {}
    long = wide.unpivot(ids=list(keep_cols), values=list(amount_cols),
                        variableColumnName="_col", valueColumnName="amount")
    mapping = F.create_map(*[x for c in amount_cols for x in (F.lit(c), F.lit(labels.get(c, c)))])
    long = long.withColumn("item", mapping[F.col("_col")]).drop("_col")
    if drop_nulls:
        long = long.filter(F.col("amount").isNotNull())
    return long.select(*keep_cols, "item", "amount")


def unpivot_a(bal_a: DataFrame, keys=("company",), drop_nulls: bool = True) -> DataFrame:
    """Layout A: 10 amount columns -> long, nulls dropped (F1)."""
    keep = list(keys) + ["acct_code", "acct_name", "open_dir", "close_dir"]
    return unpivot_amounts(bal_a, LAYOUT_A_AMOUNTS, keep, HEADER_OF, drop_nulls)


def unpivot_b(bal_b: DataFrame, keys=("company",), drop_nulls: bool = True) -> DataFrame:
    """Layout B: 8 amount columns -> long, nulls dropped (F2). Layout B has
    no direction columns; they are null so both layouts share one shape."""
    keep = list(keys) + ["acct_code", "acct_name", "currency", "local_currency"]
    return unpivot_amounts(bal_b, LAYOUT_B_AMOUNTS, keep, HEADER_OF, drop_nulls)


def rolled_rows(bal_b: DataFrame, n: int = 6, skip_existing: bool = False) -> DataFrame:
    """Detail rows, and each once more under its code of ``n`` characters: the rows of
    :func:`prefix_rollup` before they are summed. For flows that sum by account
    anyway: one scan, and no shuffle of their own."""
    return _both_grains(bal_b, n, skip_existing).drop("_total")


def _both_grains(bal_b: DataFrame, n: int, skip_existing: bool) -> DataFrame:
    """Each row at its own grain and (``_total``) at that of its prefix."""
    grain = lambda code, name, total: F.struct(code.alias("acct_code"), name.alias("acct_name"), F.lit(total).alias("_total"))
    both = F.array(grain(F.col("acct_code"), F.col("acct_name"), False),
                   grain(F.substring("acct_code", 1, n), F.split_part(F.col("acct_name"), F.lit("-"), F.lit(1)), True))
    if skip_existing:
        both = F.slice(both, F.lit(1), F.when(F.length("acct_code") > n, 2).otherwise(1))
    rest = [c for c in bal_b.columns if c not in ("acct_code", "acct_name")]
    return bal_b.select(*rest, F.inline(both)).select(*bal_b.columns, "_total")


def prefix_rollup(bal_b: DataFrame, n: int = 6, keys=("company",),
                  skip_existing: bool = False) -> DataFrame:
    """Detail rows plus sums by ``left(code, n)``, first name part, currency
    and local currency (E1). The source appends the totals without checking
    whether a code is already ``n`` long, so such a code counts twice; pass
    ``skip_existing=True`` to total only longer codes."""
    keys = list(keys)
    amounts = [c for c, _ in LAYOUT_B_COLUMNS if c.startswith(("fc_", "lc_"))]
    cols = keys + [c for c, _ in LAYOUT_B_COLUMNS]
    rows = _both_grains(bal_b.select(*cols).withColumn("_row", F.monotonically_increasing_id()), n, skip_existing)
    # one scan: a detail row is a group of its own by its row, a total by its prefix
    row = F.when(~F.col("_total"), F.col("_row")).alias("_row")
    sums = rows.groupBy(*[c for c in cols if c not in amounts], row).agg(*[F.sum(c).cast(MONEY).alias(c) for c in amounts])
    return sums.select(*cols)


# ---------------------------------------------------------------------------
# Readers over sheet rows ``(file_name, sheet, row_no, cells ARRAY<STRING>)``.
# ---------------------------------------------------------------------------

def single_sheet_files(rows: DataFrame) -> DataFrame:
    """Per file: number of non-empty sheets and whether the file is usable
    (A10). The source raises on more than one; here it is a quarantine list."""
    return (rows.groupBy("file_name")
            .agg(F.countDistinct("sheet").alias("n_sheets"))
            .withColumn("ok", F.col("n_sheets") == 1))


def check_single_sheet(bounds: DataFrame, observation: Observation | None = None, failing: bool = False) -> DataFrame:
    """Files with one non-empty sheet, from per-file aggregates with ``_n_sheets`` (A10).
    What is left out is measured while the same pass runs: ``observation`` receives
    files, sheets and violations. With ``failing`` the job stops at the first file of
    several sheets, as the source does."""
    if observation is not None:
        bounds = bounds.observe(observation, F.count(F.lit(1)).alias("files"), F.sum("_n_sheets").alias("sheets"),
                                F.count_if(F.col("_n_sheets") > 1).alias("violations"))
    if failing:
        told = F.raise_error(F.concat(F.lit("more than one non-empty sheet: "), F.col("file_name")))
        return bounds.filter(F.when(F.col("_n_sheets") > 1, told.cast("boolean")).otherwise(F.lit(True)))
    return bounds.filter(F.col("_n_sheets") == 1)


def read_balance_a(rows: DataFrame, record_path: bool = False, observation: Observation | None = None,
                   failing: bool = False) -> DataFrame:
    """Layout A: drop the 4 banner rows and the last row of each file, name the
    14 positional columns, amounts to DECIMAL(18,2) (A8). Files with more
    than one non-empty sheet are left out (see :func:`single_sheet_files`).

    Banner rows are the first four rows of the sheet, used or not; the trailer
    is the greatest row number. One per-file aggregate (sheet count, last row;
    partial aggregation, no window over a whole file) is joined back: two passes
    over the rows. With ``record_path``, ``file_path`` is the file's path where the
    rows carry one. ``observation`` and ``failing``: see :func:`check_single_sheet`."""
    bounds = (rows.groupBy("file_name")
              .agg(F.countDistinct("sheet").alias("_n_sheets"), F.max("row_no").alias("_last")))
    body = rows.join(check_single_sheet(bounds, observation, failing), "file_name")
    body = body.filter((F.col("row_no") > LAYOUT_A_BANNER_ROWS)
                       & (F.col("row_no") < F.col("_last")))
    out = [F.col("file_name").alias("company")]
    for i, (c, h) in enumerate(LAYOUT_A_COLUMNS):
        v = F.get(F.col("cells"), i)
        out.append((v.cast(MONEY) if "金额" in h else v).alias(c))
    if record_path:
        out.append(F.col("path" if "path" in rows.columns else "file_name").alias("file_path"))
    return body.select(*out)


def read_balance_b(rows: DataFrame, record_path: bool = False, observation: Observation | None = None,
                   failing: bool = False) -> DataFrame:
    """Layout B: header in the first row, keep rows with a code, numeric cast
    (A9). Columns are located by header text, so their order may vary. The
    header array comes out of the same per-file aggregate as the sheet count
    (``min_by``), so the rows are read twice, not four times."""
    hdr = (rows.groupBy("file_name")
           .agg(F.countDistinct("sheet").alias("_n_sheets"), F.min("row_no").alias("_hdr_row"),
                F.min_by("cells", "row_no").alias("_hdr")))
    body = rows.join(check_single_sheet(hdr, observation, failing), "file_name").filter(F.col("row_no") > F.col("_hdr_row"))
    out = [F.col("file_name").alias("company")]
    for c, h in LAYOUT_B_COLUMNS:
        pos = F.array_position(F.transform("_hdr", lambda x: strip_text(x)), F.lit(h))
        v = F.when(pos > 0, F.try_element_at("cells", pos.cast("int")))
        out.append((v.cast(MONEY) if c.startswith(("fc_", "lc_")) else v).alias(c))
    if record_path:
        out.append(F.col("path" if "path" in rows.columns else "file_name").alias("file_path"))
    return body.select(*out).filter(F.col("acct_code").isNotNull())
