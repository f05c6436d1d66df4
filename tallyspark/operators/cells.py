"""Cell amounts: rules joined to long balances, summed per working-paper cell,
translated by sheet rate, with the expense-sheet zeroing rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.operators.joins import values_of
from tallyspark.schemas import (AVERAGE_RATE_SHEETS, CLOSING_RATE_SHEETS, MONEY, RATE,
                                SHEET_EXPENSE)


def job_grid(long: DataFrame, parts: DataFrame, keys=("company",), companies: DataFrame | None = None,
             sheets=None) -> DataFrame:
    """``(keys..., sheet)``: every company gets every selected sheet.

    The sheet list (the rule sheets by default) is exploded per company: no
    join without a key."""
    keys = list(keys)
    comp = companies if companies is not None else long.select(*keys).distinct()
    names = values_of(parts, "sheet") if sheets is None else F.array(*[F.lit(s) for s in sheets]).cast("array<string>")
    return comp.select(*keys, names.alias("_sheets")).select(*keys, F.explode("_sheets").alias("sheet"))


def join_rules_balances(long: DataFrame, parts: DataFrame, keys=("company",),
                        companies: DataFrame | None = None, sheets=None) -> DataFrame:
    """Rules LEFT JOIN long balances on (code, item), per company.

    Every rule part appears once per company, with ``amount`` null when no
    balance matches. The balance side is first narrowed to the rules'
    (code, item) pairs by a semi join, so only matching rows reach the
    shuffle of the outer join."""
    keys = list(keys)
    grid = job_grid(long, parts, keys, companies, sheets).join(parts, "sheet")
    pairs = parts.select("acct_code", "item").distinct()
    narrowed = (long.select(*keys, "acct_code", "item", "amount")
                .join(pairs, ["acct_code", "item"], "left_semi"))
    return grid.join(narrowed, keys + ["acct_code", "item"], "left")


def sheet_rates(closing_rate, average_rate) -> list:
    """``(sheet, rate)`` rows for the fixed sheet-to-rate rule; other sheets
    (including the expense and statement sheets) use 1."""
    rows = [(s, closing_rate) for s in CLOSING_RATE_SHEETS]
    rows += [(s, average_rate) for s in AVERAGE_RATE_SHEETS]
    return rows


def cell_amounts(long: DataFrame, parts: DataFrame, rates: DataFrame | None = None,
                 keys=("company",), companies: DataFrame | None = None, sheets=None) -> DataFrame:
    """``round(sum(amount * sign), 2)`` per (company, sheet, cell); no match
    gives 0; times the sheet rate; rounded again (E2 + G1). ``rates`` is
    ``(sheet, rate)`` or, per entity, ``(company, sheet, rate)``.

    ``companies`` names those that get every rule cell; without it they are the
    companies of ``long`` (see :func:`_cells_of_companies`)."""
    keys = list(keys)
    if companies is None:
        out = _cells_of_companies(long, parts if sheets is None else parts.filter(F.col("sheet").isin(list(sheets))), keys)
    else:
        matched = (long.select(*keys, "acct_code", "item", "amount")
                   .join(parts, ["acct_code", "item"])
                   .groupBy(*keys, "sheet", "cell")
                   .agg(F.sum(F.col("amount") * F.col("sign")).alias("_raw")))
        cells = parts.select("sheet", "cell").distinct()
        grid = job_grid(long, parts, keys, companies, sheets).join(cells, "sheet")
        out = grid.join(matched, keys + ["sheet", "cell"], "left")
    base = F.coalesce(F.round("_raw", 2), F.lit(0).cast(MONEY))
    if rates is not None:
        # rates by sheet, or by (company, sheet) when the table carries the keys
        on = [k for k in keys if k in rates.columns] + ["sheet"]
        out = out.join(rates.select(*on, F.col("rate").cast(RATE).alias("_rate")), on, "left")
        rate = F.coalesce(F.col("_rate"), F.lit(1).cast(RATE))
    else:
        rate = F.lit(1).cast(RATE)
    return out.select(*keys, "sheet", "cell",
                      F.round(base * rate, 2).cast(MONEY).alias("amount"))


def _cells_of_companies(long: DataFrame, parts: DataFrame, keys: list) -> DataFrame:
    """``(keys..., sheet, cell, _raw)``: the sum of each rule cell of each company of
    ``long``, null where nothing matches, in one pass over the balances.

    Rows without a rule stay, under no cell: they collapse to one row a company in the
    partial aggregate, which so brings the companies along. The sums of a company
    (bounded by the rule table) then meet on its key, the cells that matched nothing
    are added to them from an array of all rule cells, and what follows by company and
    sheet needs no other shuffle."""
    sums = (long.select(*keys, "acct_code", "item", "amount").join(parts, ["acct_code", "item"], "left")
            .groupBy(*keys, "sheet", "cell").agg(F.sum(F.col("amount") * F.col("sign")).alias("_raw")))
    raw = sums.schema["_raw"].dataType
    cells = parts.select("sheet", "cell").distinct().select(F.struct("sheet", "cell", F.lit(None).cast(raw).alias("_raw")).alias("c"))
    every = cells.agg(F.collect_list("c").alias("_cells")).scalar()
    by_company = sums.groupBy(*keys).agg(F.collect_list(F.struct("sheet", "cell", "_raw")).alias("_sums"))
    both = by_company.select(*keys, F.inline(F.concat("_sums", every))).filter(F.col("sheet").isNotNull())
    return both.groupBy(*keys, "sheet", "cell").agg(F.max("_raw").alias("_raw"))


def conditional_zero(cells: DataFrame, keys=("company",), sheet: str = SHEET_EXPENSE) -> DataFrame:
    """On the expense sheet: if the sum of E31..E49 is not 0 then E30 := 0,
    else if the sum of E142..E147 is not 0 then E141 := 0 (E6).

    The two sums are windowed over (company, sheet): a group is one sheet of
    one company's cells, bounded by the rule table's cell count, so the
    window never holds more than one paper sheet (and no self-join re-runs
    the cell pipeline)."""
    keys = list(keys)
    r1 = [f"E{i}" for i in range(31, 50)]
    r2 = [f"E{i}" for i in range(142, 148)]
    w = Window.partitionBy(*keys, "sheet")
    s1 = F.coalesce(F.sum(F.when(F.col("cell").isin(r1), F.col("amount"))).over(w), F.lit(0))
    s2 = F.coalesce(F.sum(F.when(F.col("cell").isin(r2), F.col("amount"))).over(w), F.lit(0))
    on_sheet = F.col("sheet") == sheet
    zero = on_sheet & (((s1 != 0) & (F.col("cell") == "E30"))
                       | ((s1 == 0) & (s2 != 0) & (F.col("cell") == "E141")))
    amount = F.when(zero, F.lit(0).cast(MONEY)).otherwise(F.col("amount"))
    return cells.select(*keys, "sheet", "cell", amount.alias("amount"))
