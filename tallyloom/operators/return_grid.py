"""The return grid: one wide row of named cells for each filing, its formulas and its checks.

Column names are section and cell, such as ``ii_f6``. A missing or null cell counts as 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAKH = 100_000.0
TOLERANCE = 0.01
#: Rows of the grid that hold the non-resident buckets.
HOLDER_ROWS = range(12, 23)


def _cells(df: DataFrame):
    return lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _add(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    return df.withColumns(cells)


def _capital(grid: DataFrame) -> DataFrame:
    v = _cells(grid)
    grid = _add(grid, {f"ii_{c}6": v(f"ii_{c}7") + v(f"ii_{c}8") for c in "defg"})
    v = _cells(grid)
    return _add(grid, {f"ii_{c}5": v(f"ii_{c}6") + v(f"ii_{c}9") for c in "defg"})


def _sums(v) -> dict[str, Column]:
    made = {f"ii_{a}41": v(f"ii_{a}39") + v(f"ii_{a}40") for a in "fg"}
    made |= {f"iii_{c}74": reduce(Column.__add__, [v(f"iii_{c}{r}") for r in range(70, 74)]) for c in "de"}
    made |= {f"iv_{c}30": v(f"iv_{c}26") + v(f"iv_{c}28") for c in "de"}
    return made | {f"iv_{c}100": reduce(Column.__add__, [v(f"iv_{c}{r}") for r in range(96, 100)]) for c in "de"}


def reconcile(grid: DataFrame, supplied: DataFrame, only_supplied: tuple[str, ...] = ()) -> DataFrame:
    """The grid with supplied cells in place of its own, and the totals that follow from them.

    supplied has filing_id, once each, and cells; null is not supplied. Net worth supplied as ii_f34 and
    ii_g34 stays; else it is capital and reserves. Cells of only_supplied are 0 unless supplied.
    """
    own, cells = [c for c in grid.columns if c != "filing_id"], [c for c in supplied.columns if c != "filing_id"]
    given = supplied.select("filing_id", *[F.col(c).cast("double").alias(f"__{c}") for c in cells])
    joined = grid.join(given, "filing_id", "left")

    def cell(c: str) -> Column:
        before = F.lit(0.0) if c in only_supplied else F.col(c) if c in own else F.lit(None).cast("double")
        return (F.coalesce(F.col(f"__{c}"), before) if c in cells else before).alias(c)

    every = list(dict.fromkeys([*own, *cells, *only_supplied]))
    merged = _capital(joined.select("filing_id", *[cell(c) for c in every], *[F.col(f"__{c}") for c in cells]))
    v = _cells(merged)
    worth = {f"ii_{a}34": F.coalesce(F.col(f"__ii_{a}34") if f"ii_{a}34" in cells else F.lit(None), v(f"ii_{a}6") + v(f"ii_{a}32")) for a in "fg"}
    return _add(merged, worth | _sums(v)).drop(*[f"__{c}" for c in cells])


def formulas(grid: DataFrame) -> DataFrame:
    """Adds the cells that are computed: capital sums, shares of non-residents, net worth, purchases and overseas totals.

    The stated net worth (net_worth_py, net_worth_fy) counts if it is above 0.
    """
    grid = _capital(grid)
    v = _cells(grid)
    pairs = (("d", "f"), ("e", "g"))  # shares and amounts of the previous and of this year
    grid = _add(grid, {f"ii_{a}{r}": F.when(v(f"ii_{s}6") > 0, v(f"ii_{s}{r}") / v(f"ii_{s}6") * v(f"ii_{a}6")).otherwise(0.0) for s, a in pairs for r in HOLDER_ROWS})
    v = _cells(grid)
    grid = _add(grid, {f"ii_{a}11": reduce(Column.__add__, [v(f"ii_{a}{r}") for r in HOLDER_ROWS]) for a in "fg"})
    v = _cells(grid)
    made = {f"ii_{a}24": F.when(v(f"ii_{a}6") > 0, v(f"ii_{a}11") / v(f"ii_{a}6") * 100).otherwise(0.0) for a in "fg"}
    made |= {f"ii_{a}30": v(f"ii_{a}27") - v(f"ii_{a}28") - v(f"ii_{a}29") for a in "fg"}
    made |= {f"ii_{a}34": F.when(v(f"net_worth_{p}") > 0, v(f"net_worth_{p}")).otherwise(v(f"ii_{a}6") + v(f"ii_{a}32")) for a, p in (("f", "py"), ("g", "fy"))}
    made |= _sums(v)
    made |= {f"iv_{c}39": v(f"iv_{c}27") * v(f"iv_{c}31") / LAKH for c in "de"}
    made |= {f"iv_{c}42": v(f"iv_{c}43") - v(f"iv_{c}44") for c in "de"}
    return _add(grid, made)


def checks(grid: DataFrame, keys: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """Keys, check and passed: eight consistency checks of the previous year's column."""
    v = _cells(grid)
    near = lambda a, b: F.abs(a - b) < TOLERANCE
    share = F.when(v("ii_f6") > 0, v("ii_f11") / v("ii_f6") * 100).otherwise(0.0)
    tests = {
        "equity_capital": near(v("ii_f7"), v("ii_d7") * v("i_c26") / LAKH),
        "paid_up_capital": near(v("ii_f5"), v("ii_f6") + v("ii_f9")),
        "nonresident_percent": near(v("ii_f24"), share),
        "retained_profit": near(v("ii_f30"), v("ii_f27") - v("ii_f28") - v("ii_f29")),
        "net_worth": near(v("ii_f34"), v("ii_f6") + v("ii_f32")),
        "purchases": near(v("ii_f41"), v("ii_f39") + v("ii_f40")),
        "direct_investors": F.coalesce(v("iii_d6"), F.lit(1.0)) >= 0,
        "overseas_net_worth": near(v("iv_d30"), v("iv_d26") + v("iv_d28")),
    }
    made = F.array(*[F.struct(F.lit(n).alias("check"), t.alias("passed")) for n, t in tests.items()])
    return grid.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*")


def long_form(grid: DataFrame, cells: list[str], keys: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """Keys, coord and value, one row for each cell."""
    made = F.array(*[F.struct(F.lit(c).alias("coord"), F.col(c).cast("double").alias("value")) for c in cells])
    return grid.select(*keys, F.explode(made).alias("c")).select(*keys, "c.*")
