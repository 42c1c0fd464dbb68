"""Order-dependent rules without single-task windows.

``number_rows`` gives exact dense row numbers by radix: rows are counted per cell
of a monotone coarsening of the order, cell offsets come from a window over the
*counts*, and only the rows of one cell are ever sorted together. ``first_row`` /
``last_row`` are aggregates with map-side combine, so a hot key costs one partial
row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    levels: Sequence[tuple[str, Column]],
    by: Sequence[str] = (),
    name: str = "row_no",
) -> DataFrame:
    """Dense 1-based number per ``by`` group in ``order``.

    ``levels`` are named expressions from coarse to fine; sorting by them must agree
    with ``order`` (each one is constant or rising along it), and they decide how many
    rows share one sort. The final tie break must make ``order`` total.
    """
    by = list(by)
    names = [n for n, _ in levels]
    keyed = df.select("*", *[e.alias(n) for n, e in levels])
    cells = keyed.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("__n"))
    # Level by level: a window only ever holds the values of one level inside one cell of the level above.
    offsets = None
    for depth in range(1, len(names) + 1):
        above, here = [*by, *names[: depth - 1]], names[depth - 1]
        level = cells.groupBy(*above, here).agg(F.sum("__n").alias("__t"))
        scope = (W.partitionBy(*above) if above else W.partitionBy(F.lit(0))).orderBy(here)
        before = F.coalesce(F.sum("__t").over(scope.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        level = level.select(*above, here, before.alias("__in"))
        if offsets is not None:
            level = lookup(level, offsets, above, ["__off"]).withColumn("__in", F.col("__in") + F.col("__off"))
        offsets = level.select(*above, here, F.col("__in").cast("bigint").alias("__off"))
    joined = lookup(keyed, offsets, [*by, *names], ["__off"])
    inside = W.partitionBy(*by, *names).orderBy(*order)
    return joined.withColumn(name, F.row_number().over(inside).cast("bigint") + F.col("__off")).drop(
        "__off", *names
    )


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Null-safe equi join that adds ``values`` of ``right`` to every row of ``left``."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *values)
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``."""
    return _edge_row(df, keys, order, F.min_by)


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in ``order``."""
    return _edge_row(df, keys, order, F.max_by)


def _edge_row(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    chosen = df.groupBy(*keys).agg(pick(row, F.struct(*[F.col(c) for c in order])).alias("__row"))
    return chosen.select(*keys, "__row.*").select(*df.columns)


def duplicate_sizes(df: DataFrame, keys: Sequence[str], name: str = "duplicate_group_size") -> DataFrame:
    """All rows of keys that occur more than once, with the group size.

    Sizes are aggregated first; the join back reads a small key list and leaves a hot
    key to the skew split of adaptive execution.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)
    return lookup(df, sizes, keys, [name])
