"""Strict matrix path: plain finance equality, wildcards only on the mentor side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRICT = ("group_code", "gender_code", "grad_status_code", "finance_code")


def capacity_outcome(df: DataFrame) -> DataFrame:
    """Effective limit, totals and the codes that block a mentor."""
    zero = F.lit(0).cast("bigint")
    col = lambda c: F.coalesce(F.col(c).cast("bigint"), zero) if c in df.columns else zero
    frozen = F.coalesce(F.col("capacity_frozen"), F.lit(False)) if "capacity_frozen" in df.columns else F.lit(False)
    limit = col("capacity_limit")
    total = col("assigned_baseline") + col("allocations_new")
    remaining = limit + F.greatest(col("capacity_special"), zero) - total
    codes = F.array_compact(
        F.array(
            F.when(limit <= 0, F.lit("capacity_limit_missing")),
            F.when(frozen, F.lit("capacity_frozen")),
            F.when(remaining <= 0, F.lit("capacity_exhausted")),
        )
    )
    return (
        df.withColumn("remaining_capacity", remaining)
        .withColumn("total_allocations", total)
        .withColumn("blocking_codes", codes)
        .withColumn("capacity_ok", F.size("blocking_codes") == 0)
    )


def strict_trace(df: DataFrame) -> DataFrame:
    """Add the stage trace of eligible rows: every stage passes but the capacity gate, which the row decides alone."""
    gate = F.when(F.col("capacity_ok"), F.lit("ok")).otherwise(F.lit("blocked"))
    stages = ("group", "gender", "graduation_status", "center", "finance", "school")
    entry = lambda a, b: F.struct(F.lit(a).alias("stage"), b.alias("status"))
    return df.withColumn(
        "trace",
        F.array(entry("type", F.lit("matrix_core")), *[entry(x, F.lit("ok")) for x in stages], entry("capacity_gate", gate)),
    )


def trace_pivot(df: DataFrame, stages) -> DataFrame:
    """Eight columns from the (stage, status) array; absent stages are ''."""
    m = F.map_from_entries("trace")
    return df.select(
        *[c for c in df.columns if c != "trace"],
        *[F.coalesce(F.element_at(m, F.lit(s)), F.lit("")).alias(s) for s in stages],
    )
