"""Capacity fields, gates and pool governance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy
from matchloom.functions import text
from matchloom.operators.numbering import first_row

ZERO = 0


def _n(c) -> Column:
    return F.coalesce(text.as_col(c).cast("bigint"), F.lit(ZERO).cast("bigint"))


def capacity_fields(df: DataFrame) -> DataFrame:
    """Limit, baseline, new -> total and remaining, clipped at zero.

    When every limit is zero the legacy rule applies: limit = remaining + new. The choice
    needs one global maximum, joined back as a single row.
    """
    base = df
    for c in ("capacity_limit", "assigned_baseline", "allocations_new", "remaining_capacity"):
        base = base.withColumn(c, F.greatest(_n(c), F.lit(ZERO).cast("bigint")) if c in df.columns else _n(F.lit(0)))
    top = base.agg(F.coalesce(F.max("capacity_limit"), F.lit(0)).alias("__top"))
    out = base.join(F.broadcast(top))
    limit = F.when(F.col("__top") == 0, F.col("remaining_capacity") + F.col("allocations_new")).otherwise(
        F.col("capacity_limit")
    )
    total = F.col("assigned_baseline") + F.col("allocations_new")
    return (
        out.withColumn("capacity_limit", limit)
        .withColumn("total_allocations", total)
        .withColumn("remaining_capacity", F.greatest(F.col("capacity_limit") - total, F.lit(ZERO).cast("bigint")))
        .drop("__top")
    )


def gate_keeps(current: str, special: str) -> Column:
    """The condition of ``capacity_gate``."""
    zero = _n(F.lit(0))
    return F.coalesce(text.numlike_long(current), zero) < F.coalesce(text.numlike_long(special), zero)


def names_mentor(mentor: str = "mentor_id") -> Column:
    return F.trim(F.coalesce(F.col(mentor).cast("string"), F.lit(""))) != ""


def capacity_gate(df: DataFrame, current: str, special: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keep rows with current < special; removed rows carry the reason; metrics are one row.

    A missing column skips the gate.
    """
    if current not in df.columns or special not in df.columns:
        none = df.where(F.lit(False)).withColumn("reason", F.lit(""))
        metrics = df.agg(
            F.lit(0).cast("bigint").alias("total_removed"),
            F.lit(0).cast("bigint").alias("special_capacity_lost"),
            F.lit(1.0).alias("percent_pool_kept"),
        )
        return df, none, metrics
    spec, keep = F.coalesce(text.numlike_long(special), _n(F.lit(0))), gate_keeps(current, special)
    metrics = df.agg(
        F.count_if(~keep).cast("bigint").alias("total_removed"),
        F.coalesce(F.sum(F.when(~keep, spec)), F.lit(0)).cast("bigint").alias("special_capacity_lost"),
        F.coalesce(F.avg(keep.cast("double")), F.lit(1.0)).alias("percent_pool_kept"),
    )
    removed = df.where(~keep).withColumn("reason", F.lit("covered >= special limit"))
    return df.where(keep), removed, metrics


def invalid_mentors(df: DataFrame, mentor: str = "mentor_id", remaining: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rows, removed rows with reason): empty id, then negative remaining."""
    empty = ~names_mentor(mentor)
    negative = F.coalesce(F.col(remaining) < 0, F.lit(False)) if remaining else F.lit(False)
    reason = F.when(empty, F.lit("missing mentor employee code")).when(
        negative, F.lit("negative remaining capacity")
    )
    tagged = df.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def is_virtual(name, alias=None, policy: Policy | None = None) -> Column:
    """Name matches a configured pattern, or alias lies in the virtual range."""
    policy = policy or Policy()
    joined = "|".join(f"(?:{p})" for p in policy.virtual_name_patterns)
    out = F.coalesce(text.as_col(name).cast("string").rlike(f"(?i){joined}"), F.lit(False))
    if alias is not None:
        lo, hi = policy.virtual_alias_range
        out = out | F.coalesce(text.as_col(alias).cast("bigint").between(lo, hi), F.lit(False))
    return out


# Spellings of mentor status.
STATUS_WORDS = {
    "ACTIVE": ("active",),
    "FROZEN": ("frozen",),
    "INACTIVE": ("inactive",),
}


def canonical_status(c) -> Column:
    """Canonical mentor status; null for blanks and unknown words."""
    s = F.lower(F.trim(text.as_col(c).cast("string")))
    out = None
    for name, words in STATUS_WORDS.items():
        out = F.when(s.isin(*words), F.lit(name)) if out is None else out.when(s.isin(*words), F.lit(name))
    return out


def status_issues(df: DataFrame, status: str, policy: Policy | None = None) -> DataFrame:
    """Rows whose status is unknown or outside the allowed set."""
    policy = policy or Policy()
    raw = F.trim(F.coalesce(F.col(status).cast("string"), F.lit("")))
    canon = canonical_status(status)
    code = F.when((raw != "") & canon.isNull(), F.lit("UNKNOWN_STATUS")).when(
        canon.isNotNull() & ~canon.isin(*policy.allowed_statuses), F.lit("STATUS_NOT_ALLOWED")
    )
    return df.withColumn("issue", code).where(F.col("issue").isNotNull())


def _one_per_mentor(df: DataFrame, column: str, name: str, order: str | None) -> DataFrame:
    """(mentor_id, name): the last row by ``order``; without an order, repeats must agree or the job fails."""
    if order is not None:
        return df.groupBy("mentor_id").agg(F.max_by(column, order).alias(name))
    grouped = df.groupBy("mentor_id").agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    differ = F.raise_error(F.concat(F.lit(f"several values of {column} for mentor "), F.col("mentor_id").cast("string")))
    return grouped.select("mentor_id", F.when(F.col("__lo") != F.col("__hi"), differ).otherwise(F.col("__hi")).alias(name))


def effective_status(
    mentors: DataFrame, policy_status: DataFrame | None = None, overrides: DataFrame | None = None,
    status: str | None = None, policy: Policy | None = None, order: str | None = None, on_invalid: str = "raise",
) -> DataFrame:
    """Add ``effective_status``: override > policy map > row status > default.

    ``policy_status`` is (mentor_id, status), ``overrides`` is (mentor_id, enabled); of rows that
    repeat a mentor the last one by their column ``order`` counts, without an order differing
    repeats fail. An unknown status, or one outside the policy's allowed set, fails the job;
    with ``on_invalid="ignore"`` unknown ones count as absent (see ``status_issues``). Both are plain left joins; the
    optimizer broadcasts them only when their measured size allows it.
    """
    policy = policy or Policy()
    out = mentors
    row = canonical_status(status) if status else F.lit(None).cast("string")
    from_policy = from_override = F.lit(None).cast("string")
    if policy_status is not None:
        named = policy_status.withColumn("__policy_status", canonical_status("status"))
        out = out.join(_one_per_mentor(named, "__policy_status", "__policy_status", order), "mentor_id", "left")
        from_policy = F.col("__policy_status")
    if overrides is not None:
        out = out.join(_one_per_mentor(overrides, "enabled", "__enabled", order), "mentor_id", "left")
        from_override = F.when(F.col("__enabled"), F.lit("ACTIVE")).when(~F.col("__enabled"), F.lit("INACTIVE"))
    value = F.coalesce(from_override, from_policy, row, F.lit(policy.default_status))
    if on_invalid == "raise":
        allowed = lambda c: c.isNull() | c.isin(*policy.allowed_statuses)
        known = F.lit(True) if status is None else row.isNotNull() | (F.trim(F.coalesce(F.col(status).cast("string"), F.lit(""))) == "")
        wrong = F.raise_error(F.concat(F.lit("status unknown or not allowed for mentor "), F.col("mentor_id").cast("string")))
        value = F.when(known & allowed(row) & allowed(from_policy) & allowed(value), value).otherwise(wrong)
    return out.withColumn("effective_status", value).drop("__policy_status", "__enabled")


def active_mentors(mentors: DataFrame, remaining: str = "remaining_capacity") -> DataFrame:
    """ACTIVE rows with places left."""
    return mentors.where((F.col("effective_status") == "ACTIVE") & (F.col(remaining) > 0))


def pool_governance(
    pool: DataFrame, order: str, policy_status: DataFrame | None = None, overrides: DataFrame | None = None,
    keys: Sequence[str] = KEYS, status: str | None = None, policy: Policy | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Dedupe profiles (first wins), keep ACTIVE, keep places > 0.

    The second table has one row per stage: rows before, after, removed, removed by reason.
    """
    profile = ["mentor_id", *[k for k in keys if k in pool.columns]]
    unique = first_row(pool, profile, [order])
    tagged = effective_status(unique, policy_status, overrides, status, policy)
    base = effective_status(unique, policy_status, None, status, policy).select(
        *profile, F.col("effective_status").alias("__base")
    ) if overrides is not None else None
    if base is not None:
        cond = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in profile]
        base = base.select(*[F.col(k).alias(f"__b_{k}") for k in profile], "__base")
        tagged = tagged.join(base, cond).drop(*[f"__b_{k}" for k in profile])
    else:
        tagged = tagged.withColumn("__base", F.col("effective_status"))
    active = F.col("effective_status") == "ACTIVE"
    room = F.col("remaining_capacity") > 0
    raw = pool.agg(F.count(F.lit(1)).alias("raw_rows"))
    one = tagged.agg(
        F.count(F.lit(1)).alias("unique_rows"),
        F.count_if(active).alias("active_rows"),
        F.count_if(active & room).alias("final_rows"),
        F.count_if(~active & (F.col("__base") == "ACTIVE")).alias("by_override"),
    ).join(F.broadcast(raw))
    stages = one.selectExpr(
        "stack(3,"
        " 'deduplicate_profiles', raw_rows, unique_rows, raw_rows - unique_rows, 0L, 0L, 0L,"
        " 'status_filter', unique_rows, active_rows, 0L, unique_rows - active_rows - by_override, by_override, 0L,"
        " 'capacity_filter', active_rows, final_rows, 0L, 0L, 0L, active_rows - final_rows)"
        " AS (stage, rows_before, rows_after, duplicates_removed, inactive_removed, override_removed, capacity_removed)"
    )
    return tagged.where(active & room).drop("__base"), stages


def manager_governance(pool: DataFrame, disabled: DataFrame, manager: str = "manager") -> DataFrame:
    """Drop mentors of disabled managers (compared folded)."""
    off = disabled.select(text.norm_text(manager).alias("__m")).distinct()
    return pool.withColumn("__m", text.norm_text(manager)).join(off, "__m", "left_anti").drop("__m")


def mentor_profiles(pool: DataFrame, order: str, keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """Profiles per mentor: all, usable (one profile), exact duplicates, multi-profile mentors."""
    profile = ["mentor_id", *keys]
    sizes = pool.groupBy(*profile).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first_order"))
    per_mentor = sizes.groupBy("mentor_id").agg(
        F.count(F.lit(1)).alias("profiles"), F.sum("copies").alias("rows")
    )
    return {
        "profiles": sizes,
        "per_mentor": per_mentor,
        "duplicates": sizes.where(F.col("copies") > 1),
        "multi": per_mentor.where(F.col("profiles") > 1),
        "usable": sizes.join(per_mentor.where(F.col("profiles") == 1).select("mentor_id"), "mentor_id", "left_semi"),
    }
