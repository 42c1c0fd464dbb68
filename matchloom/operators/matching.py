"""Eligibility at table scale: wildcard rules rewritten as equi-join buckets.

A pool row and a student match when they share a bucket ``group|gender|status|center|
finance|school``. The wildcard and set rules are resolved by giving each side a few
alternative keys:

* center: pool row -> its code and '*'; student -> '*' when null, '0' when 0, else {'0', code}
* school: restricted pool row -> 'R:code'; unrestricted -> 'U' and 'U:code'; both also '*'.
  Student -> '*' when null, 'U' when 0, else {'R:code', 'U:0', 'U:code'}
* finance: both sides -> cluster label

Each eligible (student, pool row) pair shares exactly one bucket, so counts and best
candidates come from aggregating the pool per bucket *before* the join. Students are
collapsed to distinct key tuples (classes) first; nothing here grows with
students x mentors. ``candidates.py`` ranks and counts them on the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, STAGES, Policy
from matchloom.functions.ids import natural_key
from matchloom.functions.keys import finance_cluster
from matchloom.operators.numbering import lookup


def class_key(cols: Sequence[str] = KEYS) -> Column:
    """Text of the six key values; null reads as 'n'."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("n")) for c in cols])


def student_classes(students: DataFrame) -> DataFrame:
    """Distinct key tuples with the number of students in each."""
    return students.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("students")).withColumn("class_key", class_key())


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _prefix(*parts: Column) -> Column:
    # concat is null when a strict key is null: such rows match nothing.
    out = []
    for i, p in enumerate(parts):
        out += [F.lit("|"), p] if i else [p]
    return F.concat(*out)


def pool_keys(pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Add ``center_keys`` and ``school_keys`` (arrays) and ``finance_key`` to pool rows."""
    restricted = F.coalesce(F.col("has_school_constraint"), F.lit(False)) if "has_school_constraint" in pool.columns else F.lit(False)
    school = F.coalesce(F.col("school_code"), F.lit(0)).cast("string")
    return (
        pool.withColumn("center_keys", F.array_compact(F.array(_text("center_code"), F.lit("*"))))
        .withColumn("finance_key", finance_cluster("finance_code", policy).cast("string"))
        .withColumn(
            "school_keys",
            F.when(restricted, F.array(F.lit("*"), F.concat(F.lit("R:"), school))).otherwise(
                F.array(F.lit("*"), F.lit("U"), F.concat(F.lit("U:"), school))
            ),
        )
    )


def student_keys(classes: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Add the student-side alternatives."""
    c, s = _text("center_code"), _text("school_code")
    return (
        classes.withColumn(
            "center_keys",
            F.when(c.isNull(), F.array(F.lit("*"))).when(c == "0", F.array(c)).otherwise(F.array(F.lit("0"), c)),
        )
        .withColumn("finance_key", finance_cluster("finance_code", policy).cast("string"))
        .withColumn(
            "school_keys",
            F.when(s.isNull(), F.array(F.lit("*")))
            .when(s == "0", F.array(F.lit("U")))
            .otherwise(F.array(F.concat(F.lit("R:"), s), F.lit("U:0"), F.concat(F.lit("U:"), s))),
        )
    )


def with_bucket(keyed: DataFrame) -> DataFrame:
    """One row per full bucket key."""
    return (
        keyed.withColumn("__c", F.explode("center_keys"))
        .withColumn("__s", F.explode("school_keys"))
        .withColumn(
            "bucket",
            _prefix(_text("group_code"), _text("gender_code"), _text("grad_status_code"), F.col("__c"), F.col("finance_key"), F.col("__s")),
        )
        .drop("__c", "__s", "center_keys", "school_keys", "finance_key")
    )


def _stage_keys(keyed: DataFrame) -> DataFrame:
    """One row per (stage number, prefix bucket) a row takes part in."""
    g, d, t = _text("group_code"), _text("gender_code"), _text("grad_status_code")
    f = F.col("finance_key")
    item = lambda n, k: F.struct(F.lit(n).alias("stage_no"), k.alias("bucket"))
    fixed = F.array(item(2, g), item(3, _prefix(g, d)), item(4, _prefix(g, d, t)))
    per_center = F.transform("center_keys", lambda c: item(5, _prefix(g, d, t, c)))
    per_finance = F.transform("center_keys", lambda c: item(6, _prefix(g, d, t, c, f)))
    per_school = F.flatten(
        F.transform(
            "center_keys",
            lambda c: F.transform("school_keys", lambda s: item(7, _prefix(g, d, t, c, f, s))),
        )
    )
    return keyed.withColumn("__k", F.explode(F.concat(fixed, per_center, per_finance, per_school))).select(
        *[c for c in keyed.columns if c not in ("center_keys", "school_keys", "finance_key")],
        "__k.stage_no",
        "__k.bucket",
    )


def pool_profiles(pool: DataFrame, capacity: str = "remaining_capacity") -> DataFrame:
    """Pool rows collapsed to distinct key profiles with row counts."""
    flag = "has_school_constraint" if "has_school_constraint" in pool.columns else None
    keys = [*KEYS, flag] if flag else list(KEYS)
    return pool.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(capacity) > 0).alias("open_rows")
    )


def class_funnel(classes: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Candidates left after each of the eight stages, per class (columns ``n_<stage>``).

    Profiles are counted per prefix bucket, then looked up by the class's alternatives:
    one equi join of two aggregated tables, no pairs.
    """
    counted = (
        _stage_keys(pool_keys(pool_profiles(pool), policy))
        .groupBy("stage_no", "bucket")
        .agg(F.sum("rows").alias("rows"), F.sum("open_rows").alias("open_rows"))
        .where(F.col("bucket").isNotNull())
    )
    wanted = _stage_keys(student_keys(classes.select("class_key", *KEYS), policy)).select(
        "class_key", "stage_no", "bucket"
    )
    hits = wanted.join(counted, ["stage_no", "bucket"])
    total = lambda n, c: F.coalesce(F.sum(F.when(F.col("stage_no") == n, F.col(c))), F.lit(0)).cast("bigint")
    wide = hits.groupBy("class_key").agg(
        total(2, "rows").alias("n_type"),
        *[total(i, "rows").alias(f"n_{STAGES[i - 1]}") for i in range(2, 8)],
        total(7, "open_rows").alias("n_capacity_gate"),
    )
    names = [f"n_{s}" for s in STAGES]
    joined = lookup(classes, wide, ["class_key"], names, "left")
    return joined.select(*classes.columns, *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def stage_funnel(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The funnel of every student, plus the pool size before the first stage."""
    funnel = class_funnel(student_classes(students), pool, policy)
    size = pool.agg(F.count(F.lit(1)).alias("pool_rows"))
    keyed = students.withColumn("class_key", class_key())
    out = lookup(keyed, funnel, ["class_key"], [f"n_{s}" for s in STAGES], "left")
    return out.join(F.broadcast(size)).drop("class_key")


def mentor_state(pool: DataFrame, capacity: str = "remaining_capacity") -> DataFrame:
    """Initial capacity per mentor: the largest of its rows, never negative."""
    zero = F.lit(0).cast("bigint")
    return pool.where(F.col("mentor_id").isNotNull()).groupBy("mentor_id").agg(
        F.greatest(F.coalesce(F.max(capacity).cast("bigint"), zero), zero).alias("initial")
    )


def ranking_key(remaining: str = "initial", new: str = "allocations_new") -> list[Column]:
    """Remaining down, new up, natural mentor id up, then pool order."""
    return [F.col(remaining).desc(), F.col(new).asc(), F.col("mentor_sort").asc(), F.col("pool_order").asc()]


def ranked_pool(pool: DataFrame) -> DataFrame:
    """Pool rows with mentor-level capacity and sort key."""
    zero = F.lit(0).cast("bigint")
    new = F.col("allocations_new") if "allocations_new" in pool.columns else zero
    with_state = lookup(pool, mentor_state(pool), ["mentor_id"], ["initial"], "left")
    return (
        with_state.withColumn("initial", F.coalesce("initial", zero))
        .withColumn("allocations_new", F.greatest(F.coalesce(new.cast("bigint"), zero), zero))
        .withColumn("mentor_sort", natural_key("mentor_id"))
    )


def candidate_stats(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Per student: eligible rows, open rows, places and the best open candidate.

    The pool is aggregated per bucket, classes add up their buckets, students look up
    their class. A hot bucket is one partial row per task.
    """
    ranked = ranked_pool(pool)
    open_row = F.col("remaining_capacity") > 0
    pick = F.struct(
        (-F.col("initial")).alias("neg"), F.col("allocations_new"), F.col("mentor_sort"), F.col("pool_order"),
        F.col("mentor_id"),
    )
    per_bucket = (
        with_bucket(pool_keys(ranked, policy))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(open_row).alias("open_rows"),
            F.sum("remaining_capacity").alias("places"),
            F.min(F.when(open_row, pick)).alias("best"),
        )
    )
    classes = with_bucket(student_keys(student_classes(students).select("class_key", *KEYS), policy))
    per_class = classes.select("class_key", "bucket").join(per_bucket, "bucket").groupBy("class_key").agg(
        F.sum("rows").alias("candidates"),
        F.sum("open_rows").alias("open_candidates"),
        F.sum("places").alias("places"),
        F.min("best").alias("best"),
    )
    keyed = students.withColumn("class_key", class_key())
    out = lookup(keyed, per_class, ["class_key"], ["candidates", "open_candidates", "places", "best"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        *students.columns,
        *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("candidates", "open_candidates", "places")],
        F.col("best.mentor_id").alias("best_mentor"),
        (-F.col("best.neg")).alias("best_remaining"),
        F.col("best.pool_order").alias("best_pool_order"),
    )
