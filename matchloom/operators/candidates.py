"""Candidates in factorised form: classes, the buckets they read, and ranked runs of pool rows.

A class (distinct student key tuple) reads at most six buckets and a pool row stands in at most six, so
``links`` and ``members`` grow with classes and pool rows, never with their product. Counts are sums over
a class's buckets. For ranks every pool row gets one ``place`` in the order of the whole pool; a bucket is then
a run of places, and the rank of a row in a class is the number of smaller places in the class's runs.
``PlaceTree`` counts each run by the hexadecimal digits of its places, which answers both questions
digit by digit: which rank a row has, and which row has rank k.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.config import Policy
from matchloom.functions.ids import counter_hash
from matchloom.operators import matching as M
from matchloom.operators.matrix_core import STRICT, capacity_outcome
from matchloom.operators.numbering import lookup, number_rows
from matchloom.session import cut_lineage

#: Names that may hold the counter of a pool row, in order of preference.
COUNTERS = ("counter", "allocation_counter", "student_id", "row_number")
STRATEGIES = ("none", "deterministic_jitter", "round_robin")
DIGIT = 16
STRETCH_BITS = 16


@dataclass(frozen=True)
class Candidates:
    """``classes`` (class_key, students, keys), ``links`` (class_key, bucket) and ``members`` (bucket, pool columns).

    A class and a pool row that are eligible share exactly one bucket.
    """

    classes: DataFrame
    links: DataFrame
    members: DataFrame

    def counted(self, **measures: Column) -> DataFrame:
        """``candidates`` and further sums over the members of every class; null where it has none.

        Buckets are summed first; each measure is the value of one row.
        """
        sums = {"candidates": F.lit(1)} | measures
        per_bucket = self.members.groupBy("bucket").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
        per_class = self.links.join(per_bucket, "bucket").groupBy("class_key").agg(*[F.sum(n).alias(n) for n in sums])
        out = lookup(self.classes, per_class, ["class_key"], list(sums), "left")
        return out.withColumn("candidates", F.coalesce("candidates", F.lit(0)).cast("bigint"))

    def pairs(self) -> DataFrame:
        """Every (class, pool row) link with the pool columns, once each."""
        return self.links.join(self.members, "bucket").drop("bucket")


def candidates(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> Candidates:
    """Eligibility under the wildcard rules of ``matching``."""
    classes = M.student_classes(students)
    links = M.with_bucket(M.student_keys(classes, policy)).select("class_key", "bucket").where("bucket is not null")
    members = M.with_bucket(M.pool_keys(pool, policy)).where("bucket is not null")
    return Candidates(classes, links, members)


def strict_candidates(students: DataFrame, mentors: DataFrame) -> Candidates:
    """Eligibility of the strict path: finance is plain equality, center and school accept the mentor's 0.

    Members carry the capacity outcome; the trace of a row differs in its last stage only.
    """
    classes = M.student_classes(students)
    zero = F.lit(0).cast("bigint")
    both = lambda c: F.array_distinct(F.array(F.col(c), zero))
    text = lambda *cols: M._prefix(*[c.cast("string") for c in cols])
    fixed = [F.col(k) for k in STRICT]
    wanted = F.flatten(F.transform(both("center_code"), lambda c: F.transform(both("school_code"), lambda s: text(*fixed, c, s))))
    links = classes.select("class_key", F.explode(wanted).alias("bucket")).where("bucket is not null")
    members = capacity_outcome(mentors).withColumn("bucket", text(*fixed, F.col("center_code"), F.col("school_code")))
    return Candidates(classes, links, members.where("bucket is not null"))


def variant_candidates(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> Candidates:
    """Eligibility by key variants {exact, center 0, school 0, both 0} x finance cluster as plain equi keys.

    Legal for classes with known, non-wildcard center and school when no pool row is unrestricted by
    flag; other classes read the general buckets. Both kinds of bucket stand side by side in ``members``.
    """
    general = candidates(students, pool, policy)
    flagged = "has_school_constraint" in pool.columns
    free = F.count_if(~F.coalesce(F.col("has_school_constraint"), F.lit(False))) if flagged else F.lit(0)
    legal = (F.col("school_code") > 0) & (F.col("center_code") > 0) & (F.col("free") == 0) & F.col("finance_code").isNotNull() & F.col("group_code").isNotNull()
    marked = general.classes.join(F.broadcast(pool.agg(free.alias("free")))).withColumn("legal", F.coalesce(legal, F.lit(False)))
    cluster = M.finance_cluster("finance_code", policy).cast("string")
    code = lambda c: F.col(c).cast("string")
    fixed = [code("group_code"), code("gender_code"), code("grad_status_code"), cluster]
    pairs = [(code("center_code"), code("school_code")), (F.lit("0"), code("school_code")), (code("center_code"), F.lit("0")), (F.lit("0"), F.lit("0"))]
    variants = F.array(*[F.concat(F.lit("v|"), M._prefix(*fixed, c, s)) for c, s in pairs])
    exact = marked.where("legal").select("class_key", F.explode(variants).alias("bucket"))
    other = general.links.join(marked.where("not legal").select("class_key"), "class_key", "left_semi")
    own = F.concat(F.lit("v|"), M._prefix(*fixed, code("center_code"), F.coalesce(code("school_code"), F.lit("0"))))
    members = general.members.unionByName(pool.withColumn("bucket", own).where("bucket is not null"))
    return Candidates(general.classes, exact.where("bucket is not null").unionByName(other), members)


def placed_pool(pool: DataFrame, strategy: str = "none") -> DataFrame:
    """Pool rows with ``place``, dense from 0 in ranking order: remaining, new, then the strategy, then mentor and pool order.

    Strategies reorder rows of equal remaining and new places only. ``deterministic_jitter`` goes by a
    hash of the row's counter (the first of ``COUNTERS`` that the pool has, else its pool order),
    ``round_robin`` by a hash of the mentor. Any other name is refused.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown fairness strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    ranked = M.ranked_pool(pool)
    order, levels = M.ranking_key(), [("__neg", -F.col("initial")), ("__new", F.col("allocations_new"))]
    if strategy == "none":
        levels.append(("__p", F.substring("mentor_sort", 1, 7)))
    else:
        source = next((c for c in COUNTERS if c in pool.columns), "pool_order") if strategy == "deterministic_jitter" else "mentor_id"
        tie = counter_hash(source) if strategy == "deterministic_jitter" else F.sha2(F.col(source).cast("string"), 256)
        ranked = ranked.withColumn("tie_hash", tie)
        order.insert(2, F.col("tie_hash"))
        levels.append(("__h", F.substring("tie_hash", 1, 2)))
    return number_rows(ranked, order, levels, name="place").withColumn("place", F.col("place") - 1).drop("tie_hash")


def changed_blocks(pool: DataFrame, strategy: str) -> DataFrame:
    """``placed_pool`` with ``block_changed``: whether a row's tie block has another order than the plain one.

    A block holds the same places under either order, so it changed where a place differs.
    """
    plain = placed_pool(pool).select("pool_order", F.col("place").alias("plain_place"))
    fair = placed_pool(pool, strategy).join(plain, "pool_order")
    moved = fair.groupBy("initial", "allocations_new").agg(F.bool_or(F.col("place") != F.col("plain_place")).alias("block_changed"))
    return lookup(fair, moved, ["initial", "allocations_new"], ["block_changed"])


def top_ranked(c: Candidates, k: int) -> DataFrame:
    """class_key, rank and the pool columns of the first ``k`` candidates of every class.

    Each run is cut to its first k rows before it meets the classes, so a class reads at most 6 k rows.
    """
    run = W.partitionBy("bucket").orderBy("place")
    heads = c.members.withColumn("__r", F.row_number().over(run)).where(F.col("__r") <= k).drop("__r")
    own = W.partitionBy("class_key").orderBy("place")
    return c.links.join(heads, "bucket").drop("bucket").withColumn("rank", F.row_number().over(own).cast("bigint")).where(F.col("rank") <= k)


def _stretch() -> Column:
    return F.shiftright("place", STRETCH_BITS).alias("__b")


def ranked_pairs(c: Candidates) -> DataFrame:
    """Every pair with its ``rank`` in the class; ``members`` carry ``place``.

    The pairs before a stretch of places are known from the counts of the buckets, so that only the pairs
    of one class and stretch are sorted together.
    """
    per_bucket = c.members.groupBy("bucket", _stretch()).agg(F.count(F.lit(1)).alias("__n"))
    cells = c.links.join(per_bucket, "bucket").groupBy("class_key", "__b").agg(F.sum("__n").alias("__n"))
    earlier = W.partitionBy("class_key").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select("class_key", "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).cast("bigint").alias("__off"))
    inside = W.partitionBy("class_key", "__b").orderBy("place")
    numbered = c.pairs().withColumn("__b", _stretch()).withColumn("rank", F.row_number().over(inside).cast("bigint"))
    return numbered.join(offsets, ["class_key", "__b"]).withColumn("rank", F.col("rank") + F.col("__off")).drop("__b", "__off")


def changed_classes(c: Candidates) -> DataFrame:
    """class_key and ``order_changed``: whether ``place`` and ``plain_place`` order the pairs of a class differently.

    The orders are the same when plain places rise along the places: inside every stretch, and from each stretch to the next.
    """
    inside = W.partitionBy("class_key", "__b").orderBy("place")
    fell = F.coalesce(F.col("plain_place") < F.lag("plain_place").over(inside), F.lit(False))
    steps = c.pairs().select("class_key", "place", "plain_place", _stretch()).withColumn("fell", fell)
    cells = steps.groupBy("class_key", "__b").agg(F.bool_or("fell").alias("fell"), F.min("plain_place").alias("lo"), F.max("plain_place").alias("hi"))
    earlier = W.partitionBy("class_key").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    back = F.coalesce(F.col("lo") < F.max("hi").over(earlier), F.lit(False))
    return cells.select("class_key", (F.col("fell") | back).alias("fell")).groupBy("class_key").agg(F.bool_or("fell").alias("order_changed"))


class PlaceTree:
    """Counts of every run by the hexadecimal digits of its places; each level is one row a (bucket, prefix)."""

    def __init__(self, c: Candidates):
        self.candidates = c
        self.members = cut_lineage(c.members)
        top = self.members.agg(F.max("place")).first()[0]
        self.depth = max(1, (max(top or 0, 1).bit_length() + 3) // 4)

    def level(self, no: int) -> DataFrame:
        """bucket, prefix and c0 to c15: rows by the next digit under each prefix of ``no`` digits."""
        below = 4 * (self.depth - no - 1)
        digit = F.shiftright("place", below).bitwiseAND(F.lit(DIGIT - 1))
        prefix = F.shiftright("place", below + 4) if below + 4 < 63 else F.lit(0).cast("bigint")
        return self.members.groupBy("bucket", prefix.alias("prefix")).agg(*[F.count_if(digit == d).alias(f"c{d}") for d in range(DIGIT)])

    def rows_at(self, wanted: DataFrame) -> DataFrame:
        """(class_key, rank) of ``wanted`` with ``place``: the row of that rank. Ranks beyond the candidates give no row.

        One round a digit: the counts of the class's runs are added up, and the digit that the
        rank falls into is followed.
        """
        state = wanted.select("class_key", F.col("rank").cast("bigint").alias("rank")).where("rank > 0")
        state = state.distinct().withColumns({"prefix": F.lit(0).cast("bigint"), "left": F.col("rank")})
        for no in range(self.depth):
            read = state.join(self.candidates.links, "class_key").join(self.level(no), ["bucket", "prefix"])
            sums = read.groupBy("class_key", "rank", "prefix", "left").agg(F.array(*[F.sum(f"c{d}") for d in range(DIGIT)]).alias("c"))
            cases = sums.select("class_key", "rank", "prefix", "left", F.posexplode("c").alias("digit", "n"), "c")
            before = F.aggregate(F.slice("c", F.lit(1), F.col("digit")), F.lit(0).cast("bigint"), lambda a, x: a + x)
            cases = cases.withColumn("before", before).where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("n")))
            state = cases.select("class_key", "rank", (F.col("prefix") * DIGIT + F.col("digit")).alias("prefix"), (F.col("left") - F.col("before")).alias("left"))
        return state.select("class_key", "rank", F.col("prefix").alias("place"))

    def ranks_of(self, asked: DataFrame) -> DataFrame:
        """(class_key, place) of ``asked`` with ``rank``; rows that are not candidates of the class are left out."""
        asked = asked.select("class_key", "place").distinct()
        read = asked.join(self.candidates.links, "class_key")
        parts = []
        for no in range(self.depth):
            below = 4 * (self.depth - no - 1)
            digit = F.shiftright("place", below).bitwiseAND(F.lit(DIGIT - 1))
            prefix = F.shiftright("place", below + 4) if below + 4 < 63 else F.lit(0).cast("bigint")
            hits = read.withColumn("prefix", prefix).join(self.level(no), ["bucket", "prefix"])
            smaller = sum((F.when(digit > d, F.col(f"c{d}")).otherwise(0) for d in range(DIGIT)), F.lit(0))
            own = sum((F.when(digit == d, F.col(f"c{d}")).otherwise(0) for d in range(DIGIT)), F.lit(0)) if no == self.depth - 1 else F.lit(0)
            parts.append(hits.select("class_key", "place", smaller.cast("bigint").alias("smaller"), own.cast("bigint").alias("own")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        summed = out.groupBy("class_key", "place").agg(F.sum("smaller").alias("smaller"), F.sum("own").alias("own"))
        return summed.where("own > 0").select("class_key", "place", (F.col("smaller") + 1).alias("rank"))


def fairness_report(students: DataFrame, pool: DataFrame, strategies: Sequence[str] = STRATEGIES[1:], k: int = 5, policy: Policy | None = None) -> DataFrame:
    """First ``k`` candidates of every class under each strategy, and whether they differ from the plain first ``k``."""
    plain = top_ranked(candidates(students, placed_pool(pool), policy), k).select("class_key", F.col("rank").alias("__rank"), F.col("pool_order").alias("__plain"))
    out = None
    for strategy in strategies:
        fair = top_ranked(candidates(students, placed_pool(pool, strategy), policy), k)
        both = fair.join(plain, (fair["class_key"] == plain["class_key"]) & (F.col("rank") == F.col("__rank"))).drop(plain["class_key"])
        moved = F.bool_or(F.col("pool_order") != F.col("__plain")).over(W.partitionBy("class_key"))
        part = both.select(F.lit(strategy).alias("strategy"), "class_key", "rank", "mentor_id", "pool_order", moved.alias("order_changed"))
        out = part if out is None else out.unionByName(part)
    return out


def fair_pairs(students: DataFrame, pool: DataFrame, strategies: Sequence[str] = STRATEGIES[1:], policy: Policy | None = None) -> DataFrame:
    """Every pair with its rank under each strategy, and whether its class has another order than the plain one."""
    plain = placed_pool(pool).select("pool_order", F.col("place").alias("plain_place"))
    out = None
    for strategy in strategies:
        placed = cut_lineage(placed_pool(pool, strategy).join(plain, "pool_order"))
        c = candidates(students, placed, policy)
        part = lookup(ranked_pairs(c), changed_classes(c), ["class_key"], ["order_changed"])
        part = part.select(F.lit(strategy).alias("strategy"), "class_key", "mentor_id", "pool_order", "rank", "order_changed")
        out = part if out is None else out.unionByName(part)
    return out
