"""Rule hooks: user stage rules compiled into bucket keys, user pair rules evaluated on class - profile edges.

A stage rule has an equi-key form for each side where it can (arrays of alternative keys, of which an eligible
pair shares exactly one), a residual predicate where it cannot, or both. ``RuleSet`` makes the prefix buckets of
the leading keyed rules, so those stages are counted without pairs. From the first residual on, stages are
evaluated on edges of student classes and pool profiles that share the bucket reached so far; both sides
are collapsed to the columns that the rules read, and edges carry row counts. Students get the result of their class.

Residual and pair predicates are columns over the names of the student side and, with the prefix ``m_``,
of the pool side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import Policy
from matchloom.functions.keys import finance_cluster
from matchloom.operators.matching import class_key
from matchloom.operators.numbering import lookup

OK = "OK"


@dataclass(frozen=True)
class StageRule:
    """A match stage; ``reason`` is reported where it leaves no candidate."""

    stage: str
    reason: str
    student_columns: tuple[str, ...]
    pool_columns: tuple[str, ...]
    student_keys: Column | None = None
    pool_keys: Column | None = None
    residual: Column | None = None

    def __post_init__(self):
        if (self.student_keys is None) != (self.pool_keys is None):
            raise ValueError(f"stage {self.stage}: keys are needed for both sides or for none")
        if self.student_keys is None and self.residual is None:
            raise ValueError(f"stage {self.stage}: neither keys nor a residual")


@dataclass(frozen=True)
class PairRule:
    """Fails a pair where ``fails`` is true; a null is no failure."""

    reason: str
    fails: Column
    student_columns: tuple[str, ...] = ()
    pool_columns: tuple[str, ...] = ()


def equal_rule(stage: str, column: str, reason: str) -> StageRule:
    """Both sides have the same value; null matches nothing."""
    keys = F.array(F.col(column).cast("string"))
    return StageRule(stage, reason, (column,), (column,), keys, keys)


def composed(stage: str, *rules: StageRule) -> tuple[StageRule, ...]:
    """Several rules as one stage: all must pass, and the first that leaves no candidate gives the reason."""
    if not rules:
        raise ValueError("a composed stage needs at least one rule")
    return tuple(replace(r, stage=stage) for r in rules)


def default_rules(policy: Policy | None = None) -> tuple[StageRule, ...]:
    """The seven stages of ``predicates.stage_predicates`` in key form."""
    text = lambda c: F.col(c).cast("string")
    c, s, any_ = text("center_code"), text("school_code"), F.array(F.lit("*"))
    center = F.when(c.isNull(), any_).when(c == "0", F.array(c)).otherwise(F.array(F.lit("0"), c))
    school_m = F.coalesce(s, F.lit("0"))
    restricted = F.coalesce(F.col("has_school_constraint"), F.lit(False))
    school = F.when(s.isNull(), any_).when(s == "0", F.array(F.lit("U"))).otherwise(F.array(F.concat(F.lit("R:"), s), F.lit("U:0"), F.concat(F.lit("U:"), s)))
    school_pool = F.when(restricted, F.array(F.lit("*"), F.concat(F.lit("R:"), school_m))).otherwise(F.array(F.lit("*"), F.lit("U"), F.concat(F.lit("U:"), school_m)))
    cluster = F.array(finance_cluster("finance_code", policy).cast("string"))
    return (
        equal_rule("type", "group_code", "TYPE_MISMATCH"),
        equal_rule("group", "group_code", "GROUP_MISMATCH"),
        equal_rule("gender", "gender_code", "GENDER_MISMATCH"),
        equal_rule("graduation_status", "grad_status_code", "GRADUATION_STATUS_MISMATCH"),
        StageRule("center", "CENTER_MISMATCH", ("center_code",), ("center_code",), center, F.array(c, F.lit("*"))),
        StageRule("finance", "FINANCE_MISMATCH", ("finance_code",), ("finance_code",), cluster, cluster),
        StageRule("school", "SCHOOL_STATUS_MISMATCH", ("school_code",), ("school_code", "has_school_constraint"), school, school_pool),
    )


def pair_reason(rules: Sequence[PairRule]) -> Column:
    """Reason of the first rule that fails, null where none does."""
    return F.coalesce(*[F.when(r.fails, F.lit(r.reason)) for r in rules], F.lit(None).cast("string"))


def _joined(held: Column, keys: Column) -> Column:
    """Every prefix continued by every key."""
    return F.flatten(F.transform(held, lambda a: F.transform(keys, lambda k: F.concat(a, F.lit("|"), k))))


def _numbered(no: int, held: Column) -> Column:
    return F.transform(held, lambda b: F.struct(F.lit(no).alias("no"), b.alias("bucket")))


class RuleSet:
    """An ordered set of stage rules; rules of one stage stand side by side."""

    def __init__(self, rules: Sequence[StageRule | tuple[StageRule, ...]]):
        self.rules = [r for item in rules for r in (item if isinstance(item, tuple) else (item,))]
        self.stages = list(dict.fromkeys(r.stage for r in self.rules))
        if [r.stage for r in self.rules] != [s for s in self.stages for r in self.rules if r.stage == s]:
            raise ValueError("rules of a stage must stand side by side")
        self.keyed = next((i for i, r in enumerate(self.rules) if r.residual is not None or r.student_keys is None), len(self.rules))
        if not self.keyed:
            raise ValueError("the first rule needs a key form without residual: nothing else keeps classes and profiles apart")

    def swapped(self, *rules: StageRule) -> RuleSet:
        """This set with the rules of the given rules' stage replaced by them."""
        stage = rules[0].stage
        if stage not in self.stages:
            raise ValueError(f"no stage {stage!r}; stages are {', '.join(self.stages)}")
        out: list = []
        for s in self.stages:
            out += [tuple(rules) if s == stage else tuple(r for r in self.rules if r.stage == s)]
        return RuleSet(out)

    def student_columns(self, more: Sequence[PairRule] = ()) -> list[str]:
        return list(dict.fromkeys(c for r in (*self.rules, *more) for c in r.student_columns))

    def pool_columns(self, more: Sequence[PairRule] = ()) -> list[str]:
        return list(dict.fromkeys(c for r in (*self.rules, *more) for c in r.pool_columns))

    def _sides(self, students: DataFrame, pool: DataFrame, more: Sequence[PairRule] = (), capacity: str = "remaining_capacity"):
        """Classes and profiles, each with the prefix keys up to the last keyed rule and the later keys by rule number."""
        names, columns = self.student_columns(more), self.pool_columns(more)
        if "has_school_constraint" in columns and "has_school_constraint" not in pool.columns:
            pool = pool.withColumn("has_school_constraint", F.lit(False))
        classes = students.groupBy(*names).agg(F.count(F.lit(1)).alias("students")).withColumn("class_key", class_key(names))
        profiles = pool.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(capacity) > 0).alias("open_rows"))
        later = [(i, r) for i, r in enumerate(self.rules) if i >= self.keyed and r.student_keys is not None]
        left = classes.withColumns({"__prefixes": self._prefixes("student_keys"), **{f"__s{i}": F.array_compact(r.student_keys) for i, r in later}})
        right = profiles.withColumns({"__prefixes": self._prefixes("pool_keys"), **{f"__m{i}": F.array_compact(r.pool_keys) for i, r in later}})
        return left, right

    def _prefixes(self, side: str) -> Column:
        """Array of (number of rules, bucket) for every keyed prefix; an alternative that is null matches nothing."""
        held = F.array(F.lit(""))
        out = []
        for no, rule in enumerate(self.rules[: self.keyed], 1):
            keys = F.array_compact(F.coalesce(getattr(rule, side), F.array().cast("array<string>")))
            held = _joined(held, keys)
            out.append(_numbered(no, held))
        return F.concat(*out)

    def edges(self, students: DataFrame, pool: DataFrame, more: Sequence[PairRule] = ()) -> DataFrame:
        """Class - profile edges that pass the keyed rules, with ``ok<i>`` for each later rule.

        Student columns keep their names, pool columns get the prefix ``m_``; rows and open_rows come from the profile.
        """
        left, right = self._sides(students, pool, more)
        names = self.pool_columns(more)
        last = lambda df: df.withColumn("__b", F.explode("__prefixes")).where(F.col("__b.no") == self.keyed).withColumn("bucket", F.col("__b.bucket")).drop("__b", "__prefixes")
        right = last(right).withColumnsRenamed({c: f"m_{c}" for c in names})
        out = last(left).join(right, "bucket").drop("bucket")
        for i in range(self.keyed, len(self.rules)):
            rule, ok = self.rules[i], F.lit(True)
            if rule.student_keys is not None:
                ok = F.coalesce(F.arrays_overlap(F.col(f"__s{i}"), F.col(f"__m{i}")), F.lit(False))
            if rule.residual is not None:
                ok = ok & F.coalesce(rule.residual, F.lit(False))
            out = out.withColumn(f"ok{i}", ok)
        return out.drop(*[c for c in out.columns if c.startswith(("__s", "__m"))])

    def class_funnel(self, students: DataFrame, pool: DataFrame) -> DataFrame:
        """class_key, students, the student columns, ``n_<stage>``, n_capacity_gate and reason of every class.

        ``reason`` is that of the first rule without candidates, CAPACITY_FULL if only the gate has none, else OK.
        """
        left, right = self._sides(students, pool)
        each = lambda df, *keep: df.select(*keep, F.explode("__prefixes").alias("__b")).select(*keep, "__b.no", "__b.bucket")
        counted = each(right, "rows", "open_rows").groupBy("no", "bucket").agg(F.sum("rows").alias("rows"), F.sum("open_rows").alias("open_rows"))
        hits = each(left, "class_key").join(counted, ["no", "bucket"])
        total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("bigint")
        wide = hits.groupBy("class_key").agg(
            *[total(F.col("no") == i + 1, F.col("rows")).alias(f"__n{i}") for i in range(self.keyed)],
            total(F.col("no") == self.keyed, F.col("open_rows")).alias("__open"),
        )
        if self.keyed < len(self.rules):
            ok, sums = F.lit(True), []
            for i in range(self.keyed, len(self.rules)):
                ok = ok & F.col(f"ok{i}")
                sums.append(total(ok, F.col("rows")).alias(f"__n{i}"))
            late = self.edges(students, pool).groupBy("class_key").agg(*sums, total(ok, F.col("open_rows")).alias("__open"))
            wide = wide.drop("__open").join(late, "class_key", "left")
        numbers = [f"__n{i}" for i in range(len(self.rules))]
        out = lookup(left.drop(*[c for c in left.columns if c.startswith("__")]), wide, ["class_key"], [*numbers, "__open"], "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in (*numbers, "__open")})
        reason = F.when(F.col("__open") == 0, F.lit("CAPACITY_FULL")).otherwise(F.lit(OK))
        for i in reversed(range(len(self.rules))):
            reason = F.when(F.col(f"__n{i}") == 0, F.lit(self.rules[i].reason)).otherwise(reason)
        last = {s: max(i for i, r in enumerate(self.rules) if r.stage == s) for s in self.stages}
        return out.select(
            "class_key", "students", *self.student_columns(), *[F.col(f"__n{i}").alias(f"n_{s}") for s, i in last.items()],
            F.col("__open").alias("n_capacity_gate"), reason.alias("reason"),
        )

    def funnel(self, students: DataFrame, pool: DataFrame) -> DataFrame:
        """The class funnel for every student, with the pool size before the first stage."""
        names = [*[f"n_{s}" for s in self.stages], "n_capacity_gate", "reason"]
        keyed = students.withColumn("class_key", class_key(self.student_columns()))
        out = lookup(keyed, self.class_funnel(students, pool), ["class_key"], names, "left").drop("class_key")
        return out.join(F.broadcast(pool.agg(F.count(F.lit(1)).alias("pool_rows"))))

    def trace(self, students: DataFrame, pool: DataFrame) -> DataFrame:
        """One row a student and stage: stage_no, stage, total_before, total_after, matched; the gate comes last."""
        names, before, items = [*self.stages, "capacity_gate"], F.col("pool_rows"), []
        for no, s in enumerate(names, 1):
            after = F.col(f"n_{s}")
            items.append(F.struct(F.lit(no).alias("stage_no"), F.lit(s).alias("stage"), before.cast("bigint").alias("total_before"), after.alias("total_after"), (after > 0).alias("matched")))
            before = after
        return self.funnel(students, pool).select("student_id", F.explode(F.array(*items)).alias("x")).select("student_id", "x.*")

    def pair_reasons(self, students: DataFrame, pool: DataFrame, rules: Sequence[PairRule]) -> DataFrame:
        """student_id, reason, rows and open_rows: the eligible pool rows of each student by the first pair rule they fail.

        Rows that fail none count as OK; a student without eligible rows gives no row.
        """
        edges = self.edges(students, pool, rules)
        for i in range(self.keyed, len(self.rules)):
            edges = edges.where(F.col(f"ok{i}"))
        reason = F.coalesce(pair_reason(rules), F.lit(OK)) if rules else F.lit(OK)
        per_class = edges.groupBy("class_key", reason.alias("reason")).agg(F.sum("rows").alias("rows"), F.sum("open_rows").alias("open_rows"))
        keyed = students.select("student_id", class_key(self.student_columns(rules)).alias("class_key"))
        return keyed.join(per_class, "class_key").select("student_id", "reason", "rows", "open_rows")
