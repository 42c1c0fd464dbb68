"""Data-quality rules. Every rule returns (rule_id, level, subject, detail) rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, KEYS, Policy
from matchloom.functions import ids
from matchloom.functions import keys as keyfn
from matchloom.operators import governance
from matchloom.operators.numbering import duplicate_sizes, lookup

SCHEMA = "rule_id string, level string, subject string, detail string"
# Rules whose warning rows do not fail the run.
WARN_ONLY = ("MENTOR_TYPE_01", "POOL_DIVERSITY_01")


def _rows(df: DataFrame, rule: str, subject, detail, level: str = "error") -> DataFrame:
    return df.select(
        F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")
    )


def stu_01(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Student counts (non-null ids, or rows) agree across the given tables."""
    counts = None
    for name, df in tables.items():
        n = F.count("student_id") if "student_id" in df.columns else F.count(F.lit(1))
        part = df.agg(n.alias("n")).select(F.lit(name).alias("name"), "n")
        counts = part if counts is None else counts.unionByName(part)
    one = counts.agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", F.col("n").cast("string")))), ",").alias("d"),
    ).where(F.col("lo") != F.col("hi"))
    return _rows(one, "STU_01", F.lit("counts"), F.col("d"))


def expected_vs_assigned(expected: DataFrame, alloc: DataFrame) -> DataFrame:
    """Expected and assigned students per mentor."""
    e = expected.where(F.col("mentor_id").isNotNull() & F.col("expected").isNotNull()).groupBy("mentor_id").agg(F.sum("expected").cast("bigint").alias("expected"))
    a = alloc.where(F.col("mentor_id").isNotNull()).groupBy("mentor_id").agg(F.count(F.lit(1)).alias("assigned"))
    return lookup(e, a, ["mentor_id"], ["assigned"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(0)).cast("bigint"))


def stu_02(expected: DataFrame, alloc: DataFrame) -> DataFrame:
    bad = expected_vs_assigned(expected, alloc).where(F.col("expected") != F.col("assigned"))
    return _rows(bad, "STU_02", F.col("mentor_id"), F.concat_ws("/", F.col("assigned").cast("string"), F.col("expected").cast("string")))


def stu_binding_01(students: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Binding inputs exist and give a legal binding."""
    policy = policy or Policy()
    missing = [c for c in ("grad_status_code", "school_code") if c not in students.columns]
    if missing:
        return students.sparkSession.createDataFrame([("STU_BINDING_01", "error", "schema", ",".join(missing))], SCHEMA)
    b = keyfn.student_binding("school_code", "grad_status_code", policy.school_codes)
    if "declared_binding" in students.columns:
        b = F.coalesce(F.col("declared_binding"), b)
    bad = students.withColumn("b", b).where(~F.col("b").isin("NORMAL", "SCHOOL"))
    return _rows(bad, "STU_BINDING_01", F.col("student_id"), F.col("b"))


def status_domain_01(matrix: DataFrame) -> DataFrame:
    dual = F.col("group_code").isin(*DUAL_STATUS) & (F.col("mentor_type") != "SCHOOL")
    ok = (F.col("grad_status_code") == 1) | (dual & (F.col("grad_status_code") == 0))
    bad = matrix.where(F.col("group_code").isNotNull() & F.col("grad_status_code").isNotNull() & ~ok)
    return _rows(bad, "STATUS_DOMAIN_01", F.col("mentor_id"), F.concat_ws("|", F.col("group_code").cast("string"), F.col("grad_status_code").cast("string"), "mentor_type"))


def join_01(matrix: DataFrame) -> DataFrame:
    """Six keys present, non-null and integer; one pass for the null counts."""
    spark = matrix.sparkSession
    types = dict(matrix.dtypes)
    static = [("JOIN_01", "error", k, "missing column") for k in KEYS if k not in types]
    static += [("JOIN_01", "error", k, f"type {types[k]}") for k in KEYS if k in types and types[k] not in ("bigint", "int", "smallint", "tinyint")]
    present = [k for k in KEYS if k in types]
    counts = matrix.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in present])
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("n")) for k in present])
    nulls = counts.select(F.explode(items).alias("x")).select("x.*").where(F.col("n") > 0)
    out = _rows(nulls, "JOIN_01", F.col("k"), F.concat(F.lit("nulls "), F.col("n").cast("string")))
    return out.unionByName(spark.createDataFrame(static, SCHEMA)) if static else out


def mentor_type_01(matrix: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Legal type, one type per mentor, school code and alias fit the type."""
    policy = policy or Policy()
    t, alias, mentor = F.trim("mentor_type"), F.trim(F.coalesce("alias", F.lit(""))), F.trim(F.col("mentor_id").cast("string"))
    normal, school = t == "NORMAL", t == "SCHOOL"
    code = F.coalesce("school_code", F.lit(0))
    postal = F.coalesce(alias.rlike("^[0-9]+$") & alias.try_cast("bigint").between(*policy.postal_range), F.lit(False))
    rules = F.array_compact(
        F.array(
            F.when(~(normal | school), F.lit("illegal type")),
            F.when(normal & (code != 0), F.lit("normal row with school")),
            F.when(school & (code == 0), F.lit("school row without school")),
            F.when(school & (alias != mentor), F.lit("school alias differs")),
            F.when(normal & (alias == ""), F.lit("normal alias missing")),
            F.when(normal & (alias != "") & ~postal, F.lit("normal alias out of range")),
        )
    )
    per_row = matrix.select(mentor.alias("m"), F.explode(rules).alias("d")).distinct()
    two = matrix.groupBy(mentor.alias("m")).agg(F.min(t).alias("a"), F.max(t).alias("b")).where(F.col("a") != F.col("b"))
    return _rows(per_row, "MENTOR_TYPE_01", F.col("m"), F.col("d")).unionByName(_rows(two, "MENTOR_TYPE_01", F.col("m"), F.lit("two types")))


def duplicate_keys(df: DataFrame, per_mentor: bool = True) -> DataFrame:
    """All rows of repeated keys with the group size; per mentor or per key."""
    return duplicate_sizes(df, ["mentor_id", *KEYS] if per_mentor else list(KEYS))


def pool_join_01(pool: DataFrame) -> DataFrame:
    keys = ["mentor_id", *KEYS]
    rows = pool.where(F.trim(F.col("mentor_id").cast("string")) != "")
    dup = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    one = dup.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).where(F.col("groups") > 0)
    return _rows(one, "POOL_JOIN_01", F.lit("pool"), F.concat_ws("/", F.col("groups").cast("string"), F.col("rows").cast("string")))


def school_01(matrix: DataFrame, invalid: DataFrame) -> DataFrame:
    free = matrix.where(~F.col("has_school_constraint")).select("mentor_id").distinct()
    leaked = free.join(invalid.select("mentor_id").distinct(), "mentor_id", "left_semi")
    bare = matrix.where(F.col("has_school_constraint") & (F.coalesce("school_code", F.lit(0)) == 0)).select("mentor_id").distinct()
    return _rows(leaked, "SCHOOL_01", F.col("mentor_id"), F.lit("unrestricted mentor in invalid list")).unionByName(
        _rows(bare, "SCHOOL_01", F.col("mentor_id"), F.lit("restricted mentor without school"))
    )


def gov_01(alloc: DataFrame, policy_status: DataFrame | None, overrides: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    used = alloc.where(F.col("mentor_id").isNotNull()).select("mentor_id").distinct()
    bad = governance.effective_status(used, policy_status, overrides, None, policy, on_invalid="ignore").where(F.col("effective_status") != "ACTIVE")
    return _rows(bad, "GOV_01", F.col("mentor_id"), F.col("effective_status"))


def alloc_01(alloc: DataFrame, summary: DataFrame) -> DataFrame:
    """Assigned never exceeds remaining + new of any summary row."""
    n = alloc.where(F.col("mentor_id").isNotNull()).groupBy("mentor_id").agg(F.count(F.lit(1)).alias("assigned"))
    out = lookup(summary, n, ["mentor_id"], ["assigned"], "left").withColumn("assigned", F.coalesce("assigned", F.lit(0)))
    new = F.coalesce("allocations_new", F.col("assigned"))
    bad = out.where(F.col("assigned") > F.coalesce("remaining_capacity", F.lit(0)) + new)
    return _rows(bad, "ALLOC_01", F.col("mentor_id"), F.concat_ws("/", F.col("assigned").cast("string"), F.col("remaining_capacity").cast("string"), new.cast("string")))


def history_channel_01(history: DataFrame) -> DataFrame:
    """History key canonical and unique per channel."""
    h = history.select(ids.national_code("national_code").alias("code"), F.upper(F.trim("allocation_channel")).alias("channel"))
    bad = h.agg(F.count_if(F.col("code").isNull()).alias("n")).where(F.col("n") > 0)
    dup = h.where(F.col("code").isNotNull() & F.col("channel").isNotNull()).groupBy("code", "channel").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    rep = dup.agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return _rows(bad, "HISTORY_CHANNEL_01", F.lit("invalid"), F.col("n")).unionByName(_rows(rep, "HISTORY_CHANNEL_01", F.lit("duplicate"), F.col("n")))


def pool_coverage_01(preflight: DataFrame) -> DataFrame:
    """Students without any candidate, with the first failing stage."""
    bad = preflight.where(F.col("candidate_count_final") == 0)
    return _rows(bad, "POOL_COVERAGE_01", F.col("student_id"), F.concat_ws("|", F.coalesce("first_failing_stage", F.lit("capacity_gate")), F.col("expected_value").cast("string")))


def pool_diversity_01(pool: DataFrame) -> DataFrame:
    cols = [c for c in ("group_code", "gender_code", "grad_status_code") if c in pool.columns]
    wide = pool.agg(*[F.countDistinct(c).alias(c) for c in cols])
    items = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("n")) for c in cols])
    bad = wide.select(F.explode(items).alias("x")).select("x.*").where(F.col("n") <= 1)
    return _rows(bad, "POOL_DIVERSITY_01", F.col("k"), F.col("n"), "warning")


def allocation_audit(alloc: DataFrame, logs: DataFrame, trace: DataFrame, policy: Policy | None = None, stages: int = 8) -> DataFrame:
    """Six counts: virtual mentors, stuck capacity, incomplete trace, duplicate ids, counter overflow, years."""
    sid = F.col("student_id").cast("string")
    counter = F.when(sid.rlike("^[0-9]{9}$"), sid)
    a = alloc.agg(
        F.count_if(governance.is_virtual("mentor_name", F.col("alias"), policy) | governance.is_virtual("mentor_name", F.col("mentor_id"), policy)).alias("virtual_mentors"),
        F.count_if(counter.endswith("9999")).alias("counter_overflow"),
        F.countDistinct(F.substring(counter, 1, 2)).alias("y"),
    )
    a = a.select("virtual_mentors", "counter_overflow", F.when(F.col("y") > 1, F.col("y")).otherwise(F.lit(0).cast("bigint")).alias("year_ambiguity"))
    stuck = logs.agg(F.count_if(F.col("capacity_before") == F.col("capacity_after")).alias("capacity_stuck"))
    per = trace.groupBy("student_id").agg(F.countDistinct("stage").alias("n"), F.bool_and("matched").alias("ok"))
    bad = per.agg(F.count_if((F.col("n") < stages) | ~F.col("ok")).alias("trace_mismatch"))
    dup = alloc.where(F.col("student_id").isNotNull()).groupBy("student_id").count().where(F.col("count") > 1).agg(F.count(F.lit(1)).alias("duplicate_student_ids"))
    a = a.unpivot([], ["virtual_mentors", "counter_overflow", "year_ambiguity"], "check", "count")
    rest = [d.select(F.lit(d.columns[0]).alias("check"), F.col(d.columns[0]).alias("count")) for d in (stuck, bad, dup)]
    out = a
    for d in rest:
        out = out.unionByName(d)
    return out.select("check", F.col("count").cast("bigint").alias("count"))


def run_all(rules: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All violation rows, and per rule the counts and pass flag (rules without rows pass)."""
    spark = next(iter(rules.values())).sparkSession
    rows = None
    for df in rules.values():
        rows = df if rows is None else rows.unionByName(df)
    known = spark.createDataFrame([(r,) for r in rules], "rule_id string")
    counts = rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("level") == "error").alias("e"))
    out = lookup(known, counts, ["rule_id"], ["n", "e"], "left")
    zero = F.lit(0).cast("bigint")
    n, e = F.coalesce("n", zero), F.coalesce("e", zero)
    passed = F.when(F.col("rule_id").isin(*WARN_ONLY), e == 0).otherwise(n == 0)
    return rows, out.select("rule_id", n.alias("violations"), passed.alias("passed"))


def overall(summary: DataFrame) -> DataFrame:
    return summary.agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("rules"), F.sum("violations").cast("bigint").alias("violations"))


# Columns the allocation output must have.
ALLOCATION_COLUMNS = ("student_id", "student_national_code", "mentor", "mentor_id", "mentor_alias_code")


def output_contract(alloc: DataFrame, pool: DataFrame, trace_issues: DataFrame) -> DataFrame:
    """Columns, integer keys, capacity and trace order of an allocation output."""
    spark = alloc.sparkSession
    missing = [("OUTPUT_CONTRACT", "error", c, "missing column") for c in ALLOCATION_COLUMNS if c not in alloc.columns]
    types = dict(pool.dtypes)
    missing += [("OUTPUT_CONTRACT", "error", k, "not an integer key") for k in KEYS if types.get(k) not in ("bigint", "int")]
    negative = pool.where(F.col("remaining_capacity") < 0)
    out = _rows(negative, "OUTPUT_CONTRACT", F.col("mentor_id"), F.lit("negative capacity"))
    out = out.unionByName(_rows(trace_issues, "OUTPUT_CONTRACT", F.col("student_id"), F.col("issue")))
    return out.unionByName(spark.createDataFrame(missing, SCHEMA)) if missing else out


def severity(level):
    """P0 / P1 / P2 of a level word."""
    s = F.lower(F.trim(F.col(level) if isinstance(level, str) else level))
    return F.when(s.isin("p0", "error", "critical", "fatal"), F.lit("P0")).when(s.isin("p1", "warning", "warn"), F.lit("P1")).otherwise(F.lit("P2"))


def severity_health(violations: DataFrame) -> DataFrame:
    """ERROR when any P0, WARN when any P1, else OK."""
    s = violations.withColumn("s", severity("level"))
    out = s.agg(*[F.count_if(F.col("s") == p).cast("bigint").alias(p.lower()) for p in ("P0", "P1", "P2")])
    return out.withColumn("status", F.when(F.col("p0") > 0, F.lit("ERROR")).when(F.col("p1") > 0, F.lit("WARN")).otherwise(F.lit("OK")))


def run_health(runs: DataFrame, summary: DataFrame, details: DataFrame) -> DataFrame:
    """Health per run from recorded evidence; negative evidence wins, absence is never OK.

    ``runs``: run_id, status, qa_passed, qa_violations. ``summary``: run_id, rule status.
    ``details``: run_id, level.
    """
    s = summary.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rules"), F.bool_or(F.upper("status") == "FAIL").alias("failed"), F.bool_or(F.upper("status") == "WARN").alias("warned")
    ).withColumnRenamed("rules", "n_rules")
    d = details.withColumn("s", severity("level")).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_details"), F.count_if(F.col("s") == "P0").alias("n_p0"), F.count_if(F.col("s") == "P1").alias("n_p1")
    )
    out = lookup(runs, s, ["run_id"], ["n_rules", "failed", "warned"], "left")
    out = lookup(out, d, ["run_id"], ["n_details", "n_p0", "n_p1"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    b = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.lower(F.coalesce("status", F.lit("")))
    health = (
        F.when(state == "failed", F.lit("ERROR"))
        .when(state != "success", F.lit("UNVERIFIED"))
        .when((n("n_p0") > 0) | b("failed") | (F.col("qa_passed") == F.lit(False)), F.lit("ERROR"))
        .when((n("n_p1") > 0) | b("warned"), F.lit("WARN"))
        .when(F.col("qa_passed").isNull() | (n("n_rules") == 0) | (n("qa_violations") != n("n_details")) | (n("qa_violations") > 0), F.lit("UNVERIFIED"))
        .otherwise(F.lit("OK"))
    )
    return out.select("run_id", health.alias("health"))
