"""Explanations: stage traces, failure stages, available values, rules, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.config import KEYS, STAGES, Policy
from matchloom.functions import text
from matchloom.operators import matching as M
from matchloom.operators.governance import effective_status
from matchloom.operators.numbering import last_row, lookup
from matchloom.operators.predicates import stage_predicates

STAGE_KEY = dict(zip(STAGES, ("group_code", *KEYS)))
# Reason code of a stage without candidates.
REASONS = dict(zip(STAGES, (
    "TYPE_MISMATCH", "GROUP_MISMATCH", "GENDER_MISMATCH", "GRADUATION_STATUS_MISMATCH", "CENTER_MISMATCH",
    "FINANCE_MISMATCH", "SCHOOL_STATUS_MISMATCH", "CAPACITY_FULL",
)))


def trace_long(funnel: DataFrame) -> DataFrame:
    """Eight rows per student from the wide funnel."""
    items = []
    for i, s in enumerate(STAGES):
        before = F.col("pool_rows") if i == 0 else F.col(f"n_{STAGES[i - 1]}")
        after = F.col(f"n_{s}")
        expected = F.lit(">0") if s == "capacity_gate" else F.col(STAGE_KEY[s]).cast("string")
        items.append(
            F.struct(
                F.lit(i + 1).alias("stage_no"), F.lit(s).alias("stage"), before.cast("bigint").alias("total_before"),
                after.cast("bigint").alias("total_after"), (after > 0).alias("matched"), expected.alias("expected_value"),
            )
        )
    return funnel.select("student_id", F.explode(F.array(*items)).alias("x")).select("student_id", "x.*")


def first_failing(names=STAGES) -> Column:
    """First stage of a wide funnel without candidates, null when there is none."""
    out = F.lit(None).cast("string")
    for s in reversed(names):
        out = F.when(F.col(f"n_{s}") == 0, F.lit(s)).otherwise(out)
    return out


def trace_summary(trace: DataFrame, log: DataFrame, order: str) -> DataFrame:
    """One row per student: pass flags, failure stage, counts, reason of the last log row."""
    flags = trace.groupBy("student_id").agg(
        F.min_by("stage", F.when(~F.col("matched"), F.col("stage_no"))).alias("failure_stage"),
        *[F.coalesce(F.bool_or(F.when(F.col("stage") == s, F.col("matched"))), F.lit(False)).alias(f"passed_{s}") for s in STAGES],
        F.max(F.when(F.col("stage") == "school", F.col("total_after"))).alias("candidate_count"),
        F.max(F.when(F.col("stage") == "capacity_gate", F.col("total_after"))).alias("capacity_candidate_count"),
    )
    last = last_row(log.select("student_id", "allocation_status", "error_type", order), ["student_id"], [order]).drop(order)
    out = lookup(flags, last, ["student_id"], ["allocation_status", "error_type"], "left")
    return out.withColumn("has_candidates", F.col("candidate_count") > 0).withColumn(
        "final_reason", F.coalesce("error_type", F.lit(""))
    )


# Stage whose bucket holds the rows that reach ``stage``, and the value it tests.
_REACH = {"type": 0, "gender": 2, "graduation_status": 3, "center": 4, "finance": 5, "school": 6}


def _stage_values(classes: DataFrame, pool: DataFrame, policy: Policy | None) -> tuple[DataFrame, DataFrame]:
    """(class, stage, bucket reaching it) and (stage, bucket, value, constraint)."""
    prof = M.pool_profiles(pool)
    flag = F.coalesce(F.col("has_school_constraint"), F.lit(False)) if "has_school_constraint" in prof.columns else F.lit(False)
    prof = prof.withColumn("constraint", flag)
    keyed = M._stage_keys(M.pool_keys(prof, policy))
    nxt = {v: k for k, v in _REACH.items()}
    stage = F.lit(None).cast("string")
    value = F.lit(None).cast("bigint")
    for no, name in nxt.items():
        if no:
            stage = F.when(F.col("stage_no") == no, F.lit(name)).otherwise(stage)
            value = F.when(F.col("stage_no") == no, F.col(STAGE_KEY[name])).otherwise(value)
    vals = keyed.select(stage.alias("stage"), "bucket", value.alias("value"), "constraint").where(F.col("stage").isNotNull())
    root = prof.select(F.lit("type").alias("stage"), F.lit("").alias("bucket"), F.col("group_code").alias("value"), "constraint")
    vals = vals.unionByName(root).where(F.col("value").isNotNull()).distinct()
    # Ten values are reported. A class passes at most two values of a stage, or one finance
    # cluster, within a constraint flag it does not pass as a whole, so this many smallest
    # values per bucket always contain the ten it needs.
    keep = 10 + max(2, len((policy or Policy()).finance_clusters()) + 1)
    w = W.partitionBy("stage", "bucket", "constraint").orderBy("value")
    vals = vals.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")
    c = M._stage_keys(M.student_keys(classes.select("class_key", *KEYS), policy))
    reach = c.select("class_key", *KEYS, stage.alias("stage"), "bucket").where(F.col("stage").isNotNull())
    reach = reach.unionByName(classes.select("class_key", *KEYS, F.lit("type").alias("stage"), F.lit("").alias("bucket")))
    return reach, vals


def _smallest(df: DataFrame, by: list[str], value: str, k: int = 10) -> DataFrame:
    """Up to ``k`` smallest distinct values per key; the limit is applied before the shuffle."""
    w = W.partitionBy(*by).orderBy(value)
    top = df.select(*by, value).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"))


def available_values(classes: DataFrame, pool: DataFrame, failing: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Up to ten smallest mentor values at the failing stage of each class."""
    reach, vals = _stage_values(classes, pool, policy)
    hit = reach.join(failing.select("class_key", "stage"), ["class_key", "stage"]).join(vals, ["stage", "bucket"])
    return _smallest(hit, ["class_key"], "value")


def alignment_preflight(students: DataFrame, pool: DataFrame, limit: int | None = None, policy: Policy | None = None) -> DataFrame:
    """Funnel per student with the first failing join stage, expected and available values.

    ``limit`` keeps the first ids, as a report option; the default covers everybody.
    """
    chosen = students.orderBy("student_id").limit(limit) if limit else students
    classes = M.class_funnel(M.student_classes(chosen), pool, policy)
    classes = classes.withColumn("stage", first_failing(STAGES[:-1]))
    expected = F.lit(None).cast("bigint")
    for s in STAGES[:-1]:
        expected = F.when(F.col("stage") == s, F.col(STAGE_KEY[s])).otherwise(expected)
    classes = classes.withColumn("expected_value", expected)
    values = available_values(classes, pool, classes.where(F.col("stage").isNotNull()), policy)
    per_class = lookup(classes, values, ["class_key"], ["values"], "left")
    names = [f"n_{s}" for s in STAGES]
    out = lookup(chosen.withColumn("class_key", M.class_key()), per_class, ["class_key"], [*names, "stage", "expected_value", "values"])
    size = pool.agg(F.count(F.lit(1)).alias("candidate_count_initial"))
    return out.join(F.broadcast(size)).withColumnRenamed("stage", "first_failing_stage").withColumn(
        "candidate_count_final", F.col("n_capacity_gate")
    ).withColumn("available_values", F.coalesce(F.array_join(F.col("values").cast("array<string>"), ","), F.lit(""))).drop("class_key", "values")


def preflight_abort(report: DataFrame, share: float = 0.7) -> DataFrame:
    """True when most students have no candidate and most of those fail at the first stage."""
    none = F.col("candidate_count_final") == 0
    out = report.agg(
        F.count(F.lit(1)).alias("students"), F.count_if(none).alias("without_candidates"),
        F.count_if(none & (F.col("first_failing_stage") == "type")).alias("failing_at_type"),
    )
    a = F.coalesce(F.try_divide(F.col("without_candidates").cast("double"), F.col("students").cast("double")), F.lit(0.0))
    b = F.coalesce(F.try_divide(F.col("failing_at_type").cast("double"), F.col("without_candidates").cast("double")), F.lit(0.0))
    return out.withColumn("abort", (a >= share) & (b >= share))


def mismatch_details(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Per class: the failing stage with all values, else the first narrowing stage with dropped values."""
    classes = M.class_funnel(M.student_classes(students), pool, policy)
    size = pool.agg(F.count(F.lit(1)).alias("pool_rows"))
    classes = classes.join(F.broadcast(size))
    fail = first_failing(STAGES[:-1])
    narrow = F.lit(None).cast("string")
    for i in reversed(range(7)):
        before = F.col("pool_rows") if i == 0 else F.col(f"n_{STAGES[i - 1]}")
        narrow = F.when(F.col(f"n_{STAGES[i]}") < before, F.lit(STAGES[i])).otherwise(narrow)
    tagged = classes.withColumn("fails", fail.isNotNull()).withColumn("stage", F.coalesce(fail, narrow)).where(F.col("stage").isNotNull())
    reach, vals = _stage_values(tagged, pool, policy)
    hit = reach.join(tagged.select("class_key", "stage", "fails"), ["class_key", "stage"]).join(vals, ["stage", "bucket"])
    # One row per value: test the stage rule on it.
    m = {k: F.col("value") for k in KEYS} | {"has_school_constraint": F.col("constraint")}
    rule = stage_predicates(lambda k: F.col(k), lambda k: m[k], policy)
    passes = F.lit(False)
    for s in _REACH:
        passes = F.when(F.col("stage") == s, rule[s]).otherwise(passes)
    kept = hit.where(F.col("fails") | ~passes)
    return lookup(tagged, _smallest(kept, ["class_key"], "value"), ["class_key"], ["values"], "left").select(
        "class_key", "stage", "fails", F.coalesce(F.array_join(F.col("values").cast("array<string>"), ","), F.lit("")).alias("mentor_values")
    )


def stage_rules(trace: DataFrame) -> DataFrame:
    """Rule result per stage row: guard on the counts, then the stage's reason code."""
    code = F.lit(None).cast("string")
    for s, r in REASONS.items():
        code = F.when(F.col("stage") == s, F.lit(r)).otherwise(code)
    broken = F.col("total_before").isNull() | F.col("total_after").isNull() | (F.col("total_before") < F.col("total_after")) | (F.col("total_after") < 0) | code.isNull()
    passed = ~broken & (F.col("total_after") > 0)
    return trace.withColumn("passed", passed).withColumn(
        "reason_code", F.when(broken, F.lit("INTERNAL_ERROR")).when(passed, F.lit("OK")).otherwise(code)
    )


def phase_rule(pairs: DataFrame) -> DataFrame:
    """Center rule of a (student, mentor) pair; school students are exempt."""
    allowed = F.array_distinct(F.array_compact(F.concat(F.coalesce("allowed_centers", F.array().cast("array<bigint>")), F.array("mentor_center"))))
    reason = (
        F.when(F.coalesce("is_school_student", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("student_center").isNull(), F.lit("INVALID_CENTER_VALUE"))
        .when(F.size(allowed) == 0, F.lit("NO_MANAGER_FOR_CENTER"))
        .when(~F.array_contains(allowed, F.col("student_center")), F.lit("CENTER_MISMATCH"))
    )
    return pairs.withColumn("reason", reason)


def alerts(log: DataFrame) -> DataFrame:
    """One alert for the first failing stage, plus one for an invalid center."""
    join_stage = first_failing(STAGES[:-1])
    stage = F.when(F.col("error_type") == "ELIGIBILITY_NO_MATCH", join_stage).when(
        (F.col("error_type") == "CAPACITY_FULL") & (F.col("n_capacity_gate") == 0), F.lit("capacity_gate")
    )
    items = F.array_compact(
        F.array(
            F.when(stage.isNotNull(), F.struct(F.col("error_type").alias("code"), stage.alias("stage"))),
            F.when(F.col("invalid_center"), F.struct(F.lit("INVALID_CENTER").alias("code"), F.lit("center").alias("stage"))),
        )
    )
    return log.select("student_id", F.explode(items).alias("x")).select("student_id", "x.*")


# Segments of the reason text.
TIEBREAK = "1) ظرفیت مطلق باقی‌مانده بیشتر → 2) تخصیص جدید کمتر → 3) شناسه پشتیبان (مرتب‌سازی طبیعی)"


def trace_text(trace: DataFrame, labels: dict[str, str]) -> DataFrame:
    """'label=after' steps joined in stage order; at most eight per student."""
    name = F.lit(None).cast("string")
    for s, v in labels.items():
        name = F.when(F.col("stage") == s, F.lit(v)).otherwise(name)
    steps = trace.groupBy("student_id", "stage_no", "stage").agg(F.max_by("total_after", "stage_no").alias("n"))
    step = F.struct("stage_no", F.concat(name, F.lit("="), F.col("n").cast("string")).alias("t"))
    return steps.groupBy("student_id").agg(F.array_sort(F.collect_list(step)).alias("s")).select(
        "student_id", F.array_join(F.transform("s", lambda x: x["t"]), "→").alias("trace_text")
    )


# Student columns by precedence, and what marks an after-school student.
SCHOOL_COLUMNS = ("school_name", "school_name_1", "school_code")
TRACK_COLUMNS = ("exam_group", "group_name", "group_code")
AFTER_SCHOOL_COLUMNS = ("after_school", "after_school_flag")
YES_WORDS = ("1", "true", "بله", "yes", "y", "t")
REASON_LABELS = {
    "gender": "جنسیت", "school": "مدرسه", "track": "رشته/گروه", "capacity": "ظرفیت", "result": "نتیجه", "tiebreak": "سیاست رتبه‌بندی", "steps": "مراحل",
}
REASON_CHARS = 512


def selection_reasons(
    alloc: DataFrame, students: DataFrame, mentors: DataFrame, trace: DataFrame, labels: dict[str, str],
    reason_labels: dict[str, str] | None = None, with_steps: bool = False, max_chars: int | None = REASON_CHARS,
) -> DataFrame:
    """Reason text per allocation: gender, school, track, capacity, result, tie break, steps.

    Names of school and group come before their codes; an after-school student is marked.
    ``with_steps`` puts the steps into the text too; ``max_chars=None`` leaves it whole.
    """
    say = REASON_LABELS | (reason_labels or {})
    filled = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in students.columns], F.lit(""))
    s = students.select("student_id", F.col("gender_code").alias("g"), filled(SCHOOL_COLUMNS).alias("sc"), filled(TRACK_COLUMNS).alias("gr"), filled(AFTER_SCHOOL_COLUMNS).alias("late"))
    m = mentors.groupBy("mentor_id").agg(F.max("mentor_name").alias("mentor_name"))
    out = alloc.join(s, "student_id", "left").join(m, "mentor_id", "left").join(trace_text(trace, labels), "student_id", "left")
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    gender = F.when(F.col("g") == 0, F.lit("دختر")).when(F.col("g") == 1, F.lit("پسر")).otherwise(F.lit("نامشخص"))
    capacity = F.concat_ws(
        "، ",
        F.when(F.col("capacity_before").isNotNull(), F.concat(F.lit("alloc_new="), (F.col("capacity_before") - F.col("capacity_after")).cast("string"))),
        F.when(F.col("capacity_after").isNotNull(), F.concat(F.lit("remaining="), F.col("capacity_after").cast("string"))),
    )
    late = F.when(F.lower(t("late")).isin(*YES_WORDS), F.lit("بله")).otherwise(F.lit("خیر"))
    segments = {
        "gender": gender,
        "school": F.concat(t("sc"), F.lit(" (پس‌مدرسه‌ای: "), late, F.lit(")")),
        "track": t("gr"),
        "capacity": capacity,
        "result": F.concat(F.coalesce("mentor_name", t("mentor_id")), F.lit(" ("), t("mentor_id"), F.lit(")")),
        "tiebreak": F.lit(TIEBREAK),
    }
    parts = [F.concat(F.lit(f"{say[k]}: "), v) for k, v in segments.items()]
    if with_steps:
        parts.append(F.when(t("trace_text") != "", F.concat(F.lit(f"{say['steps']}: "), t("trace_text"))))
    line = F.concat_ws(" — ", *parts)
    reason = text.fa_digits(line) if max_chars is None else text.safe_truncate(line, max_chars)
    return out.select("student_id", "mentor_id", reason.alias("reason"), text.fa_digits(t("trace_text")).alias("steps"))


def bucket_stats(students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Per class: how many buckets it reads, how many are filled, rows in them."""
    rows = M.with_bucket(M.pool_keys(M.pool_profiles(pool), policy)).groupBy("bucket").agg(F.sum("rows").alias("rows"))
    cls = M.with_bucket(M.student_keys(M.student_classes(students).select("class_key", *KEYS), policy)).select("class_key", "bucket")
    out = lookup(cls, rows, ["bucket"], ["rows"], "left")
    return out.groupBy("class_key").agg(
        F.count(F.lit(1)).alias("buckets"), F.count("rows").alias("filled_buckets"), F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("bucket_rows")
    )


def trace_ladder(trace: DataFrame, students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Stage rows with the class's bucket statistics."""
    stats = bucket_stats(students, pool, policy)
    cls = lookup(students.select("student_id", M.class_key().alias("class_key")), stats, ["class_key"], ["buckets", "filled_buckets", "bucket_rows"], "left")
    return lookup(trace, cls, ["student_id"], ["buckets", "filled_buckets", "bucket_rows"], "left")


def row_digest(columns) -> Column:
    """Sixty bits of the MD5 of the columns as text; digests add up in any order."""
    text_ = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text_), 1, 15), 16, 10).cast("decimal(38,0)")


def pipeline_trace(df: DataFrame, stages: list[tuple[str, Column]], columns: list[str], first: str = "source", copies: str | None = None, all_digests: str | None = None) -> DataFrame:
    """stage_no, stage, rows, removed and fingerprint of every stage, from one scan and one aggregate.

    Each stage is a keep condition; a row carries the number of the first stage that removes it (a null
    condition removes too), and stage k has the rows that no stage up to k removed. ``copies`` and ``all_digests``
    name columns with the rows, and the sum of their digests, that a deduplicated row stands for: then stage
    2 is ``deduplicate`` and counts one row each.
    """
    removed_at = F.lit(len(stages) + 1)
    for i, (_, keep) in reversed(list(enumerate(stages))):
        removed_at = F.when(F.coalesce(keep, F.lit(False)), removed_at).otherwise(F.lit(i))
    flagged = df.select(removed_at.alias("__at"), row_digest(columns).alias("__d"), *[F.col(c) for c in (copies, all_digests) if c])
    whole = F.lit(1) if copies is None else F.col(copies)
    names = [first, *(["deduplicate"] if copies else []), *[n for n, _ in stages]]
    total = lambda v: F.coalesce(F.sum(v), F.lit(0))
    sums = [(total(whole), total(F.col(all_digests) if all_digests else F.col("__d")))]
    if copies:
        sums.append((F.count(F.lit(1)), total(F.col("__d"))))
    for i in range(len(stages)):
        left = F.col("__at") > i
        sums.append((F.count_if(left), total(F.when(left, F.col("__d")))))
    one = flagged.agg(*[c.cast("decimal(38,0)").alias(f"{k}{i}") for i, pair in enumerate(sums) for k, c in zip("nd", pair, strict=True)])
    rows = [
        F.struct(
            F.lit(i + 1).alias("stage_no"), F.lit(name).alias("stage"), F.col(f"n{i}").cast("bigint").alias("rows"),
            ((F.col(f"n{i - 1}") - F.col(f"n{i}")).cast("bigint") if i else F.lit(0).cast("bigint")).alias("removed"), F.col(f"d{i}").cast("string").alias("fingerprint"),
        )
        for i, name in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def governance_trace(pool: DataFrame, order: str, disabled: DataFrame | None = None, status: str | None = None, policy: Policy | None = None, keys=KEYS) -> DataFrame:
    """Trace of the pool's governance: duplicate profiles, disabled managers, status, capacity.

    The first row of each profile is taken in the same aggregate that counts and digests its copies.
    """
    profile = ["mentor_id", *[k for k in keys if k in pool.columns]]
    columns = [*profile, order]
    rest = [c for c in pool.columns if c not in profile]
    grouped = pool.groupBy(*profile).agg(
        F.min_by(F.struct(*rest), F.col(order)).alias("__row"), F.count(F.lit(1)).alias("__copies"), F.sum(row_digest(columns)).alias("__all")
    ).select(*profile, "__row.*", "__copies", "__all")
    tagged = effective_status(grouped, None, None, status, policy)
    stages = []
    if disabled is not None:
        off = disabled.select(text.norm_text("manager").alias("__off")).distinct().withColumn("__is_off", F.lit(True))
        tagged = tagged.withColumn("__m", text.norm_text("manager")).join(off, F.col("__m") == F.col("__off"), "left")
        stages.append(("manager_filter", F.col("__is_off").isNull()))
    stages += [("status_filter", F.col("effective_status") == "ACTIVE"), ("capacity_filter", F.col("remaining_capacity") > 0)]
    return pipeline_trace(tagged, stages, columns, "pool", "__copies", "__all")


def trace_order_check(trace: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows that break the stage order of their student.

    Rows carry a dense sequence per student, so the row before is an equi join on
    (student, sequence) and a student with very many rows is no hot key.
    """
    no = F.lit(None).cast("int")
    for i, s in enumerate(STAGES):
        no = F.when(F.col("stage") == s, F.lit(i + 1)).otherwise(no)
    cur = trace.select("student_id", F.col(seq).alias("seq"), "stage", no.alias("stage_no"))
    prev = cur.select("student_id", (F.col("seq") + 1).alias("seq"), F.col("stage_no").alias("prev_no"))
    out = lookup(cur, prev, ["student_id", "seq"], ["prev_no"], "left")
    issue = (
        F.when(F.col("stage_no").isNull(), F.lit("TRACE_UNKNOWN_STAGE"))
        .when(F.col("stage_no") == 1, F.lit(None).cast("string"))
        .when(F.col("prev_no").isNull() | (F.col("prev_no") == len(STAGES)) | (F.col("stage_no") < F.col("prev_no")), F.lit("TRACE_STAGE_ORDER"))
    )
    return out.withColumn("issue", issue).where(F.col("issue").isNotNull()).drop("prev_no", "stage_no")
