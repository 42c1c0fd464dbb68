"""Audits that compare allocations with students and pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy
from matchloom.functions import keys as keyfn
from matchloom.operators import predicates as P
from matchloom.operators.numbering import lookup

LETTERS = {"group_code": "group", "gender_code": "gender", "grad_status_code": "status",
           "center_code": "center", "finance_code": "finance", "school_code": "school"}
CHECKS = ("all", *LETTERS.values())


def _owners(alloc: DataFrame, pool: DataFrame) -> DataFrame:
    """Mentor reference of every allocation row: by id, else by alias, else missing."""
    ids = pool.select(F.trim(F.col("mentor_id").cast("string")).alias("__id")).distinct().withColumn("__by_id", F.lit(True))
    out = lookup(alloc.withColumn("__id", F.trim(F.col("mentor_id").cast("string"))), ids, ["__id"], ["__by_id"], "left")
    known = F.lit(False)
    if "alias" in pool.columns and "alias" in alloc.columns:
        al = pool.select(F.trim("alias").alias("__al")).where(F.col("__al") != "").distinct().withColumn("__by_alias", F.lit(True))
        out = lookup(out.withColumn("__al", F.trim("alias")), al, ["__al"], ["__by_alias"], "left")
        known = F.coalesce("__by_alias", F.lit(False))
    else:
        out = out.withColumn("__al", F.lit(None).cast("string")).withColumn("__by_alias", F.lit(None).cast("boolean"))
    by_id = F.coalesce("__by_id", F.lit(False))
    owner = F.when(by_id, F.concat(F.lit("I:"), "__id")).when(known, F.concat(F.lit("A:"), "__al"))
    mode = F.when(by_id, F.lit("mentor_id")).when(known, F.lit("mentor_alias")).otherwise(F.lit("missing"))
    return out.withColumn("owner", owner).withColumn("lookup_mode", mode).drop("__id", "__al", "__by_id", "__by_alias")


def _pool_by_owner(pool: DataFrame, side: tuple) -> DataFrame:
    """What the profiles of a mentor accept, under both of its references: one row, with the distinct values of every check."""
    refs = [F.concat(F.lit("I:"), F.trim(F.col("mentor_id").cast("string")))]
    if "alias" in pool.columns:
        refs.append(F.when(F.trim("alias") != "", F.concat(F.lit("A:"), F.trim("alias"))))
    extra = ["has_school_constraint"] if "has_school_constraint" in pool.columns else []
    profiles = pool.select(F.explode(F.array_compact(F.array(*refs))).alias("owner"), *KEYS, *extra).distinct()
    accepted = profiles.select("owner", *[v.alias(f"__m_{n}") for n, v in _checks(*side).items()])
    return accepted.groupBy("owner").agg(*[F.array_distinct(F.flatten(F.collect_set(f"__m_{n}"))).alias(f"__m_{n}") for n in CHECKS])


def _t(name: str) -> Column:
    return F.col(name).cast("string")


def _checks(one: dict[str, Column], many: dict[str, Column]) -> dict[str, Column]:
    """Accepted values by check, as arrays of texts: each key, and ``all`` for the six keys together.

    ``one`` holds keys with a single text (null accepts nothing), ``many`` keys with an
    array of texts (center and school, at most two and three).
    """
    out = {LETTERS[k]: F.array_compact(F.array(v)) for k, v in one.items()} | {LETTERS[k]: F.array_compact(v) for k, v in many.items()}
    prefix = F.concat(*[F.concat(v, F.lit("|")) for v in one.values()])
    if not many:
        return out | {"all": F.array_compact(F.array(prefix))}
    a, b = many.values()
    whole = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(prefix, x, F.lit("|"), y))))
    return out | {"all": F.array_compact(whole)}


def _audit(alloc: DataFrame, students: DataFrame, pool: DataFrame, student_side: tuple, pool_side: tuple) -> DataFrame:
    """Flag columns per allocation row.

    A key matches when some profile of the mentor shares an accepted value, the row when
    one profile shares all six. A mentor is one row with the distinct values that its profiles
    accept, so an allocation meets one student and one mentor and is never multiplied.
    """
    s = students.select("student_id", *[F.col(k) for k in KEYS])
    base = lookup(_owners(alloc.drop(*KEYS), pool), s, ["student_id"], list(KEYS), "left")
    both = lookup(base, _pool_by_owner(pool, pool_side), ["owner"], [f"__m_{n}" for n in CHECKS], "left")
    asked = _checks(*student_side)
    flags = {f"match_{n}": F.coalesce(F.arrays_overlap(asked[n], F.col(f"__m_{n}")), F.lit(False)) for n in CHECKS}
    return both.select(*base.columns, *[v.alias(n) for n, v in flags.items()]).withColumnRenamed("match_all", "valid")


def _summary(audit: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(*[F.when(~F.col(f"match_{n}"), F.lit(n)) for n in LETTERS.values()]))
    return audit.withColumn("mismatch_summary", F.when(F.col("valid"), F.lit("")).otherwise(F.array_join(missing, ",")))


def join_key_audit(alloc: DataFrame, students: DataFrame, pool: DataFrame) -> DataFrame:
    """Strict equality of the six keys for every allocation row."""
    exact = ({k: _t(k) for k in KEYS}, {})
    return _summary(_audit(alloc, students, pool, exact, exact))


def join_key_audit_wildcard(alloc: DataFrame, students: DataFrame, pool: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Same audit with mentor-side center wildcard, school wildcards and finance clusters.

    Judged per student: one matching row clears the student. The school rule uses the
    widest constraint flag of the mentor.
    """
    if "has_school_constraint" in pool.columns:
        wide = pool.groupBy("mentor_id").agg(F.max("has_school_constraint").alias("__w"))
        pool = lookup(pool, wide, ["mentor_id"], ["__w"]).withColumn("has_school_constraint", F.col("__w")).drop("__w")
        free = ~F.coalesce(F.col("has_school_constraint"), F.lit(True))
    else:
        free = F.lit(False)
    none = F.array().cast("array<string>")
    one = {k: _t(k) for k in KEYS if k not in ("center_code", "school_code")}
    one["finance_code"] = keyfn.finance_cluster("finance_code", policy).cast("string")
    unknown = F.col("school_code").isNull()
    student = (one, {
        "center_code": F.array_distinct(F.array_compact(F.array(F.lit("0"), _t("center_code")))),
        "school_code": F.when(unknown, none).when(F.col("school_code") == 0, F.array(F.lit("*"))).otherwise(
            F.array(F.lit("free"), F.lit("0"), _t("school_code"))
        ),
    })
    mentor = (one, {
        "center_code": F.array_compact(F.array(_t("center_code"))),
        "school_code": F.when(unknown, none).otherwise(
            F.array(F.lit("*"), F.when(free, F.lit("free")).otherwise(_t("school_code")))
        ),
    })
    rows = _audit(alloc, students, pool, student, mentor)
    return rows.groupBy("student_id").agg(F.max("valid").alias("valid"), *[F.max(f"match_{n}").alias(f"match_{n}") for n in LETTERS.values()])


def audit_summary(audit: DataFrame, limit_ratio: float = 0.0) -> DataFrame:
    """Invalid share of an audit."""
    bad = F.count_if(~F.col("valid"))
    out = audit.agg(bad.alias("invalid_count"), F.count(F.lit(1)).alias("total"))
    ratio = F.coalesce(F.try_divide(F.col("invalid_count").cast("double"), F.col("total").cast("double")), F.lit(0.0))
    return out.withColumn("invalid_ratio", F.round(ratio, 6)).withColumn("passed", ratio <= limit_ratio)


def validate_selected(pairs: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Check one chosen (``s_*``, ``m_*``) row before capacity is consumed.

    Adds ``join_valid`` and ``mismatches`` (column:type, comma separated).
    """
    items = []
    for k in KEYS:
        s, m = F.col(f"s_{k}"), F.col(f"m_{k}")
        if k == "finance_code":
            ok = P.audit_finance(s, m, policy)
        elif k == "center_code":
            ok = P.audit_center(s, m)
        elif k == "school_code":
            ok = P.audit_school(s, m)
        else:
            ok = F.coalesce(s == m, F.lit(False))
        kind = F.when(s.isNull() | m.isNull(), F.lit("missing")).otherwise(F.lit("unequal"))
        # A missing value is a mismatch even where a wildcard would accept it.
        items.append(F.when(s.isNull() | m.isNull() | ~ok, F.concat(F.lit(f"{LETTERS[k]}:"), kind)))
    bad = F.array_compact(F.array(*items))
    return pairs.withColumn("join_valid", F.size(bad) == 0).withColumn("mismatches", F.array_join(bad, ","))


def policy_violations(summary: DataFrame, pool: DataFrame) -> DataFrame:
    """Unallocated, not rule-excluded, although a pool row with equal keys has places."""
    cap = pool.groupBy(*KEYS).agg(F.max("remaining_capacity").alias("max_capacity"))
    out = lookup(summary, cap, list(KEYS), ["max_capacity"], "left")
    return out.where((F.col("max_capacity") > 0) & ~F.col("final_status").isin("ALLOCATED", "RULE_EXCLUDED"))


def success_spine(students: DataFrame, logs: DataFrame, alloc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Allocations aligned by key to successful students; ids in the log that no student has."""
    ok = logs.where(F.lower(F.coalesce("allocation_status", F.lit(""))) == "success")
    ids = ok.select(F.trim(F.col("student_id").cast("string")).alias("student_id")).where(F.col("student_id") != "").distinct()
    spine = students.select(F.trim(F.col("student_id").cast("string")).alias("student_id")).distinct()
    good = spine.join(ids, "student_id", "left_semi")
    view = good.join(
        alloc.withColumn("student_id", F.trim(F.col("student_id").cast("string"))), "student_id", "left"
    )
    return view, ids.join(spine, "student_id", "left_anti")


def export_join(alloc: DataFrame, students: DataFrame, mentors: DataFrame, order: str) -> DataFrame:
    """Allocation rows with ``student_`` and ``mentor_`` columns.

    Repeated mentor rows collapse column by column to the first non-null value in
    ``order``; the row count of ``alloc`` is preserved.
    """
    s = students.select("student_id", *[F.col(c).alias(f"student_{c}") for c in students.columns if c != "student_id"])
    rest = [c for c in mentors.columns if c not in ("mentor_id", order)]
    m = mentors.groupBy("mentor_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"mentor_{c}") for c in rest]
    )
    return alloc.join(s, "student_id", "left").join(m, "mentor_id", "left")


def coalesce_from_summary(students: DataFrame, summary: DataFrame, columns) -> DataFrame:
    """Fill null identity fields from the summary (one row per student)."""
    fresh = summary.select("student_id", *[F.col(c).alias(f"__n_{c}") for c in columns])
    out = students.join(fresh, "student_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__n_{c}"))
    return out.drop(*[f"__n_{c}" for c in columns])


def roster_validate(students: DataFrame, matrix: DataFrame) -> DataFrame:
    """First failing check of every roster row against the matrix.

    ``students``: row_id, alias_norm, school_text, binding, gender_code, status_code,
    expected_center, group_code. Matches go through alias or school keys; the checks are
    nested, so one conditional aggregate gives the first that empties the candidates.
    """
    # Both sides emit the nested prefixes of their keys; a row's answer is how many of its
    # prefixes exist. Profiles collapse to distinct prefixes, so a school with very many
    # students or profiles gives no pairs.
    root = F.when(F.col("mentor_type") == "NORMAL", F.concat(F.lit("N|"), "alias")).when(
        F.col("mentor_type") == "SCHOOL", F.concat(F.lit("S|"), F.col("school_code").cast("string"))
    )
    mat = matrix.select(root.alias("root"), *[F.col(c) for c in ("gender_code", "grad_status_code", "center_code", "group_code")]).where(F.col("root").isNotNull())
    levels = lambda r, *cs: F.array(*[F.concat_ws("|", r, *[F.coalesce(c.cast("string"), F.lit("?")) for c in cs[:i]]) for i in range(len(cs) + 1)])
    m = [F.col(c) for c in ("gender_code", "grad_status_code", "center_code", "group_code")]
    have = mat.distinct().select(F.posexplode(levels(F.col("root"), *m)).alias("level", "prefix")).distinct()
    aliases = mat.where(F.col("root").startswith("N|")).select("root").distinct().withColumn("__alias", F.lit(True))
    named = F.coalesce("school_text", F.lit("")) != ""
    tagged = lookup(students.withColumn("root", F.concat(F.lit("N|"), "alias_norm")), aliases, ["root"], ["__alias"], "left")
    use_normal = (F.col("binding") == "NORMAL") & F.coalesce("__alias", F.lit(False))
    tagged = tagged.withColumn("root", F.when(use_normal, F.col("root")).when(named, F.concat(F.lit("S|"), "school_text")))
    s = [F.col("gender_code"), F.col("status_code"), F.col("expected_center"), F.col("group_code")]
    keys = ["root", "gender_code", "status_code", "expected_center", "group_code"]
    asked = tagged.where(F.col("root").isNotNull()).select(*keys).distinct()
    asked = asked.select(*keys, F.posexplode(levels(F.col("root"), *s)).alias("level", "prefix"))
    depth = asked.join(have, ["level", "prefix"]).groupBy(*keys).agg(F.max("level").alias("depth"))
    out = lookup(tagged, depth, keys, ["depth"], "left")
    d = F.coalesce("depth", F.lit(-1))
    reason = (
        F.when((d < 0) & (F.col("binding") == "NORMAL") & ~named, F.lit("no normal alias match"))
        .when(d < 0, F.lit("no school-code match"))
        .when(d == 0, F.lit("gender mismatch"))
        .when(d == 1, F.lit("status mismatch"))
        .when(d == 2, F.lit("center mismatch (manager-based)"))
        .when(F.col("group_code").isNull(), F.lit("no group code"))
        .when(d == 3, F.lit("group_code mismatch"))
        .otherwise(F.lit("MATCHED"))
    )
    return out.select(*students.columns, reason.alias("reason")).withColumn("match", F.col("reason") == "MATCHED")


def mentor_key_issues(report: DataFrame, bound: DataFrame, centers: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """Six keys of raw mentor rows (first group code only) and the derivation issues."""
    from matchloom.functions import text

    policy = policy or Policy()
    groups = keyfn.parse_group_codes("group_spec")
    joined = lookup(report, bound, ["row_index"], ["bound_codes", "has_school_constraint"], "left")
    joined = lookup(joined, centers, ["row_index"], ["manager_center", "manager_match"], "left")
    legacy_text = F.trim(F.coalesce("legacy_group", F.lit("")))
    legacy = keyfn.parse_group_codes("legacy_group")
    raw_fin = text.int_part("finance_raw")
    fin_ok = raw_fin.isin(*policy.finance_variants)
    out = joined.select(
        "row_index", F.trim("mentor_id").alias("mentor_id"),
        F.when(F.size(groups) > 0, F.get(groups, F.lit(0))).alias("group_code"),
        keyfn.gender("gender_text").alias("gender_code"),
        keyfn.status("status_text").alias("grad_status_code"),
        F.col("manager_center").alias("center_code"),
        F.when(fin_ok, raw_fin).otherwise(F.lit(policy.finance_variants[0]).cast("bigint")).alias("finance_code"),
        F.coalesce(F.get("bound_codes", F.lit(0)), F.lit(0).cast("bigint")).alias("school_code"),
        F.filter(
            F.array(
                F.when(F.size(groups) == 0, F.lit("INVALID_GROUP_CODE")).when(
                    (legacy_text != "") & ((F.size(legacy) == 0) | (legacy != groups)), F.lit("LEGACY_GROUP_CONFLICT")
                ),
                F.when(F.col("has_school_constraint") & (F.size("bound_codes") == 0), F.lit("SCHOOL_NOT_FOUND")),
                F.when(F.col("manager_match") == "manager_wildcard", F.lit("CENTER_FALLBACK_WILDCARD")),
                F.when(
                    F.coalesce("finance_raw", F.lit("")).isin("", "0") | fin_ok, F.lit(None)
                ).otherwise(F.lit("FINANCE_UNKNOWN")),
            ),
            lambda x: x.isNotNull(),
        ).alias("codes"),
    )
    issues = out.select("row_index", "mentor_id", F.explode("codes").alias("reason"))
    return out.drop("codes"), issues
