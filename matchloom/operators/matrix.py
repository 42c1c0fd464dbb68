"""Eligibility matrix: base rows, explode, dedupe, numbering, contracts, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy, group_dim
from matchloom.functions import ids, keys, text
from matchloom.operators import governance
from matchloom.operators.numbering import first_row, lookup, number_rows
from matchloom.operators.references import center_from_manager, school_codes, school_names
from matchloom.session import cut_lineage

SCHOOL_COLUMNS = ("school_code_1", "school_name_1", "school_code_2", "school_name_2",
                  "school_code_3", "school_name_3", "school_code_4", "school_name_4")


def _present(df: DataFrame) -> list[str]:
    return [c for c in SCHOOL_COLUMNS if c in df.columns]


def school_binding(report: DataFrame, schools: DataFrame) -> DataFrame:
    """Add ``bound_codes`` (valid, unique, in column order), ``has_school_constraint``, mode.

    Name cells are resolved through one exploded lookup keyed by folded name.
    """
    cols = _present(report)
    cell = lambda i, c: F.struct(
        F.lit(i).alias("i"), text.to_long(c).alias("n"), text.norm_text(c).alias("k"), keys.no_school(c).alias("empty")
    )
    cells = report.select("row_index", F.explode(F.array(*[cell(i, c) for i, c in enumerate(cols)])).alias("x"))
    cells = cells.select("row_index", "x.*").where(~F.col("empty"))
    named = lookup(cells.withColumn("name_key", F.col("k")), school_names(schools), ["name_key"], ["code"], "left")
    code = F.when(F.col("n") > 0, F.col("n")).otherwise(F.when(F.col("code") > 0, F.col("code")))
    picked = F.array_sort(F.collect_list(F.when(code.isNotNull(), F.struct("i", code.alias("v")))))
    per_row = named.groupBy("row_index").agg(picked.alias("p"))  # at most eight cells per row
    per_row = per_row.select("row_index", F.array_distinct(F.transform("p", lambda x: x["v"])).alias("bound_codes"))
    out = lookup(report, per_row, ["row_index"], ["bound_codes"], "left")
    has = F.col("bound_codes").isNotNull()
    return (
        out.withColumn("has_school_constraint", has)
        .withColumn("binding_mode", keys.binding_mode(F.col("bound_codes").isNotNull()))
        .withColumn("bound_codes", F.coalesce("bound_codes", F.array().cast("array<bigint>")))
    )


def usable_rows(report: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Rows with an id that are allowed to take students."""
    policy = policy or Policy()
    ok = F.trim(F.coalesce("mentor_id", F.lit(""))) != ""
    if "can_allocate" in report.columns:
        ok = ok & F.trim(F.coalesce("can_allocate", F.lit(""))).isin(*policy.can_allocate_tokens)
    return report.where(ok)


def _codes_of(df: DataFrame) -> Column:
    return keys.parse_group_codes("group_spec")


def unseen_groups(report: DataFrame) -> DataFrame:
    """Rows without any valid group: one row per invalid code (or an empty token)."""
    none = usable_rows(report).where(F.size(keys.parse_group_codes("group_spec")) == 0)
    bad = keys.invalid_group_codes("group_spec")
    tokens = F.when(F.size(bad) > 0, F.transform(bad, lambda v: F.concat(F.lit("code:"), v.cast("string")))).otherwise(
        F.array(F.lit(""))
    )
    return none.select("mentor_name", "manager", F.explode(tokens).alias("group_token")).distinct()


def missing_school_codes(bound: DataFrame) -> DataFrame:
    """Rows that promise more schools than valid codes were found."""
    expected = text.numlike_long("school_count")
    return bound.where(F.coalesce(expected, F.lit(0)) > F.size("bound_codes")).select(
        "row_index", "mentor_id", expected.alias("expected_school_count"),
        F.size("bound_codes").cast("bigint").alias("found_school_count"),
    )


def base_rows(report: DataFrame, schools: DataFrame, manager_map: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One row per usable mentor with arrays of groups, genders, statuses, finance, schools."""
    policy = policy or Policy()
    bound = school_binding(usable_rows(report, policy), schools)
    centered = center_from_manager(bound, "manager", manager_map, policy)
    blank_count = F.trim(F.coalesce(F.col("school_count").cast("string"), F.lit(""))) == ""
    expected = F.coalesce(text.numlike_long("school_count"), F.lit(0))
    wanted = F.when(blank_count, F.size("bound_codes")).otherwise(F.greatest(expected, F.lit(0))).cast("int")
    mentor_type = F.when(wanted > 0, F.lit("SCHOOL")).otherwise(F.lit("NORMAL"))
    zero = F.lit(0).cast("bigint")
    covered = F.greatest(F.coalesce(text.numlike_long("covered_now"), zero), zero)
    special = F.greatest(F.coalesce(text.numlike_long("special_limit"), zero), zero)
    genders = F.transform(text.split_tokens("gender_text"), lambda g: keys.gender(g))
    rows = centered.select(
        "row_index",
        F.trim("mentor_id").alias("mentor_id"),
        F.trim(F.coalesce("mentor_name", F.lit(""))).alias("mentor_name"),
        F.trim(F.coalesce("manager", F.lit(""))).alias("manager"),
        F.col("manager_center").alias("center_code"),
        keys.parse_group_codes("group_spec").alias("groups"),
        F.when(F.size(genders) > 0, genders).otherwise(F.array(zero)).alias("genders"),
        F.slice("bound_codes", 1, F.greatest(wanted, F.lit(0))).alias("schools"),
        F.array(*[F.lit(v).cast("bigint") for v in policy.finance_variants]).alias("finance"),
        mentor_type.alias("mentor_type"),
        "binding_mode", "has_school_constraint",
        ids.mentor_alias(mentor_type, "postal_code", F.trim("mentor_id"), policy.postal_range).alias("alias"),
        covered.alias("capacity_current"), special.alias("capacity_special"),
        F.greatest(special - covered, zero).alias("capacity_remaining"),
        (F.when(blank_count, F.lit(False)).otherwise(expected > F.size("bound_codes"))).alias("short_of_schools"),
    )
    return rows.where((F.size("groups") > 0) & ~F.col("short_of_schools")).drop("short_of_schools")


def _statuses(configured, school_branch: bool) -> Column:
    allowed = keys.allowed_statuses("group_code", F.lit(school_branch))
    both = F.array_intersect(F.array(*[F.lit(v).cast("bigint") for v in configured]), allowed)
    return F.when(F.size(both) > 0, both).otherwise(allowed)


def explode_rows(base: DataFrame, branch: str, policy: Policy | None = None) -> DataFrame:
    """Group x gender x status x school x finance rows of one branch, first wins per key."""
    policy = policy or Policy()
    school = branch == "SCHOOL"
    zero = F.lit(0).cast("bigint")
    rows = base.where(F.col("mentor_type") == branch).withColumn("group_code", F.explode("groups"))
    rows = rows.withColumn("gender_code", F.explode("genders"))
    statuses = _statuses(policy.school_statuses if school else policy.normal_statuses, school)
    rows = rows.withColumn("grad_status_code", F.explode(statuses))
    codes = F.when(F.size("schools") > 0, F.col("schools")).otherwise(F.array(zero)) if school else F.array(zero)
    rows = rows.withColumn("school_code", F.explode(codes)).withColumn("finance_code", F.explode("finance"))
    rows = rows.drop("groups", "genders", "schools", "finance")
    return first_row(rows, ["alias", "mentor_id", *KEYS], ["row_index"])


def status_explode(rows: DataFrame, school_branch: str) -> DataFrame:
    """Minimal variant: only the status domain is expanded."""
    dom = keys.allowed_statuses("group_code", school_branch)
    return rows.withColumn("grad_status_code", F.explode(dom))


def candidate_keys(base: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Potential key space of both branches with alias and can-generate flags."""
    policy = policy or Policy()
    zero = F.lit(0).cast("bigint")
    normal_alias = (F.col("mentor_type") == "NORMAL") & F.col("alias").rlike("^[0-9]+$") & F.col("alias").try_cast(
        "bigint"
    ).between(*policy.postal_range)
    school_alias = (F.col("mentor_type") == "SCHOOL") & (F.col("alias") != "")
    wide = base.withColumn("group_code", F.explode("groups")).withColumn("gender_code", F.explode("genders"))

    def branch(name, alias_ok, statuses, schools):
        out = wide.withColumn("grad_status_code", F.explode(statuses)).withColumn("finance_code", F.explode("finance"))
        out = out.withColumn("school_code", F.explode(schools))
        return out.select(
            *KEYS, F.lit(name).alias("variant"), F.coalesce(alias_ok, F.lit(False)).alias("has_alias"),
            F.coalesce(alias_ok & (F.col("mentor_type") == name.upper()), F.lit(False)).alias("can_generate"), "mentor_id",
        )

    normal = branch("normal", normal_alias, _statuses(policy.normal_statuses, False), F.array(zero))
    codes = F.when(F.size("schools") > 0, F.col("schools")).otherwise(F.array(zero))
    school = branch("school", school_alias, _statuses(policy.school_statuses, True), codes)
    return normal.unionByName(school)


DEDUPE = ("alias", "mentor_name", "mentor_id", "manager", "group_name", *KEYS, "mentor_type")


def name_rows(rows: DataFrame, schools: DataFrame) -> DataFrame:
    """Attach group and school names (33-row dimension; school reference by key)."""
    dim = group_dim(rows.sparkSession).select(F.col("group_code").alias("__g"), F.col("name").alias("group_name"))
    out = rows.join(F.broadcast(dim), F.col("group_code") == F.col("__g"), "left").drop("__g")
    names = school_codes(schools).select(F.col("code").alias("__c"), "school_name")
    out = out.join(names, F.col("school_code") == F.col("__c"), "left").drop("__c")
    return out.withColumn("school_name", F.coalesce("school_name", F.lit("")))


def matrix_dedupe(rows: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """Twelve-column first wins, with the ``copies`` each row stands for; and the figures of ``dedupe_figures``."""
    rest = [c for c in rows.columns if c not in DEDUPE]
    first = F.min_by(F.struct(*rest), F.struct("row_index"))
    kept = rows.groupBy(*DEDUPE).agg(first.alias("__row"), F.count(F.lit(1)).alias("copies")).select(*DEDUPE, "__row.*", "copies")
    return kept, dedupe_figures(kept, policy)


def dedupe_figures(kept: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Rows before and after, removed rows and ratio against the threshold, from the copies of the kept rows alone."""
    policy = policy or Policy()
    sums = kept.agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    ratio = F.coalesce(F.try_divide(removed.cast("double"), F.col("rows_before").cast("double")), F.lit(0.0))
    return sums.select(
        "rows_before", "rows_after", removed.alias("removed_rows"), F.round(ratio, 6).alias("removed_ratio"),
        (ratio > policy.dedup_removed_ratio).alias("threshold_exceeded"),
    )


def matrix_number(matrix: DataFrame) -> DataFrame:
    """Dense counter in (center, group, school, alias) order, ties by the remaining columns."""
    tail = ["alias", "row_index", "mentor_id", "gender_code", "grad_status_code", "finance_code"]
    order = [F.col(c) for c in ("center_code", "group_code", "school_code", *tail)]
    levels = [("__c", F.col("center_code")), ("__g", F.col("group_code")), ("__s", F.col("school_code")),
              ("__a", F.substring("alias", 1, 2)), ("__b", F.substring("alias", 1, 4))]
    return number_rows(matrix, order, levels, name="counter")


def finance_gaps(matrix: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Five-key groups that lack a finance variant."""
    policy = policy or Policy()
    five = [k for k in KEYS if k != "finance_code"]
    need = F.array(*[F.lit(v).cast("bigint") for v in policy.finance_variants])
    have = matrix.groupBy(*five).agg(
        F.collect_set(F.when(F.col("finance_code").isin(*policy.finance_variants), F.col("finance_code"))).alias("have")
    )
    return have.withColumn("missing", F.array_sort(F.array_except(need, F.col("have")))).where(
        F.size("missing") > 0
    ).drop("have")


def alias_violations(matrix: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Contract of alias and school code per mentor type, one row per breach."""
    policy = policy or Policy()
    alias = F.trim(F.coalesce("alias", F.lit("")))
    school, normal = F.col("mentor_type") == "SCHOOL", F.col("mentor_type") == "NORMAL"
    postal = alias.rlike("^[0-9]+$") & alias.try_cast("bigint").between(*policy.postal_range)
    rules = F.array_compact(
        F.array(
            F.when(school & (alias != F.trim("mentor_id")), F.lit("school_alias_not_mentor_id")),
            F.when(normal & (alias == ""), F.lit("normal_alias_missing")),
            F.when(normal & (alias != "") & ~F.coalesce(postal, F.lit(False)), F.lit("normal_alias_out_of_range")),
            F.when(school & F.col("school_code").isNull(), F.lit("school_code_missing")),
            F.when(~school & (F.col("school_code") != 0), F.lit("normal_school_not_zero")),
        )
    )
    return matrix.withColumn("rule", F.explode(rules))


def group_coverage(matrix: DataFrame, base: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Candidate and matrix counts per six-key group with a coverage status."""
    cand = candidate_keys(base, policy).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("candidate_rows"),
        F.countDistinct("mentor_id").alias("candidate_mentors"),
        F.bool_or("can_generate").alias("can_generate"),
        F.bool_or("has_alias").alias("has_alias"),
        F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"),
    )
    mat = matrix.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("matrix_rows"), F.countDistinct("mentor_id").alias("matrix_mentors")
    )
    return coverage_status(cand.join(mat, list(KEYS), "full"))


def coverage_status(joined: DataFrame) -> DataFrame:
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    fill = {c: F.coalesce(c, zero) for c in ("candidate_rows", "candidate_mentors", "matrix_rows", "matrix_mentors")}
    out = joined.withColumns(fill | {c: F.coalesce(c, no) for c in ("can_generate", "has_alias")})
    has_c, has_m = F.col("candidate_rows") > 0, F.col("matrix_rows") > 0
    status = (
        F.when(has_m & has_c, F.lit("covered"))
        .when(has_m, F.lit("matrix_only"))
        .when(F.col("can_generate"), F.lit("candidate_only"))
        .otherwise(F.lit("blocked_candidate"))
    )
    return out.withColumn("variants", F.coalesce("variants", F.lit(""))).withColumn("status", status)


def coverage_outer(students: DataFrame, pool: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of students and of the pool for every key either side has; each side is counted before the join."""
    zero = F.lit(0).cast("bigint")
    s = students.groupBy(*keys).agg(F.count(F.lit(1)).alias("__s"))
    m = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("__m"))
    return s.join(m, list(keys), "full").select(*keys, F.coalesce("__s", zero).alias("student_rows"), F.coalesce("__m", zero).alias("pool_rows"))


def student_only_groups(coverage: DataFrame, students: DataFrame) -> DataFrame:
    """Append student groups absent from the coverage table."""
    zero = F.lit(0).cast("bigint")
    only = students.select(*KEYS).distinct().join(coverage.select(*KEYS), list(KEYS), "left_anti")
    extra = only.select(
        *KEYS,
        *[zero.alias(c) for c in ("candidate_rows", "candidate_mentors", "matrix_rows", "matrix_mentors")],
        F.lit(False).alias("can_generate"), F.lit(False).alias("has_alias"), F.lit("").alias("variants"),
        F.lit("student_only").alias("status"),
    )
    return coverage.unionByName(extra)


def coverage_metrics(coverage: DataFrame, students: DataFrame | None = None, policy: Policy | None = None) -> DataFrame:
    """One row of coverage totals; the denominator follows the policy mode."""
    policy = policy or Policy()
    has_c = F.col("candidate_rows") > 0
    blocked = has_c & ~F.col("can_generate")
    mask = has_c & F.col("can_generate")
    if policy.include_blocked:
        mask = mask | blocked
    cov = coverage
    if students is not None:
        groups = students.select(*KEYS).distinct().withColumn("__seen", F.lit(True))
        cov = cov.join(groups, list(KEYS), "left")
        seen = F.coalesce("__seen", F.lit(False))
        if policy.coverage_mode == "mentors_students_intersection" or policy.require_student_presence:
            mask = mask & seen
        elif policy.coverage_mode == "mentors_students_union":
            mask = mask | seen
    n = lambda c: F.count_if(c).cast("bigint")
    has_m = F.col("matrix_rows") > 0
    out = cov.agg(
        n(mask).alias("total_groups"), n(mask & has_m).alias("covered_groups"), n(mask & ~has_m).alias("unseen_groups"),
        n(blocked).alias("blocked_groups"), n(has_c).alias("candidate_groups"),
        n(F.col("status") == "matrix_only").alias("matrix_only_groups"),
    )
    ratio = F.when(F.col("total_groups") == 0, F.lit(1.0)).otherwise(F.col("covered_groups") / F.col("total_groups"))
    return out.withColumn("coverage_ratio", F.round(ratio, 6)).withColumn(
        "passed", ratio >= policy.coverage_threshold
    )


def validation_row(matrix: DataFrame) -> DataFrame:
    """Totals of the matrix in one aggregate."""
    n = lambda c: F.count_if(c).cast("bigint")
    return matrix.agg(
        F.count(F.lit(1)).alias("total_rows"), F.countDistinct("mentor_name").alias("distinct_mentors"),
        n(F.col("mentor_type") == "SCHOOL").alias("school_rows"),
        *[n(F.col("finance_code") == v).alias(f"finance_{v}_rows") for v in (0, 1, 3)],
        n(F.coalesce("school_code", F.lit(0)) == 0).alias("zero_school_rows"),
    )


def school_cells(report: DataFrame, schools: DataFrame) -> DataFrame:
    """row_index, school_column, raw and reason of every filled school cell; the reason is null where the school is known."""
    cols = _present(report)
    paired = lambda c: "school_code_" + c[-1] if c.startswith("school_name_") else None
    items = []
    for c in cols:
        other = paired(c)
        filled = ~keys.no_school(other) if other in report.columns and other != c else F.lit(False)
        n = text.to_long(c)
        items.append(
            F.struct(
                F.lit(c).alias("school_column"), F.trim(F.col(c).cast("string")).alias("raw"), keys.no_school(c).alias("empty"),
                F.when(n != 0, n).alias("n"), text.norm_text(c).alias("name_key"), filled.alias("skip"),
            )
        )
    cells = report.select("row_index", F.explode(F.array(*items)).alias("x")).select("row_index", "x.*").where(~F.col("empty"))
    known = school_codes(schools).select(F.col("code").alias("n"), F.lit(True).alias("code_known"))
    named = school_names(schools).select("name_key", F.lit(True).alias("name_known"))
    tagged = lookup(lookup(cells, known, ["n"], ["code_known"], "left"), named, ["name_key"], ["name_known"], "left")
    reason = F.when(
        F.col("n").isNotNull(), F.when(F.col("code_known").isNull() & ~F.col("skip"), F.lit("unknown school code"))
    ).otherwise(F.when((F.col("name_key") != "") & F.col("name_known").isNull(), F.lit("unknown school name")))
    return tagged.select("row_index", "school_column", "raw", reason.alias("reason"))


def school_figures(cells: DataFrame, policy: Policy | None = None) -> DataFrame:
    """References, mismatches and their ratio against the threshold."""
    policy = policy or Policy()
    stats = cells.agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("reason").isNotNull()).cast("bigint").alias("mismatches"))
    ratio = F.coalesce(F.try_divide(F.col("mismatches").cast("double"), F.col("references").cast("double")), F.lit(0.0))
    return stats.select("references", "mismatches", F.round(ratio, 6).alias("ratio"), (ratio > policy.school_mismatch_ratio).alias("threshold_exceeded"))


def school_mismatches(report: DataFrame, schools: DataFrame, policy: Policy | None = None) -> tuple[DataFrame, DataFrame]:
    """School cells that name no known school, and the figures of ``school_figures``."""
    cells = school_cells(report, schools)
    return cells.where(F.col("reason").isNotNull()), school_figures(cells, policy)


class ThresholdExceeded(ValueError):
    """A gate that the policy lets fail the build; ``figures`` has its row of ``MatrixBuild.gates``."""

    def __init__(self, figures: dict):
        super().__init__("{gate}: {measured} of {total} ({ratio:.1%}) against a threshold of {threshold:.1%}".format(**figures))
        self.figures = figures


@dataclass
class MatrixBuild:
    """One matrix build: stored base and rows; every other table is planned when asked for."""

    report: DataFrame
    valid: DataFrame
    schools: DataFrame
    base: DataFrame
    cells: DataFrame
    rows: DataFrame
    policy: Policy

    @cached_property
    def matrix(self) -> DataFrame:
        return matrix_number(self.rows)

    @cached_property
    def removed(self) -> DataFrame:
        return governance.capacity_gate(self.report, "covered_now", "special_limit")[1]

    @cached_property
    def gate_metrics(self) -> DataFrame:
        return governance.capacity_gate(self.report, "covered_now", "special_limit")[2]

    @cached_property
    def invalid(self) -> DataFrame:
        kept = governance.capacity_gate(self.report, "covered_now", "special_limit")[0]
        return governance.invalid_mentors(kept)[1]

    @cached_property
    def unseen_groups(self) -> DataFrame:
        return unseen_groups(self.valid)

    @cached_property
    def school_issues(self) -> DataFrame:
        return self.cells.where(F.col("reason").isNotNull())

    @cached_property
    def missing_schools(self) -> DataFrame:
        return missing_school_codes(school_binding(usable_rows(self.valid, self.policy), self.schools))

    @cached_property
    def dedupe(self) -> DataFrame:
        return dedupe_figures(self.rows, self.policy)

    @cached_property
    def coverage(self) -> DataFrame:
        return group_coverage(self.rows, self.base, self.policy)

    @cached_property
    def metrics(self) -> DataFrame:
        return coverage_metrics(self.coverage, None, self.policy)

    @cached_property
    def validation(self) -> DataFrame:
        return validation_row(self.rows)

    @cached_property
    def violations(self) -> DataFrame:
        return alias_violations(self.rows, self.policy)

    @cached_property
    def gates(self) -> DataFrame:
        """gate, measured, total, ratio, threshold, exceeded and status of the three thresholds.

        All figures come from stored tables. Status is ok, warning, or error where the policy lets the gate fail.
        """
        bound = {"school_lookup": self.policy.school_mismatch_ratio, "dedupe": self.policy.dedup_removed_ratio, "coverage": self.policy.coverage_threshold}
        school = school_figures(self.cells, self.policy).select(F.lit("school_lookup").alias("gate"), F.col("mismatches").alias("measured"), F.col("references").alias("total"), F.col("threshold_exceeded").alias("over"))
        dedupe = self.dedupe.select(F.lit("dedupe").alias("gate"), F.col("removed_rows").alias("measured"), F.col("rows_before").alias("total"), F.col("threshold_exceeded").alias("over"))
        # Coverage is exceeded from below, and only if a group that could be covered is not.
        coverage = self.metrics.select(F.lit("coverage").alias("gate"), F.col("covered_groups").alias("measured"), F.col("total_groups").alias("total"), (~F.col("passed") & (F.col("unseen_groups") > 0)).alias("over"))
        rows = school.unionByName(dedupe).unionByName(coverage)
        threshold = F.lit(None).cast("double")
        for name, value in bound.items():
            threshold = F.when(F.col("gate") == name, F.lit(float(value))).otherwise(threshold)
        exceeded = (F.col("total") > 0) & F.col("over")
        empty = F.when(F.col("gate") == "coverage", F.lit(1.0)).otherwise(F.lit(0.0))
        ratio = F.round(F.coalesce(F.try_divide(F.col("measured").cast("double"), F.col("total").cast("double")), empty), 6)
        status = F.when(~exceeded, F.lit("ok")).when(F.col("gate").isin(*self.policy.failing_gates), F.lit("error")).otherwise(F.lit("warning"))
        return rows.select("gate", "measured", "total", ratio.alias("ratio"), threshold.alias("threshold"), exceeded.alias("exceeded"), status.alias("status"))

    def enforce(self) -> MatrixBuild:
        """Fail on the first gate in error, in the order of ``gates``: one row each, three at most."""
        found = {r["gate"]: r.asDict() for r in self.gates.where("status = 'error'").collect()}
        for gate in ("school_lookup", "dedupe", "coverage"):
            if gate in found:
                raise ThresholdExceeded(found[gate])
        return self


def build_matrix(
    report: DataFrame, schools: DataFrame, manager_map: DataFrame, policy: Policy | None = None, enforce: bool = False
) -> MatrixBuild:
    """Gate, invalid rows, school lookup, base rows, governance, explode, dedupe, number.

    ``enforce`` stops the build with ``ThresholdExceeded`` at the gates that the policy lets fail:
    the school lookup before anything is exploded, the others once the rows are stored.
    """
    policy = policy or Policy()
    kept, _, _ = governance.capacity_gate(report, "covered_now", "special_limit")
    valid, _ = governance.invalid_mentors(kept)
    # Every output table reads the school cells, the base and the rows: store each once.
    cells = cut_lineage(school_cells(report, schools))
    if enforce and "school_lookup" in policy.failing_gates:
        figures = school_figures(cells, policy).first().asDict()
        if figures["references"] and figures["threshold_exceeded"]:
            raise ThresholdExceeded({"gate": "school_lookup", "measured": figures["mismatches"], "total": figures["references"], "ratio": figures["ratio"], "threshold": policy.school_mismatch_ratio})
    valid = valid.join(cells.where(F.col("reason").isNotNull()).select("row_index").distinct(), "row_index", "left_anti")
    base = base_rows(valid, schools, manager_map, policy)
    base = cut_lineage(first_row(base, ["mentor_id", "center_code"], ["row_index"]))
    exploded = name_rows(explode_rows(base, "NORMAL", policy).unionByName(explode_rows(base, "SCHOOL", policy)), schools)
    rows = cut_lineage(matrix_dedupe(exploded, policy)[0])
    build = MatrixBuild(report, valid, schools, base, cells, rows, policy)
    return build.enforce() if enforce else build
