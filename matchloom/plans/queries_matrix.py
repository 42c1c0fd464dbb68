"""Matrix generation, contracts and coverage queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, KEYS, Policy
from matchloom.operators import governance as G
from matchloom.operators import matrix as X
from matchloom.operators import references as R
from matchloom.plans import check_sql as ck
from matchloom.plans.registry import query

K = ", ".join(KEYS)
_DUAL = ",".join(str(c) for c in DUAL_STATUS)
EMPTY = "('', '0', '-', '—', '_', 'na', 'n/a', 'n a', 'nan', '<na>', '<nan>')"
VIEWS = ("report", "schools", "manager_map", "group_dim")

CELLS = f"""sname AS (SELECT {ck.norm('school_name')} AS k, min(school_code) AS code FROM schools GROUP BY 1),
cells AS (SELECT row_index, 0 AS i, 'school_code_1' AS school_column, school_code_1 AS v FROM report
  UNION ALL SELECT row_index, 1, 'school_name_2', school_name_2 FROM report),
tok AS (SELECT row_index, i, school_column, trim(v) AS raw, {ck.to_long('v')} AS n, {ck.norm('v')} AS k FROM cells
  WHERE v IS NOT NULL AND lower(trim(v)) NOT IN {EMPTY}),
codes AS (SELECT t.*, CASE WHEN t.n > 0 THEN t.n ELSE s.code END AS code, s.code AS named FROM tok t LEFT JOIN sname s ON t.k = s.k),
bind AS (SELECT row_index, count(*) AS refs, list_distinct_ordered AS bound FROM (
  SELECT row_index, list(code ORDER BY i) FILTER (WHERE code IS NOT NULL) AS l,
    CASE WHEN l IS NULL THEN CAST([] AS BIGINT[]) WHEN len(l) = 2 AND l[1] = l[2] THEN [l[1]] ELSE l END AS list_distinct_ordered
  FROM codes GROUP BY row_index) GROUP BY ALL)"""

CENTER = f"""mkeys AS (SELECT {ck.norm('manager_key')} AS k, max(center_code) AS c FROM manager_map GROUP BY 1),
mnames AS (SELECT DISTINCT {ck.norm('manager')} AS m FROM report),
mc AS (SELECT m, coalesce(arg_min(c, (-length(k), k)), 0) AS center, arg_min(k, (-length(k), k)) AS k FROM mnames LEFT JOIN mkeys ON contains(m, k) GROUP BY m)"""

BASE = f"""{CELLS}, {CENTER},
base AS (SELECT r.row_index, trim(r.mentor_id) AS mentor_id, r.mentor_name, r.manager, mc.center AS center_code,
  {ck.valid_codes('group_spec')} AS groups,
  {ck.gender('gender_text')} AS gender_code, coalesce(b.bound, CAST([] AS BIGINT[])) AS bound,
  CAST(school_count AS BIGINT) AS wanted, b.refs IS NOT NULL AS has_school_constraint,
  CASE WHEN CAST(school_count AS BIGINT) > 0 THEN 'SCHOOL' ELSE 'NORMAL' END AS mentor_type,
  greatest(coalesce(TRY_CAST(covered_now AS BIGINT), 0), 0) AS cur, greatest(coalesce(TRY_CAST(special_limit AS BIGINT), 0), 0) AS spec,
  TRY_CAST(postal_code AS BIGINT) AS postal
  FROM report r JOIN mc ON {ck.norm('r.manager')} = mc.m LEFT JOIN bind b ON b.row_index = r.row_index
  WHERE trim(r.mentor_id) <> '' AND can_allocate IN ('بلی')),
base2 AS (SELECT *, CASE WHEN mentor_type = 'SCHOOL' THEN mentor_id WHEN postal BETWEEN 1000 AND 9999 THEN CAST(postal AS VARCHAR) ELSE '' END AS alias,
  bound[1:wanted] AS schools FROM base WHERE len(groups) > 0 AND wanted <= len(bound))"""

EXPLODE = f"""{BASE},
g1 AS (SELECT *, unnest(groups) AS group_code FROM base2),
g2 AS (SELECT *, unnest(CASE WHEN mentor_type = 'NORMAL' AND group_code IN ({_DUAL}) THEN [1, 0] ELSE [1] END) AS grad_status_code FROM g1),
g3 AS (SELECT *, unnest(CASE WHEN mentor_type = 'SCHOOL' AND len(schools) > 0 THEN schools ELSE CAST([0] AS BIGINT[]) END) AS school_code FROM g2),
rows_all AS (SELECT *, unnest([0, 1, 3]) AS finance_code FROM g3)"""

# The build adds the gate, the school check and one row per (mentor, center).
BUILD = EXPLODE.replace(
    "WHERE trim(r.mentor_id) <> '' AND can_allocate IN ('بلی')",
    "WHERE trim(r.mentor_id) <> '' AND can_allocate IN ('بلی') AND coalesce(TRY_CAST(covered_now AS BIGINT), 0) < coalesce(TRY_CAST(special_limit AS BIGINT), 0)"
    " AND r.row_index NOT IN (SELECT row_index FROM issue)",
).replace(
    f"{CENTER},",
    f"""issue AS (SELECT row_index FROM codes WHERE (n IS NOT NULL AND n <> 0 AND n NOT IN (SELECT school_code FROM schools))
      OR ((n IS NULL OR n = 0) AND k <> '' AND named IS NULL)), {CENTER},""",
).replace("g1 AS (SELECT *,", "b3 AS (SELECT * FROM base2 QUALIFY row_number() OVER (PARTITION BY mentor_id, center_code ORDER BY row_index) = 1),\ng1 AS (SELECT *,").replace(
    "AS group_code FROM base2)", "AS group_code FROM b3)"
) + """,
matrix AS (SELECT r.*, d.name AS group_name, coalesce(s.school_name, '') AS school_name FROM rows_all r
  LEFT JOIN group_dim d ON d.group_code = r.group_code LEFT JOIN schools s ON s.school_code = r.school_code)"""

CANDS = f"""cand_raw AS (SELECT mentor_id, alias, mentor_type, gender_code, center_code, schools, unnest(groups) AS group_code FROM BASE_T),
cand1 AS (SELECT *, 'normal' AS variant, unnest(CASE WHEN group_code IN ({_DUAL}) THEN [1, 0] ELSE [1] END) AS grad_status_code FROM cand_raw),
cand2 AS (SELECT *, 0 AS school_code FROM cand1 UNION ALL
  SELECT *, 'school', 1, unnest(CASE WHEN len(schools) > 0 THEN schools ELSE CAST([0] AS BIGINT[]) END) FROM cand_raw),
cand AS (SELECT group_code, gender_code, CAST(grad_status_code AS BIGINT) AS grad_status_code, center_code, unnest([0, 1, 3]) AS finance_code, school_code, variant,
  mentor_type = upper(variant) AND alias <> '' AS has_alias, mentor_id FROM cand2)"""

COVER = f"""cov_c AS (SELECT {K}, count(*) AS candidate_rows, count(DISTINCT mentor_id) AS candidate_mentors, bool_or(has_alias) AS can_generate,
  bool_or(has_alias) AS has_alias, string_agg(DISTINCT variant, ',' ORDER BY variant) AS variants FROM cand GROUP BY ALL),
cov_m AS (SELECT {K}, count(*) AS matrix_rows, count(DISTINCT mentor_id) AS matrix_mentors FROM MATRIX_T GROUP BY ALL),
cov AS (SELECT {K}, coalesce(candidate_rows, 0) AS candidate_rows, coalesce(candidate_mentors, 0) AS candidate_mentors,
  coalesce(can_generate, false) AS can_generate, coalesce(has_alias, false) AS has_alias, coalesce(variants, '') AS variants,
  coalesce(matrix_rows, 0) AS matrix_rows, coalesce(matrix_mentors, 0) AS matrix_mentors,
  CASE WHEN matrix_rows > 0 AND candidate_rows > 0 THEN 'covered' WHEN matrix_rows > 0 THEN 'matrix_only'
    WHEN can_generate THEN 'candidate_only' ELSE 'blocked_candidate' END AS status
  FROM cov_c FULL JOIN cov_m USING ({K}))"""

KB = ", ".join(f"CAST({k} AS BIGINT) AS {k}" for k in KEYS)


def _built(t, policy=None):
    return X.build_matrix(t.report, t.schools, t.manager_map, policy)


@query(
    "N27_school_binding",
    f"""WITH {CELLS} SELECT r.row_index, coalesce(array_to_string(b.bound, ','), '') AS codes, b.refs IS NOT NULL AS has_school_constraint,
      CASE WHEN b.refs IS NOT NULL THEN 'restricted' ELSE 'global' END AS binding_mode FROM report r LEFT JOIN bind b USING (row_index)""",
    ("report", "schools"),
)
def school_binding(t):
    return X.school_binding(t.report, t.schools).select(
        "row_index", F.array_join("bound_codes", ",").alias("codes"), "has_school_constraint", "binding_mode"
    )


@query(
    "J6_center_from_manager",
    f"""WITH {CENTER} SELECT r.row_index, mc.center AS manager_center,
      CASE WHEN mc.k IS NULL THEN 'manager_wildcard' WHEN mc.k = mc.m THEN 'manager_exact' ELSE 'manager_substring' END AS manager_match
      FROM report r JOIN mc ON {ck.norm('r.manager')} = mc.m""",
    ("report", "manager_map"),
)
def center_from_manager(t):
    return R.center_from_manager(t.report, "manager", t.manager_map).select("row_index", "manager_center", "manager_match")


@query(
    "M1_base_rows",
    f"""WITH {BASE} SELECT row_index, mentor_id, center_code, array_to_string(groups, ',') AS groups, CAST(gender_code AS VARCHAR) AS genders,
      coalesce(array_to_string(schools, ','), '') AS schools, mentor_type, has_school_constraint, alias, cur AS capacity_current, spec AS capacity_special,
      greatest(spec - cur, 0) AS capacity_remaining FROM base2""",
    VIEWS,
)
def base_rows(t):
    b = X.base_rows(t.report, t.schools, t.manager_map)
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return b.select(
        "row_index", "mentor_id", "center_code", join("groups"), join("genders"), join("schools"), "mentor_type",
        "has_school_constraint", "alias", "capacity_current", "capacity_special", "capacity_remaining",
    )



@query(
    "M2_explode_rows",
    f"WITH {EXPLODE} SELECT {KB}, mentor_id, alias, mentor_type, min(row_index) AS row_index FROM rows_all GROUP BY ALL",
    VIEWS,
)
def explode_rows(t):
    b = X.base_rows(t.report, t.schools, t.manager_map)
    rows = X.explode_rows(b, "NORMAL").unionByName(X.explode_rows(b, "SCHOOL"))
    return rows.select(*KEYS, "mentor_id", "alias", "mentor_type", "row_index")


@query(
    "M3_status_explode",
    f"""SELECT mentor_id, group_code, unnest(CASE WHEN group_code IN ({_DUAL}) AND NOT has_school_constraint THEN [CAST(1 AS BIGINT), 0] ELSE [CAST(1 AS BIGINT)] END) AS grad_status_code
      FROM (SELECT DISTINCT mentor_id, group_code, has_school_constraint FROM mentors)""",
    ("mentors",),
)
def status_explode(t):
    rows = t.mentors.select("mentor_id", "group_code", "has_school_constraint").distinct()
    return X.status_explode(rows, "has_school_constraint").drop("has_school_constraint")


@query(
    "M4_candidate_keys",
    f"""WITH {BASE}, {CANDS.replace('BASE_T', 'base2')}
      SELECT {KB}, variant, has_alias, has_alias AS can_generate, mentor_id FROM cand""",
    VIEWS,
)
def candidate_keys(t):
    return X.candidate_keys(X.base_rows(t.report, t.schools, t.manager_map))


@query(
    "M5_build_matrix",
    f"""WITH {BUILD} SELECT {KB}, mentor_id, mentor_name, manager, group_name, school_name, alias, mentor_type, has_school_constraint,
      cur AS capacity_current, spec AS capacity_special, greatest(spec - cur, 0) AS capacity_remaining FROM matrix""",
    VIEWS,
)
def build_matrix(t):
    return _built(t).matrix.select(
        *KEYS, "mentor_id", "mentor_name", "manager", "group_name", "school_name", "alias", "mentor_type",
        "has_school_constraint", "capacity_current", "capacity_special", "capacity_remaining",
    )


@query(
    "M5_build_matrix_side_tables",
    f"""WITH {BUILD}
      SELECT 'removed' AS tbl, row_index FROM report WHERE NOT (coalesce(TRY_CAST(covered_now AS BIGINT), 0) < coalesce(TRY_CAST(special_limit AS BIGINT), 0))
      UNION ALL SELECT 'invalid', row_index FROM report WHERE trim(mentor_id) = '' AND coalesce(TRY_CAST(covered_now AS BIGINT), 0) < coalesce(TRY_CAST(special_limit AS BIGINT), 0)
      UNION ALL SELECT 'base', row_index FROM b3
      UNION ALL SELECT 'school_issue', row_index FROM issue""",
    VIEWS,
)
def build_matrix_side_tables(t):
    b = _built(t)
    tag = lambda df, n: df.select(F.lit(n).alias("tbl"), "row_index")
    return (
        tag(b.removed, "removed").unionByName(tag(b.invalid, "invalid")).unionByName(tag(b.base, "base"))
        .unionByName(tag(b.school_issues, "school_issue"))
    )


@query(
    "M5_threshold_gates",
    f"""WITH {BUILD}, {CANDS.replace('BASE_T', 'b3')}, {COVER.replace('MATRIX_T', 'rows_all')},
      s AS (SELECT count(*) AS refs, count(*) FILTER (WHERE (n IS NOT NULL AND n <> 0 AND n NOT IN (SELECT school_code FROM schools)) OR ((n IS NULL OR n = 0) AND k <> '' AND named IS NULL)) AS bad FROM codes),
      d AS (SELECT (SELECT count(*) FROM rows_all) AS before, (SELECT count(*) FROM (SELECT DISTINCT alias, mentor_name, mentor_id, manager, {K}, mentor_type FROM rows_all)) AS after),
      c AS (SELECT count(*) FILTER (WHERE can_generate) AS total, count(*) FILTER (WHERE can_generate AND matrix_rows > 0) AS covered FROM cov),
      g AS (SELECT 'school_lookup' AS gate, bad AS measured, refs AS total, bad / refs AS ratio FROM s UNION ALL SELECT 'dedupe', before - after, before, (before - after) / before FROM d
        UNION ALL SELECT 'coverage', covered, total, covered / total FROM c),
      p(policy, gate, threshold) AS (VALUES ('strict', 'school_lookup', 0.0), ('strict', 'dedupe', -1.0), ('strict', 'coverage', 1.5), ('lenient', 'school_lookup', 1.0), ('lenient', 'dedupe', 1.0), ('lenient', 'coverage', 0.0)),
      e AS (SELECT policy, gate, measured, total, round(ratio, 6) AS ratio, CAST(threshold AS DOUBLE) AS threshold,
        CASE WHEN gate = 'coverage' THEN ratio < threshold AND covered_less ELSE ratio > threshold END AS exceeded
        FROM g JOIN p USING (gate) CROSS JOIN (SELECT covered < total AS covered_less FROM c))
      SELECT *, CASE WHEN NOT exceeded THEN 'ok' WHEN gate = 'school_lookup' THEN 'warning' ELSE 'error' END AS status FROM e""",
    VIEWS,
)
def threshold_gates(t):
    """The gates of one build under thresholds on both sides of its figures."""
    strict, lenient = (Policy(school_mismatch_ratio=s, dedup_removed_ratio=d, coverage_threshold=c) for s, d, c in ((0.0, -1.0, 1.5), (1.0, 1.0, 0.0)))
    built = _built(t, strict)
    tag = lambda b, n: b.gates.select(F.lit(n).alias("policy"), "*")
    return tag(built, "strict").unionByName(tag(replace(built, policy=lenient), "lenient"))


@query(
    "F15_school_figures",
    f"""WITH {CELLS}, s AS (SELECT count(*) AS refs, count(*) FILTER (WHERE (n IS NOT NULL AND n <> 0 AND n NOT IN (SELECT school_code FROM schools))
        OR ((n IS NULL OR n = 0) AND k <> '' AND named IS NULL)) AS bad FROM codes)
      SELECT refs AS "references", bad AS mismatches, round(bad / refs, 6) AS ratio, bad / refs > limit_ AS threshold_exceeded FROM s CROSS JOIN (VALUES (0.0), (0.9)) t(limit_)""",
    ("report", "schools"),
)
def school_figures(t):
    """The mismatch ratio against a limit below and one above it."""
    cells = X.school_cells(t.report, t.schools)
    return X.school_figures(cells, Policy(school_mismatch_ratio=0.0)).unionByName(X.school_figures(cells, Policy(school_mismatch_ratio=0.9)))


@query(
    "M6_matrix_dedupe",
    f"""WITH {EXPLODE}, twice AS (SELECT * FROM rows_all UNION ALL SELECT * FROM rows_all WHERE row_index % 9 = 0),
      n AS (SELECT count(*) AS b, (SELECT count(*) FROM (SELECT DISTINCT alias, mentor_name, mentor_id, manager, {K}, mentor_type FROM rows_all)) AS a FROM twice)
      SELECT b AS rows_before, a AS rows_after, b - a AS removed_rows, round((b - a) / b, 6) AS removed_ratio, (b - a) / b > 0.05 AS threshold_exceeded FROM n""",
    VIEWS,
)
def matrix_dedupe(t):
    b = X.base_rows(t.report, t.schools, t.manager_map)
    rows = X.name_rows(X.explode_rows(b, "NORMAL").unionByName(X.explode_rows(b, "SCHOOL")), t.schools)
    return X.matrix_dedupe(rows.unionByName(rows.where(F.col("row_index") % 9 == 0)))[1]


@query(
    "M7_matrix_number",
    f"""WITH {BUILD} SELECT row_number() OVER (ORDER BY center_code, group_code, school_code, alias, row_index, mentor_id, gender_code, grad_status_code, finance_code) AS counter,
      {KB}, mentor_id, alias FROM matrix""",
    VIEWS,
)
def matrix_number(t):
    return _built(t).matrix.select("counter", *KEYS, "mentor_id", "alias")


@query(
    "M8_finance_completeness",
    f"""WITH {EXPLODE}, m AS (SELECT * FROM rows_all WHERE NOT (finance_code = 3 AND row_index % 4 = 1))
      SELECT {KB.replace(', CAST(finance_code AS BIGINT) AS finance_code', '')}, array_to_string(list_filter([0, 1, 3], lambda v: NOT list_contains(list(finance_code), v)), ',') AS missing
      FROM m GROUP BY ALL HAVING count(DISTINCT finance_code) < 3""",
    VIEWS,
)
def finance_completeness(t):
    b = X.base_rows(t.report, t.schools, t.manager_map)
    rows = X.explode_rows(b, "NORMAL").unionByName(X.explode_rows(b, "SCHOOL"))
    kept = rows.where(~((F.col("finance_code") == 3) & (F.col("row_index") % 4 == 1)))
    return X.finance_gaps(kept).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


@query(
    "M9_alias_school_contract",
    f"""WITH {EXPLODE}, m AS (SELECT mentor_id, row_index, mentor_type, group_code, finance_code, school_code + CASE WHEN row_index % 7 = 2 THEN 1 ELSE 0 END AS school_code,
        CASE WHEN row_index % 11 = 0 THEN '12' ELSE alias END AS alias FROM rows_all),
      v AS (SELECT *, unnest([CASE WHEN mentor_type = 'SCHOOL' AND alias <> mentor_id THEN 'school_alias_not_mentor_id' END,
        CASE WHEN mentor_type = 'NORMAL' AND alias = '' THEN 'normal_alias_missing' END,
        CASE WHEN mentor_type = 'NORMAL' AND alias <> '' AND NOT coalesce(TRY_CAST(alias AS BIGINT) BETWEEN 1000 AND 9999, false) THEN 'normal_alias_out_of_range' END,
        CASE WHEN mentor_type <> 'SCHOOL' AND school_code <> 0 THEN 'normal_school_not_zero' END]) AS rule FROM m)
      SELECT rule, mentor_id, count(*) AS rows FROM v WHERE rule IS NOT NULL GROUP BY rule, mentor_id""",
    VIEWS,
)
def alias_school_contract(t):
    b = X.base_rows(t.report, t.schools, t.manager_map)
    rows = X.explode_rows(b, "NORMAL").unionByName(X.explode_rows(b, "SCHOOL"))
    bent = rows.withColumn(
        "school_code", F.col("school_code") + F.when(F.col("row_index") % 7 == 2, 1).otherwise(0)
    ).withColumn("alias", F.when(F.col("row_index") % 11 == 0, F.lit("12")).otherwise(F.col("alias")))
    return X.alias_violations(bent).groupBy("rule", "mentor_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "M10_mentor_profiles",
    f"""WITH p AS (SELECT mentor_id, {K}, count(*) AS copies FROM mentors GROUP BY ALL), m AS (SELECT mentor_id, count(*) AS profiles, CAST(sum(copies) AS BIGINT) AS rows FROM p GROUP BY mentor_id)
      SELECT mentor_id, profiles, rows, profiles > 1 AS multi FROM m""",
    ("mentors",),
)
def mentor_profiles(t):
    out = G.mentor_profiles(t.mentors, "pool_order")
    return out["per_mentor"].select("mentor_id", "profiles", "rows", (F.col("profiles") > 1).alias("multi"))


@query(
    "A1_group_coverage",
    f"WITH {BUILD}, {CANDS.replace('BASE_T', 'b3')}, {COVER.replace('MATRIX_T', 'rows_all')} SELECT {KB}, * EXCLUDE ({K}) FROM cov",
    VIEWS,
)
def group_coverage(t):
    return _built(t).coverage.select(
        *KEYS, "candidate_rows", "candidate_mentors", "can_generate", "has_alias", "variants", "matrix_rows",
        "matrix_mentors", "status",
    )


@query(
    "A2_coverage_metrics",
    f"""WITH {BUILD}, {CANDS.replace('BASE_T', 'b3')}, {COVER.replace('MATRIX_T', 'rows_all')},
      c AS (SELECT count(*) FILTER (WHERE can_generate) AS total_groups, count(*) FILTER (WHERE can_generate AND matrix_rows > 0) AS covered_groups,
        count(*) FILTER (WHERE can_generate AND matrix_rows = 0) AS unseen_groups, count(*) FILTER (WHERE candidate_rows > 0 AND NOT can_generate) AS blocked_groups,
        count(*) FILTER (WHERE candidate_rows > 0) AS candidate_groups, count(*) FILTER (WHERE status = 'matrix_only') AS matrix_only_groups FROM cov)
      SELECT *, round(CASE WHEN total_groups = 0 THEN 1.0 ELSE covered_groups / total_groups END, 6) AS coverage_ratio,
        CASE WHEN total_groups = 0 THEN 1.0 ELSE covered_groups / total_groups END >= 0.95 AS passed FROM c""",
    VIEWS,
)
def coverage_metrics(t):
    return _built(t).metrics


@query(
    "J19_coverage_outer",
    f"""SELECT {K}, coalesce(s.n, 0) AS student_rows, coalesce(m.n, 0) AS pool_rows FROM
      (SELECT {K}, count(*) AS n FROM students GROUP BY ALL) s FULL JOIN (SELECT {K}, count(*) AS n FROM mentors GROUP BY ALL) m USING ({K})""",
    ("students", "mentors"),
)
def coverage_outer(t):
    return X.coverage_outer(t.students, t.mentors)


@query(
    "J20_student_only_groups",
    f"""WITH {BUILD}, {CANDS.replace('BASE_T', 'b3')}, {COVER.replace('MATRIX_T', 'rows_all')}
      SELECT {KB}, status FROM cov UNION ALL SELECT {K}, 'student_only' FROM (SELECT DISTINCT {K} FROM students) s
        WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE {' AND '.join(f'c.{k} = s.{k}' for k in KEYS)})""",
    VIEWS + ("students",),
)
def student_only_groups(t):
    return X.student_only_groups(_built(t).coverage, t.students).select(*KEYS, "status")


@query(
    "A11_validation_row",
    f"""WITH {BUILD} SELECT count(*) AS total_rows, count(DISTINCT mentor_name) AS distinct_mentors, count(*) FILTER (WHERE mentor_type = 'SCHOOL') AS school_rows,
      count(*) FILTER (WHERE finance_code = 0) AS finance_0_rows, count(*) FILTER (WHERE finance_code = 1) AS finance_1_rows,
      count(*) FILTER (WHERE finance_code = 3) AS finance_3_rows, count(*) FILTER (WHERE school_code = 0) AS zero_school_rows FROM matrix""",
    VIEWS,
)
def validation_row(t):
    return _built(t).validation


@query(
    "F14_unseen_groups",
    f"""WITH u AS (SELECT mentor_name, manager, {ck.valid_codes('group_spec')} AS good, {ck.invalid_codes('group_spec')} AS codes FROM report
        WHERE trim(mentor_id) <> '' AND can_allocate = 'بلی')
      SELECT DISTINCT mentor_name, manager, unnest(CASE WHEN len(codes) = 0 THEN [''] ELSE list_transform(codes, lambda v: 'code:' || v) END) AS group_token FROM u
      WHERE len(good) = 0""",
    ("report",),
)
def unseen_groups(t):
    return X.unseen_groups(t.report).select("mentor_name", "manager", "group_token")


@query(
    "F15_school_lookup_mismatches",
    f"""WITH {CELLS} SELECT row_index, school_column, raw, CASE WHEN n IS NOT NULL AND n <> 0 THEN 'unknown school code' ELSE 'unknown school name' END AS reason
      FROM codes WHERE (n IS NOT NULL AND n <> 0 AND n NOT IN (SELECT school_code FROM schools)) OR ((n IS NULL OR n = 0) AND k <> '' AND named IS NULL)""",
    ("report", "schools"),
)
def school_lookup_mismatches(t):
    return X.school_mismatches(t.report, t.schools)[0]


@query(
    "F16_missing_school_codes",
    f"""WITH {CELLS} SELECT r.row_index, r.mentor_id, 2 * CAST(school_count AS BIGINT) AS expected_school_count, CAST(coalesce(len(b.bound), 0) AS BIGINT) AS found_school_count
      FROM report r LEFT JOIN bind b USING (row_index) WHERE 2 * CAST(school_count AS BIGINT) > coalesce(len(b.bound), 0)""",
    ("report", "schools"),
)
def missing_school_codes(t):
    doubled = t.report.withColumn("school_count", (F.col("school_count").cast("bigint") * 2).cast("string"))
    return X.missing_school_codes(X.school_binding(doubled, t.schools))
