"""Data-quality rules and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, KEYS, Policy
from matchloom.operators import matching as M
from matchloom.operators import quality as Q
from matchloom.operators import trace as T
from matchloom.plans import check_sql as ck
from matchloom.plans.queries_matching import FUNNEL
from matchloom.plans.queries_trace import FAILING, ORDER_CHECK, PRE, SM
from matchloom.plans.registry import query

_DUAL = ",".join(str(c) for c in DUAL_STATUS)
K = ", ".join(KEYS)

MX = """mx AS (SELECT mentor_id, CASE WHEN mentor_id % 10 = 0 THEN 'SCHOOL' WHEN mentor_id % 33 = 1 THEN 'odd' ELSE 'NORMAL' END AS mentor_type, group_code, CASE WHEN mentor_id % 12 = 5 THEN 0 ELSE grad_status_code END AS grad_status_code,
  CASE WHEN mentor_id % 14 = 3 THEN 9 WHEN mentor_id % 40 = 10 THEN 0 ELSE school_code END AS school_code, CASE WHEN mentor_id % 10 = 0 THEN CASE WHEN mentor_id % 30 = 0 THEN 'zz' ELSE CAST(mentor_id AS VARCHAR) END
  WHEN mentor_id % 16 = 6 THEN '' WHEN mentor_id % 16 = 7 THEN '12' ELSE CAST(1000 + mentor_id AS VARCHAR) END AS alias, has_school_constraint FROM mentors)"""


def _mx(t):
    m = F.col("mentor_id")
    alias = F.when(m % 10 == 0, F.when(m % 30 == 0, F.lit("zz")).otherwise(m.cast("string"))).when(m % 16 == 6, F.lit("")).when(m % 16 == 7, F.lit("12")).otherwise((m + 1000).cast("string"))
    return t.mentors.select(
        m, F.when(m % 10 == 0, F.lit("SCHOOL")).when(m % 33 == 1, F.lit("odd")).otherwise(F.lit("NORMAL")).alias("mentor_type"), "group_code",
        F.when(m % 12 == 5, F.lit(0).cast("bigint")).otherwise(F.col("grad_status_code")).alias("grad_status_code"),
        F.when(m % 14 == 3, F.lit(9).cast("bigint")).when(m % 40 == 10, F.lit(0).cast("bigint")).otherwise(F.col("school_code")).alias("school_code"),
        alias.alias("alias"), "has_school_constraint",
    )


@query(
    "Q1_STU_01",
    """WITH c AS (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(DISTINCT o_custkey) FROM orders) AS b)
      SELECT 'STU_01' AS rule_id, 'error' AS level, 'counts' AS subject, 'allocation=' || b || ',student_report=' || a AS detail FROM c WHERE a <> b
      UNION ALL SELECT 'STU_01', 'error', 'counts', 'matrix=' || (SELECT count(*) FROM supplier) || ',student_report=' || a FROM c""",
)
def stu_01(t):
    report = t.customer.select(F.col("c_custkey").alias("student_id"))
    alloc = t.orders.select(F.col("o_custkey").alias("student_id")).distinct()
    return Q.stu_01({"student_report": report, "allocation": alloc}).unionByName(Q.stu_01({"student_report": report, "matrix": t.supplier}))


EXP = """e AS (SELECT s_suppkey AS mentor_id, 140 + s_suppkey % 20 AS expected FROM supplier), a AS (SELECT mentor_id, count(*) AS n FROM alloc_log GROUP BY 1), ea AS (SELECT mentor_id, expected, coalesce(n, 0) AS assigned FROM e LEFT JOIN a USING (mentor_id))"""


def _exp(t):
    return t.supplier.select(F.col("s_suppkey").alias("mentor_id"), (F.lit(140) + F.col("s_suppkey") % 20).alias("expected"))


@query("A5_expected_vs_assigned", f"WITH {EXP} SELECT * FROM ea", ("alloc_log",))
def expected_vs_assigned(t):
    return Q.expected_vs_assigned(_exp(t), t.alloc_log)


@query(
    "Q2_STU_02",
    f"WITH {EXP} SELECT 'STU_02' AS rule_id, 'error' AS level, CAST(mentor_id AS VARCHAR) AS subject, assigned || '/' || expected AS detail FROM ea WHERE expected <> assigned",
    ("alloc_log",),
)
def stu_02(t):
    return Q.stu_02(_exp(t), t.alloc_log)


@query(
    "Q3_STU_BINDING_01",
    "SELECT 'STU_BINDING_01' AS rule_id, 'error' AS level, CAST(student_id AS VARCHAR) AS subject, 'MENTOR_BASED' AS detail FROM students WHERE student_id % 27 = 0",
    ("students",),
)
def stu_binding_01(t):
    s = t.students.withColumn("declared_binding", F.when(F.col("student_id") % 27 == 0, F.lit("MENTOR_BASED")))
    return Q.stu_binding_01(s, Policy(school_codes=(1, 4)))


@query(
    "Q4_STATUS_DOMAIN_01",
    f"WITH {MX} SELECT 'STATUS_DOMAIN_01' AS rule_id, 'error' AS level, CAST(mentor_id AS VARCHAR) AS subject, concat_ws('|', group_code, grad_status_code, mentor_type) AS detail FROM mx WHERE grad_status_code = 0 AND NOT (group_code IN ({_DUAL}) AND mentor_type <> 'SCHOOL')",
    ("mentors",),
)
def status_domain_01(t):
    return Q.status_domain_01(_mx(t))


@query(
    "Q5_JOIN_01",
    "SELECT 'JOIN_01' AS rule_id, 'error' AS level, 'gender_code' AS subject, 'nulls ' || count(*) AS detail FROM mentors WHERE mentor_id % 11 = 0 UNION ALL SELECT 'JOIN_01', 'error', 'finance_code', 'type string' UNION ALL SELECT 'JOIN_01', 'error', 'school_code', 'missing column'",
    ("mentors",),
)
def join_01(t):
    m = t.mentors.withColumn("gender_code", F.when(F.col("mentor_id") % 11 != 0, F.col("gender_code")))
    return Q.join_01(m.withColumn("finance_code", F.col("finance_code").cast("string")).drop("school_code"))


_MT = f"""{MX}, rr AS (SELECT DISTINCT CAST(mentor_id AS VARCHAR) AS m, unnest([CASE WHEN mentor_type = 'odd' THEN 'illegal type' END, CASE WHEN mentor_type = 'NORMAL' AND school_code <> 0 THEN 'normal row with school' END,
  CASE WHEN mentor_type = 'SCHOOL' AND school_code = 0 THEN 'school row without school' END, CASE WHEN mentor_type = 'SCHOOL' AND alias <> CAST(mentor_id AS VARCHAR) THEN 'school alias differs' END,
  CASE WHEN mentor_type = 'NORMAL' AND alias = '' THEN 'normal alias missing' END, CASE WHEN mentor_type = 'NORMAL' AND alias <> '' AND NOT (TRY_CAST(alias AS BIGINT) BETWEEN 1000 AND 9999) THEN 'normal alias out of range' END]) AS d FROM mx)"""


@query(
    "Q6_MENTOR_TYPE_01",
    f"WITH {_MT} SELECT 'MENTOR_TYPE_01' AS rule_id, 'error' AS level, m AS subject, d AS detail FROM rr WHERE d IS NOT NULL UNION ALL SELECT 'MENTOR_TYPE_01', 'error', CAST(mentor_id AS VARCHAR), 'two types' FROM mentors WHERE mentor_id % 50 = 7 GROUP BY mentor_id",
    ("mentors",),
)
def mentor_type_01(t):
    m = _mx(t)
    twice = m.where(F.col("mentor_id") % 50 == 7).withColumn("mentor_type", F.lit("SCHOOL")).withColumn("school_code", F.lit(5).cast("bigint")).withColumn("alias", F.col("mentor_id").cast("string"))
    return Q.mentor_type_01(m.unionByName(twice))


DUP = f"""pp AS (SELECT mentor_id, {K}, pool_order FROM mentors UNION ALL SELECT mentor_id, {K}, pool_order + 1000000 FROM mentors WHERE mentor_id % 6 = 2)"""


def _dup(t):
    m = t.mentors.select("mentor_id", *KEYS, "pool_order")
    return m.unionByName(m.where(F.col("mentor_id") % 6 == 2).withColumn("pool_order", F.col("pool_order") + 1000000))


@query(
    "A3_duplicate_keys_per_mentor",
    f"WITH {DUP} SELECT mentor_id, pool_order, duplicate_group_size FROM (SELECT *, count(*) OVER (PARTITION BY mentor_id, {K}) AS duplicate_group_size FROM pp) WHERE duplicate_group_size > 1",
    ("mentors",),
)
def duplicate_keys_per_mentor(t):
    return Q.duplicate_keys(_dup(t)).select("mentor_id", "pool_order", "duplicate_group_size")


@query(
    "A3_duplicate_keys_per_key",
    f"WITH {DUP} SELECT mentor_id, pool_order, duplicate_group_size FROM (SELECT *, count(*) OVER (PARTITION BY {K}) AS duplicate_group_size FROM pp) WHERE duplicate_group_size > 1",
    ("mentors",),
)
def duplicate_keys_per_key(t):
    return Q.duplicate_keys(_dup(t), per_mentor=False).select("mentor_id", "pool_order", "duplicate_group_size")


@query(
    "A3_duplicate_lineitem_pairs",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, duplicate_group_size FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS duplicate_group_size FROM lineitem) WHERE duplicate_group_size > 1",
)
def duplicate_lineitem_pairs(t):
    from matchloom.operators.numbering import duplicate_sizes

    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return duplicate_sizes(li, ["l_partkey", "l_suppkey"])


@query(
    "Q7_POOL_JOIN_01",
    f"WITH {DUP}, g AS (SELECT count(*) AS n FROM pp GROUP BY mentor_id, {K} HAVING count(*) > 1) SELECT 'POOL_JOIN_01' AS rule_id, 'error' AS level, 'pool' AS subject, count(*) || '/' || CAST(sum(n) AS BIGINT) AS detail FROM g HAVING count(*) > 0",
    ("mentors",),
)
def pool_join_01(t):
    return Q.pool_join_01(_dup(t))


@query(
    "Q8_SCHOOL_01",
    f"""WITH {MX} SELECT DISTINCT 'SCHOOL_01' AS rule_id, 'error' AS level, CAST(mentor_id AS VARCHAR) AS subject, 'unrestricted mentor in invalid list' AS detail FROM mx WHERE NOT has_school_constraint AND mentor_id % 8 = 3
      UNION ALL SELECT DISTINCT 'SCHOOL_01', 'error', CAST(mentor_id AS VARCHAR), 'restricted mentor without school' FROM mx WHERE has_school_constraint AND school_code = 0""",
    ("mentors",),
)
def school_01(t):
    invalid = t.supplier.where(F.col("s_suppkey") % 8 == 3).select(F.col("s_suppkey").alias("mentor_id"))
    return Q.school_01(_mx(t), invalid)


@query(
    "Q9_GOV_01",
    "SELECT DISTINCT 'GOV_01' AS rule_id, 'error' AS level, CAST(mentor_id AS VARCHAR) AS subject, 'FROZEN' AS detail FROM alloc_log WHERE mentor_id % 9 = 0",
    ("alloc_log",),
)
def gov_01(t):
    status = t.supplier.where(F.col("s_suppkey") % 9 == 0).select(F.col("s_suppkey").alias("mentor_id"), F.lit("FROZEN").alias("status"))
    return Q.gov_01(t.alloc_log, status)


@query(
    "Q10_ALLOC_01",
    """WITH a AS (SELECT mentor_id, count(*) AS n FROM alloc_log WHERE allocation_status = 'success' GROUP BY 1), s AS (SELECT s_suppkey AS mentor_id, s_suppkey % 30 AS r, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 60 END AS w FROM supplier)
      SELECT 'ALLOC_01' AS rule_id, 'error' AS level, CAST(s.mentor_id AS VARCHAR) AS subject, coalesce(n, 0) || '/' || r || '/' || coalesce(w, coalesce(n, 0)) AS detail FROM s LEFT JOIN a USING (mentor_id) WHERE coalesce(n, 0) > r + coalesce(w, coalesce(n, 0))""",
    ("alloc_log",),
)
def alloc_01(t):
    k = F.col("s_suppkey")
    summary = t.supplier.select(k.alias("mentor_id"), (k % 30).alias("remaining_capacity"), F.when(k % 5 > 0, k % 60).alias("allocations_new"))
    return Q.alloc_01(t.alloc_log.where("allocation_status = 'success'"), summary)


@query(
    "Q11_HISTORY_CHANNEL_01",
    """WITH h AS (SELECT CASE WHEN o_orderkey % 70 = 0 THEN '--' ELSE CAST(o_custkey AS VARCHAR) END AS c, upper(trim(CASE o_orderkey % 3 WHEN 0 THEN ' school' WHEN 1 THEN 'Golestan ' ELSE NULL END)) AS ch FROM orders),
      d AS (SELECT count(*) AS n FROM h WHERE c <> '--' AND ch IS NOT NULL GROUP BY c, ch HAVING count(*) > 1)
      SELECT 'HISTORY_CHANNEL_01' AS rule_id, 'error' AS level, 'invalid' AS subject, CAST(count(*) AS VARCHAR) AS detail FROM h WHERE c = '--' UNION ALL SELECT 'HISTORY_CHANNEL_01', 'error', 'duplicate', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM d""",
)
def history_channel_01(t):
    k = F.col("o_orderkey")
    h = t.orders.select(
        F.when(k % 70 == 0, F.lit("--")).otherwise(F.col("o_custkey").cast("string")).alias("national_code"),
        F.when(k % 3 == 0, F.lit(" school")).when(k % 3 == 1, F.lit("Golestan ")).alias("allocation_channel"),
    )
    return Q.history_channel_01(h)


@query(
    "Q12_POOL_COVERAGE_01",
    f"WITH {FUNNEL}, {FAILING}, {PRE} SELECT 'POOL_COVERAGE_01' AS rule_id, 'error' AS level, CAST(student_id AS VARCHAR) AS subject, concat_ws('|', coalesce(first_failing_stage, 'capacity_gate'), expected_value) AS detail FROM pre WHERE candidate_count_final = 0",
    SM,
)
def pool_coverage_01(t):
    return Q.pool_coverage_01(T.alignment_preflight(t.students_gap, t.mentors))


@query(
    "Q13_POOL_DIVERSITY_01",
    "SELECT 'POOL_DIVERSITY_01' AS rule_id, 'warning' AS level, 'grad_status_code' AS subject, '1' AS detail FROM (SELECT least(grad_status_code, 0) AS g FROM mentors) HAVING count(DISTINCT g) <= 1",
    ("mentors",),
)
def pool_diversity_01(t):
    # Codes are 0 and above, so this column has one value in the whole pool.
    return Q.pool_diversity_01(t.mentors.withColumn("grad_status_code", F.least("grad_status_code", F.lit(0))))


def _audit(t):
    k = F.col("o_orderkey")
    name = F.when(k % 90 == 0, F.lit("گروه فراگیر")).otherwise(F.lit("x"))
    sid = F.concat(F.when(k % 4 == 0, F.lit("54")).otherwise(F.lit("53")), F.lit("357"), F.lpad((F.col("o_custkey") * 7 % 10000).cast("string"), 4, "0"))
    alloc = t.orders.select(sid.alias("student_id"), name.alias("mentor_name"), (k % 9000).alias("alias"), (k % 100).alias("mentor_id"))
    trace = T.trace_long(M.stage_funnel(t.students_gap, t.mentors))
    return Q.allocation_audit(alloc, t.alloc_log, trace)


@query(
    "Q15_allocation_audit",
    f"""WITH {FUNNEL}, al AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN '54' ELSE '53' END || '357' || lpad(CAST(o_custkey * 7 % 10000 AS VARCHAR), 4, '0') AS sid, o_orderkey % 90 = 0 OR o_orderkey % 9000 BETWEEN 7000 AND 7999 AS v FROM orders)
      SELECT 'virtual_mentors' AS "check", count(*) FILTER (WHERE v) AS "count" FROM al UNION ALL SELECT 'counter_overflow', count(*) FILTER (WHERE sid LIKE '%9999') FROM al
      UNION ALL SELECT 'year_ambiguity', count(DISTINCT left(sid, 2)) FROM al UNION ALL SELECT 'capacity_stuck', count(*) FROM alloc_log WHERE capacity_before = capacity_after
      UNION ALL SELECT 'trace_mismatch', count(*) FROM funnel WHERE n_capacity_gate = 0 UNION ALL SELECT 'duplicate_student_ids', count(*) FROM (SELECT sid FROM al GROUP BY sid HAVING count(*) > 1)""",
    SM + ("alloc_log",),
)
def allocation_audit(t):
    return _audit(t)


def _rules(t):
    return {
        "STU_02": stu_02(t), "STATUS_DOMAIN_01": status_domain_01(t), "POOL_JOIN_01": pool_join_01(t),
        "JOIN_01": Q.join_01(t.mentors), "POOL_DIVERSITY_01": pool_diversity_01(t),
    }


@query(
    "Q16_run_all",
    f"""WITH {EXP}, {MX}, v AS (SELECT 'STU_02' AS rule_id, (SELECT count(*) FROM ea WHERE expected <> assigned) AS violations UNION ALL SELECT 'STATUS_DOMAIN_01', (SELECT count(*) FROM mx WHERE grad_status_code = 0 AND NOT (group_code IN ({_DUAL}) AND mentor_type <> 'SCHOOL'))
       UNION ALL SELECT 'POOL_JOIN_01', 1 UNION ALL SELECT 'JOIN_01', 0 UNION ALL SELECT 'POOL_DIVERSITY_01', 1)
      SELECT rule_id, violations, CASE WHEN rule_id = 'POOL_DIVERSITY_01' THEN true ELSE violations = 0 END AS passed FROM v""",
    ("mentors", "alloc_log"),
)
def run_all(t):
    return Q.run_all(_rules(t))[1]


@query(
    "Q17_output_contract",
    f"SELECT 'OUTPUT_CONTRACT' AS rule_id, 'error' AS level, CAST(student_id AS VARCHAR) AS subject, issue AS detail FROM ({ORDER_CHECK}) UNION ALL SELECT 'OUTPUT_CONTRACT', 'error', 'mentor_alias_code', 'missing column'",
)
def output_contract(t):
    from matchloom.plans.queries_trace import trace_order_check

    alloc = t.alloc_log.select("student_id", F.lit("").alias("student_national_code"), F.lit("").alias("mentor"), "mentor_id")
    return Q.output_contract(alloc, t.mentors, trace_order_check(t))


@query(
    "A20_debug_report",
    f"""WITH {EXP}, v AS (SELECT CAST(mentor_id AS VARCHAR) AS subject, assigned || '/' || expected AS detail FROM ea WHERE expected <> assigned)
      SELECT 'STU_02' AS rule_id, (SELECT count(*) FROM v) AS issues, CAST(row_number() OVER (ORDER BY subject, detail) AS INTEGER) AS sample_no, subject, detail FROM v QUALIFY sample_no <= 5""",
    ("alloc_log",),
)
def debug_report(t):
    from matchloom.operators.report import debug_report as op

    return op(stu_02(t))


@query(
    "A22_severity_health",
    f"WITH {EXP}, n AS (SELECT count(*) FILTER (WHERE expected <> assigned) AS p0 FROM ea) SELECT p0, CAST(1 AS BIGINT) AS p1, CAST(0 AS BIGINT) AS p2, CASE WHEN p0 > 0 THEN 'ERROR' ELSE 'WARN' END AS status FROM n",
    ("alloc_log",),
)
def severity_health(t):
    return Q.severity_health(stu_02(t).unionByName(pool_diversity_01(t)))


@query(
    "A19_run_health",
    """WITH r AS (SELECT c_custkey AS run_id, CASE c_custkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'running' ELSE 'success' END AS status, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS qa_passed, c_custkey % 2 AS v FROM customer),
      s AS (SELECT c_custkey AS run_id, c_custkey % 11 = 0 AS f, c_custkey % 13 = 0 AS w FROM customer WHERE c_custkey % 3 > 0), d AS (SELECT c_custkey AS run_id, c_custkey % 17 = 0 AS p0, c_custkey % 19 = 0 AS p1 FROM customer WHERE c_custkey % 2 = 1)
      SELECT r.run_id, CASE WHEN status = 'failed' THEN 'ERROR' WHEN status <> 'success' THEN 'UNVERIFIED' WHEN coalesce(p0, false) OR coalesce(f, false) OR coalesce(qa_passed = false, false) THEN 'ERROR'
        WHEN coalesce(p1 AND NOT p0, false) OR coalesce(w, false) THEN 'WARN' WHEN qa_passed IS NULL OR s.run_id IS NULL OR v > 0 OR (d.run_id IS NOT NULL) <> (v = 1) THEN 'UNVERIFIED' ELSE 'OK' END AS health
      FROM r LEFT JOIN s USING (run_id) LEFT JOIN d USING (run_id)""",
)
def run_health(t):
    k = F.col("c_custkey")
    runs = t.customer.select(
        k.alias("run_id"), F.when(k % 7 == 0, F.lit("failed")).when(k % 7 == 1, F.lit("running")).otherwise(F.lit("success")).alias("status"),
        F.when(k % 5 == 1, F.lit(False)).when(k % 5 > 1, F.lit(True)).alias("qa_passed"), (k % 2).alias("qa_violations"),
    )
    summary = t.customer.where(k % 3 > 0).select(k.alias("run_id"), F.when(k % 11 == 0, F.lit("FAIL")).when(k % 13 == 0, F.lit("WARN")).otherwise(F.lit("PASS")).alias("status"))
    details = t.customer.where(k % 2 == 1).select(k.alias("run_id"), F.when(k % 17 == 0, F.lit("error")).when(k % 19 == 0, F.lit("warning")).otherwise(F.lit("info")).alias("level"))
    return Q.run_health(runs, summary, details)
