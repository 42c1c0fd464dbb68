"""Allocation, ordering and outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import allocate as L
from matchloom.operators import references as R
from matchloom.plans.queries_matching import CLASS, FUNNEL, PRED
from matchloom.plans.registry import query


def _students(t):
    return t.students_gap.withColumn("is_school_student", F.col("school_code") > 0)


def _pool(t):
    n = F.col("n_name")
    conf = t.nation.select(
        F.when(n.isin("NATION_1", "NATION_4", "NATION_7"), 1).when(n.isin("NATION_2", "NATION_8"), 2).when(n == "NATION_6", 0).alias("center_code"),
        n.alias("manager"),
    ).where(F.col("center_code").isNotNull())
    return R.preferred_managers(t.mentors, conf)[0]


_OUT = ("student_id", "order_no", "mentor_id", "capacity_before", "capacity_after", "error_type", "allocation_status")


_CLASS = CLASS.replace("s.", "")


def greedy_sql(gate: str, preferred: str = "false", strict: bool = False) -> str:
    """Step-by-step greedy as a recursive query: one student per step, capacities as lists."""
    if strict:
        order, phase, pred = "student_id", "0", (
            "s.group_code = m.group_code AND s.gender_code = m.gender_code AND s.grad_status_code = m.grad_status_code "
            "AND s.finance_code = m.finance_code AND m.center_code IN (0, s.center_code) AND m.school_code IN (0, s.school_code)"
        )
        pool = "SELECT *, remaining_capacity + 1 - allocations_new AS cap, allocations_new AS load FROM mentors WHERE remaining_capacity + 1 - allocations_new > 0"
    else:
        order = "CASE WHEN school_code > 0 THEN 0 ELSE 1 END, CASE center_code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, student_id"
        phase, pred = "CASE WHEN school_code > 0 THEN 0 ELSE 1 END", PRED
        pool = "SELECT *, remaining_capacity AS cap, 0 AS load FROM mentors"
    students = "students" if strict else "students_gap"
    open_row = "caps[c.r] > 0" if gate == "chosen_row" else "rem[c.m] > 0"
    return f"""WITH RECURSIVE pl AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY pool_order) AS r, dense_rank() OVER (ORDER BY mentor_id) AS m FROM ({pool})),
st AS (SELECT m, max(cap) AS cap, max(load) AS load FROM pl GROUP BY m),
od AS MATERIALIZED (SELECT student_id, row_number() OVER (ORDER BY {order}) AS n, {phase} AS phase, {_CLASS} AS class_key FROM {students}),
cl AS (SELECT DISTINCT * EXCLUDE (student_id), {_CLASS} AS class_key FROM {students}),
cd AS MATERIALIZED (SELECT s.class_key, list({{'r': m.r, 'm': m.m, 'p': ({preferred}) AND m.center_code = s.center_code, 'l': st.load, 'i': st.cap}}) AS cs FROM cl s JOIN pl m ON {pred} JOIN st ON st.m = m.m GROUP BY s.class_key),
g AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT list(cap ORDER BY m) FROM st) AS rem, (SELECT list(cap ORDER BY r) FROM pl) AS caps, CAST(NULL AS BIGINT) AS row_no, CAST(NULL AS BIGINT) AS mentor_no, CAST(NULL AS BIGINT) AS before, '' AS error, CAST(NULL AS VARCHAR) AS pass
 UNION ALL
 SELECT n, CASE WHEN error IS NULL THEN list_transform(rem, lambda x, k: CASE WHEN k = b.m THEN x - 1 ELSE x END) ELSE rem END,
   CASE WHEN error IS NULL THEN list_transform(caps, lambda x, k: CASE WHEN k = b.r THEN rem[b.m] - 1 ELSE x END) ELSE caps END,
   CASE WHEN error IS NULL THEN b.r END, CASE WHEN error IS NULL THEN b.m END, CASE WHEN b.m IS NOT NULL THEN rem[b.m] END, error, pass
 FROM (SELECT *, CASE WHEN cs IS NULL THEN 'ELIGIBILITY_NO_MATCH' WHEN b IS NULL THEN 'CAPACITY_FULL' WHEN rem[b.m] <= 0 THEN 'CAPACITY_UNDERFLOW' END AS error FROM (
   SELECT *, list_sort(list_transform(CASE WHEN pass = 'preferred' THEN list_filter(ok, lambda c: c.p) ELSE ok END, lambda c: {{'a': -rem[c.m], 'l': c.l + c.i - rem[c.m], 's': c.m, 'r': c.r, 'm': c.m}}))[1] AS b FROM (
   SELECT *, CASE WHEN cs IS NULL OR phase = 0 THEN NULL WHEN NOT list_bool_or(list_transform(cs, lambda c: c.p)) THEN 'full' WHEN len(list_filter(ok, lambda c: c.p)) > 0 THEN 'preferred' ELSE 'fallback' END AS pass FROM (
   SELECT g.n + 1 AS n, g.rem, g.caps, od.phase, cd.cs, list_filter(cd.cs, lambda c: {open_row}) AS ok
   FROM g JOIN od ON od.n = g.n + 1 LEFT JOIN cd ON cd.class_key = od.class_key)))))
SELECT od.student_id, od.n AS order_no, CAST(p.mentor_id AS VARCHAR) AS mentor_id, g.before AS capacity_before, CASE WHEN g.error IS NULL THEN g.before - 1 ELSE g.before END AS capacity_after, g.error AS error_type,
  CASE WHEN g.error IS NULL THEN 'success' ELSE 'failed' END AS allocation_status, od.phase AS phase, g.pass AS manager_pass
FROM g JOIN od ON od.n = g.n LEFT JOIN pl p ON p.r = g.row_no"""


_COLS = "student_id, order_no, mentor_id, capacity_before, capacity_after, error_type, allocation_status"
_PREF = "(m.center_code = 1 AND m.manager IN ('NATION_1', 'NATION_4', 'NATION_7')) OR (m.center_code = 2 AND m.manager IN ('NATION_2', 'NATION_8')) OR (m.center_code = 0 AND m.manager = 'NATION_6')"


def _wrap(sql: str, select: str) -> str:
    head, tail = sql.rsplit("\nSELECT od.student_id", 1)
    return f"{head},\nres AS (SELECT od.student_id{tail})\n{select}"


@query("L1_allocate", _wrap(greedy_sql("mentor"), f"SELECT {_COLS} FROM res"), ("students_gap", "mentors"))
def allocate(t):
    return L.allocate(_students(t), t.mentors, row_gate="mentor").decisions.select(*_OUT)


@query("L2_allocate_loop", _wrap(greedy_sql("mentor", strict=True), f"SELECT {_COLS} FROM res"), ("students", "mentors"))
def allocate_loop(t):
    mentors = t.mentors.withColumn("capacity_limit", F.col("remaining_capacity") + 2).withColumn("assigned_baseline", F.lit(1).cast("bigint"))
    return L.allocate_loop(t.students, mentors).decisions.select(*_OUT)


@query("L4_two_phase", _wrap(greedy_sql("chosen_row", _PREF), f"SELECT {_COLS}, phase, manager_pass FROM res"), ("students_gap", "mentors"))
def two_phase(t):
    return L.allocate(_students(t), _pool(t), preferred="preferred").decisions.select(*_OUT, "phase", "manager_pass")


@query(
    "L8_state_delta",
    _wrap(greedy_sql("chosen_row"), "SELECT student_id, mentor_id, capacity_before, capacity_after, capacity_before - capacity_after AS consumed FROM res WHERE allocation_status = 'success'"),
    ("students_gap", "mentors"),
)
def state_delta(t):
    return L.state_delta(L.allocate(_students(t), t.mentors).decisions)


@query(
    "L3_allocate_isolated",
    """WITH s AS (SELECT c_custkey AS student_id, c_custkey % 8 AS b, row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) AS n FROM customer),
      m AS (SELECT s_suppkey AS mentor_id, s_suppkey % 8 AS b, 1 + s_suppkey % 20 AS cap FROM supplier),
      sl AS (SELECT mentor_id, b, r, row_number() OVER (PARTITION BY b ORDER BY r DESC, cap - r, mentor_id) AS n FROM (SELECT *, unnest(generate_series(1, cap)) AS r FROM m))
      SELECT s.student_id, s.b AS bucket, sl.mentor_id, sl.r AS capacity_before FROM s LEFT JOIN sl USING (b, n)""",
)
def allocate_isolated(t):
    students = t.customer.select(F.col("c_custkey").alias("student_id"), (F.col("c_custkey") % 8).alias("bucket"))
    k = F.col("s_suppkey")
    mentors = t.supplier.select(
        k.alias("mentor_id"), (k % 8).alias("bucket"), (k % 20 + 1).alias("remaining_capacity"), F.lit(0).cast("bigint").alias("allocations_new")
    )
    return L.allocate_isolated(students, mentors, "bucket", "student_id")


@query(
    "L5_pool_after",
    """WITH st AS (SELECT mentor_id, max(remaining_capacity) AS c FROM mentors GROUP BY mentor_id), u AS (SELECT mentor_id, count(*) AS n FROM alloc_log WHERE allocation_status = 'success' GROUP BY mentor_id)
      SELECT mentor_id, greatest(c - coalesce(n, 0), 0) AS remaining_capacity, least(coalesce(n, 0), c) AS allocations_new FROM st LEFT JOIN u USING (mentor_id)""",
    ("mentors", "alloc_log"),
)
def pool_after(t):
    return L.pool_after(t.mentors, t.alloc_log.where("allocation_status = 'success'"))


@query(
    "L6_failure_class",
    f"""WITH {FUNNEL} SELECT student_id, CASE WHEN student_id % 23 = 0 THEN 'DATA_MISSING' WHEN n_school = 0 THEN 'ELIGIBILITY_NO_MATCH' WHEN n_capacity_gate = 0 THEN 'CAPACITY_FULL'
      WHEN student_id % 3 = 0 THEN 'CAPACITY_UNDERFLOW' ELSE 'INTERNAL_ERROR' END AS error_type FROM funnel""",
    ("students_gap", "mentors"),
)
def failure_class(t):
    from matchloom.operators import matching as M

    f = M.stage_funnel(t.students_gap, t.mentors)
    f = f.withColumn("data_missing", F.col("student_id") % 23 == 0).withColumn("state_remaining", F.col("student_id") % 3)
    return L.failure_class(f).select("student_id", "error_type")


@query(
    "L7_final_status",
    """SELECT log_id, CASE WHEN allocation_status = 'success' THEN 'ALLOCATED' WHEN log_id % 31 = 0 THEN 'DATA_ERROR'
      WHEN candidate_count = 0 THEN CASE WHEN log_id % 5 = 0 OR log_id % 6 = 0 THEN 'RULE_EXCLUDED' ELSE 'NO_ELIGIBLE_MENTOR' END
      WHEN log_id % 3 = 0 THEN 'NO_CAPACITY' WHEN log_id % 5 = 0 OR log_id % 6 = 0 THEN 'RULE_EXCLUDED' ELSE 'DATA_ERROR' END AS final_status FROM alloc_log""",
    ("alloc_log",),
)
def final_status(t):
    return L.final_status(_log(t)).select("log_id", "final_status")


def _log(t):
    k = F.col("log_id")
    return (
        t.alloc_log.withColumn("error_type", F.when(k % 31 == 0, F.lit("DATA_MISSING")).otherwise(F.col("error_type")))
        .withColumn("rule_reason_code", F.when(k % 5 == 0, F.lit("GROUP_MISMATCH")))
        .withColumn("passed_school", k % 6 != 0)
        .withColumn("passed_capacity", k % 3 != 0)
    )


@query(
    "A7_final_status_counts",
    """WITH f AS (SELECT CASE WHEN allocation_status = 'success' THEN 'ALLOCATED' WHEN log_id % 31 = 0 THEN 'DATA_ERROR'
      WHEN candidate_count = 0 THEN CASE WHEN log_id % 5 = 0 OR log_id % 6 = 0 THEN 'RULE_EXCLUDED' ELSE 'NO_ELIGIBLE_MENTOR' END
      WHEN log_id % 3 = 0 THEN 'NO_CAPACITY' WHEN log_id % 5 = 0 OR log_id % 6 = 0 THEN 'RULE_EXCLUDED' ELSE 'DATA_ERROR' END AS final_status FROM alloc_log)
      SELECT final_status, count(*) AS students FROM f GROUP BY final_status""",
    ("alloc_log",),
)
def final_status_counts(t):
    return L.final_status(_log(t)).groupBy("final_status").agg(F.count(F.lit(1)).alias("students"))


@query(
    "A16_phase_counts",
    """SELECT count(*) FILTER (WHERE school_code > 0) AS school_students, count(*) FILTER (WHERE school_code = 0) AS center_students,
      (SELECT CAST(sum(remaining_capacity) AS BIGINT) FROM mentors) AS places FROM students_gap""",
    ("students_gap", "mentors"),
)
def phase_counts(t):
    return L.phase_counts(_students(t), t.mentors)


@query(
    "W7_student_order",
    """SELECT student_id, row_number() OVER (ORDER BY CASE WHEN school_code > 0 THEN 0 ELSE 1 END, CASE center_code WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 0 THEN 2 ELSE 3 END, student_id) AS order_no FROM students_gap""",
    ("students_gap",),
)
def student_order(t):
    return L.student_order(_students(t)).select("student_id", "order_no")


@query(
    "W7_student_order_by_settings",
    """SELECT student_id, row_number() OVER (ORDER BY CASE WHEN school_code > 0 THEN 0 ELSE 1 END, CASE center_code WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 9 END, student_id) AS order_no FROM students_gap""",
    ("students_gap",),
)
def student_order_by_settings(t):
    """The run's order 0, 2 before the policy's 1, 2, 0."""
    from matchloom.operators import settings as S

    rows = lambda *codes: t.spark.createDataFrame(list(zip(codes, range(len(codes)), strict=True)), "center_code bigint, position int")
    return L.student_order(_students(t), priorities=S.resolved_priority([rows(1, 2, 0), rows(0, 2)])).select("student_id", "order_no")
