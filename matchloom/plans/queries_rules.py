"""Queries with user rules in place of, or beside, the default ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import rules as R
from matchloom.plans.queries_matching import PRED
from matchloom.plans.registry import query


def swapped_center() -> R.StageRule:
    """A center rule the other way round: the student's 0 accepts every mentor, the mentor's 0 only itself."""
    code, any_ = F.col("center_code").cast("string"), F.lit("*")
    student = F.when(F.col("center_code") == 0, F.array(any_)).otherwise(F.array(code))
    return R.StageRule("center", "CENTER_MISMATCH", ("center_code",), ("center_code",), student, F.array(any_, code))


def too_far() -> R.StageRule:
    """No key form: a comparison of two different columns."""
    return R.StageRule("center", "CENTER_TOO_FAR", ("school_code",), ("allocations_new",), residual=F.col("school_code") % 3 != F.col("m_allocations_new"))


def pair_rules() -> tuple[R.PairRule, ...]:
    return (
        R.PairRule("MENTOR_BUSY", F.col("m_allocations_new") >= 2, (), ("allocations_new",)),
        R.PairRule("SCHOOL_NEEDS_OWN_CENTER", (F.col("school_code") > 0) & (F.col("m_center_code") == 0), ("school_code",), ("center_code",)),
    )


STAGES = {
    "g": "s.group_code = m.group_code", "d": "s.gender_code = m.gender_code", "t": "s.grad_status_code = m.grad_status_code",
    "c": "(s.center_code = 0 OR m.center_code = s.center_code)", "r": "s.school_code % 3 <> m.allocations_new",
    "h": "CASE WHEN s.school_code = 0 THEN NOT m.has_school_constraint WHEN m.has_school_constraint THEN m.school_code = s.school_code ELSE m.school_code IN (0, s.school_code) END",
}


def _funnel_sql(residual: bool) -> str:
    """Counts of a nested loop over all students and pool rows, stage by stage."""
    far = " AND r" if residual else ""
    flags = ", ".join(f"{v} AS {k}" for k, v in STAGES.items())
    n = lambda cond: f"count(*) FILTER (WHERE {cond})"
    center = f"g AND d AND t AND c{far}"
    return f"""pairs AS (SELECT s.student_id, m.remaining_capacity, {flags} FROM students_gap s CROSS JOIN mentors m),
funnel AS (SELECT student_id, {n('g')} AS n_type, {n('g')} AS n_group, {n('g AND d')} AS n_gender, {n('g AND d AND t')} AS n_graduation_status,
  {n('g AND d AND t AND c')} AS n_near, {n(center)} AS n_center, {n(center)} AS n_finance, {n(center + ' AND h')} AS n_school,
  {n(center + ' AND h AND remaining_capacity > 0')} AS n_capacity_gate, CAST((SELECT count(*) FROM mentors) AS BIGINT) AS pool_rows
  FROM pairs GROUP BY student_id)"""


NAMES = ("type", "group", "gender", "graduation_status", "center", "finance", "school", "capacity_gate")
COUNTS = ", ".join(f"n_{s}" for s in NAMES)


@query("F9_funnel_swapped_center", f"WITH {_funnel_sql(False)} SELECT student_id, {COUNTS}, pool_rows FROM funnel", ("students_gap", "mentors"))
def funnel_swapped_center(t):
    """Every stage keyed: counted per prefix bucket."""
    rules = R.RuleSet(R.default_rules()).swapped(swapped_center())
    return rules.funnel(t.students_gap, t.mentors).select("student_id", *[f"n_{s}" for s in NAMES], "pool_rows")


@query(
    "F9_funnel_composed_center",
    f"""WITH {_funnel_sql(True)} SELECT student_id, {COUNTS}, pool_rows,
      CASE WHEN n_type = 0 THEN 'TYPE_MISMATCH' WHEN n_gender = 0 THEN 'GENDER_MISMATCH' WHEN n_graduation_status = 0 THEN 'GRADUATION_STATUS_MISMATCH'
        WHEN n_near = 0 THEN 'CENTER_MISMATCH' WHEN n_center = 0 THEN 'CENTER_TOO_FAR' WHEN n_school = 0 THEN 'SCHOOL_STATUS_MISMATCH'
        WHEN n_capacity_gate = 0 THEN 'CAPACITY_FULL' ELSE 'OK' END AS reason FROM funnel""",
    ("students_gap", "mentors"),
)
def funnel_composed_center(t):
    """A center stage of two rules, the second a residual; each has its own reason."""
    rules = R.RuleSet(R.default_rules()).swapped(*R.composed("center", swapped_center(), too_far()))
    return rules.funnel(t.students_gap, t.mentors).select("student_id", *[f"n_{s}" for s in NAMES], "pool_rows", "reason")


@query(
    "X1_trace_swapped_center",
    f"""WITH {_funnel_sql(False)}, u AS (UNPIVOT funnel ON {COUNTS} INTO NAME n VALUE total_after),
      o AS (SELECT student_id, pool_rows, n[3:] AS stage, total_after, list_position([{', '.join(repr(s) for s in NAMES)}], n[3:]) AS stage_no FROM u)
      SELECT student_id, stage_no::INTEGER AS stage_no, stage, coalesce(lag(total_after) OVER (PARTITION BY student_id ORDER BY stage_no), pool_rows) AS total_before,
        total_after, total_after > 0 AS matched FROM o""",
    ("students_gap", "mentors"),
)
def trace_swapped_center(t):
    return R.RuleSet(R.default_rules()).swapped(swapped_center()).trace(t.students_gap, t.mentors)


@query(
    "J1_pair_rule_reasons",
    f"""SELECT s.student_id, CASE WHEN m.allocations_new >= 2 THEN 'MENTOR_BUSY' WHEN s.school_code > 0 AND m.center_code = 0 THEN 'SCHOOL_NEEDS_OWN_CENTER' ELSE 'OK' END AS reason,
      count(*) AS rows, count(*) FILTER (WHERE m.remaining_capacity > 3) AS open_rows
    FROM students_gap s JOIN mentors m ON {PRED} GROUP BY ALL""",
    ("students_gap", "mentors"),
)
def pair_rule_reasons(t):
    """Two user rules over the eligible rows of each student, counted by the first that fails; rows with over three places are open."""
    pool = t.mentors.withColumn("remaining_capacity", F.col("remaining_capacity") - 3)
    return R.RuleSet(R.default_rules()).pair_reasons(t.students_gap, pool, pair_rules())
