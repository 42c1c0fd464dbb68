"""Trace and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import KEYS, STAGES
from matchloom.operators import matching as M
from matchloom.operators import trace as T
from matchloom.operators.matrix_core import trace_pivot as pivot
from matchloom.plans.queries_matching import CLASS, FUNNEL
from matchloom.plans.registry import query

SM = ("students_gap", "mentors")
_EXP = ["s.group_code", "s.group_code", "s.gender_code", "s.grad_status_code", "s.center_code", "s.finance_code", "s.school_code"]
LONG = "tl AS (" + " UNION ALL ".join(
    f"SELECT f.student_id, {i + 1} AS stage_no, '{s}' AS stage, {'pool_rows' if i == 0 else 'n_' + STAGES[i - 1]} AS total_before, n_{s} AS total_after, n_{s} > 0 AS matched, "
    f"{'CAST(' + _EXP[i] + ' AS VARCHAR)' if i < 7 else chr(39) + '>0' + chr(39)} AS expected_value FROM funnel f JOIN students_gap s USING (student_id)"
    for i, s in enumerate(STAGES)
) + ")"


def _funnel(t):
    return M.stage_funnel(t.students_gap, t.mentors)


@query("X1_trace_long", f"WITH {FUNNEL}, {LONG} SELECT * FROM tl", SM)
def trace_long(t):
    return T.trace_long(_funnel(t))


@query(
    "X2_trace_summary",
    f"""WITH {FUNNEL}, {LONG}, lg AS (SELECT student_id, arg_max(allocation_status, log_id) AS allocation_status, arg_max(coalesce(error_type, ''), log_id) AS final_reason FROM alloc_log GROUP BY student_id)
      SELECT f.student_id, (SELECT arg_min(stage, stage_no) FROM tl WHERE tl.student_id = f.student_id AND NOT matched) AS failure_stage, {', '.join(f'n_{s} > 0 AS passed_{s}' for s in STAGES)},
        n_school AS candidate_count, n_capacity_gate AS capacity_candidate_count, n_school > 0 AS has_candidates, lg.allocation_status, coalesce(lg.final_reason, '') AS final_reason
      FROM funnel f LEFT JOIN lg USING (student_id)""",
    SM + ("alloc_log",),
)
def trace_summary(t):
    return T.trace_summary(T.trace_long(_funnel(t)), t.alloc_log, "log_id").drop("error_type")


FAILING = f"""cls AS (SELECT DISTINCT {', '.join(KEYS)}, {CLASS} AS class_key FROM students_gap s),
fk AS (SELECT c.*, f.stage FROM cls c JOIN (SELECT {CLASS} AS class_key, any_value(CASE WHEN n_type = 0 THEN 'type' WHEN n_gender = 0 THEN 'gender' WHEN n_graduation_status = 0 THEN 'graduation_status'
   WHEN n_center = 0 THEN 'center' WHEN n_school = 0 THEN 'school' END) AS stage FROM funnel f JOIN students_gap s USING (student_id) GROUP BY 1) f USING (class_key)),
av AS (SELECT class_key, array_to_string((list_sort(list_distinct(list(v))))[1:10], ',') AS available_values FROM (
   SELECT fk.class_key, CASE stage WHEN 'type' THEN m.group_code WHEN 'gender' THEN m.gender_code WHEN 'graduation_status' THEN m.grad_status_code WHEN 'center' THEN m.center_code ELSE m.school_code END AS v
   FROM fk JOIN mentors m ON CASE stage WHEN 'type' THEN true WHEN 'gender' THEN m.group_code = fk.group_code WHEN 'graduation_status' THEN m.group_code = fk.group_code AND m.gender_code = fk.gender_code
     WHEN 'center' THEN m.group_code = fk.group_code AND m.gender_code = fk.gender_code AND m.grad_status_code = fk.grad_status_code
     WHEN 'school' THEN m.group_code = fk.group_code AND m.gender_code = fk.gender_code AND m.grad_status_code = fk.grad_status_code AND m.center_code IN (0, fk.center_code) END) GROUP BY class_key)"""
PRE = f"""pre AS (SELECT f.student_id, pool_rows AS candidate_count_initial, n_capacity_gate AS candidate_count_final, fk.stage AS first_failing_stage,
   CASE fk.stage WHEN 'type' THEN fk.group_code WHEN 'gender' THEN fk.gender_code WHEN 'graduation_status' THEN fk.grad_status_code WHEN 'center' THEN fk.center_code WHEN 'school' THEN fk.school_code END AS expected_value,
   coalesce(av.available_values, '') AS available_values FROM funnel f JOIN students_gap s USING (student_id) JOIN fk ON fk.class_key = {CLASS} LEFT JOIN av ON av.class_key = fk.class_key)"""
_PRE_COLS = ("student_id", "candidate_count_initial", "candidate_count_final", "first_failing_stage", "expected_value", "available_values")


@query("X3_alignment_preflight", f"WITH {FUNNEL}, {FAILING}, {PRE} SELECT * FROM pre", SM)
def alignment_preflight(t):
    return T.alignment_preflight(t.students_gap, t.mentors).select(*_PRE_COLS)


@query(
    "X3_preflight_abort",
    f"""WITH {FUNNEL}, {FAILING}, {PRE}, n AS (SELECT count(*) AS students, count(*) FILTER (WHERE candidate_count_final = 0) AS without_candidates,
        count(*) FILTER (WHERE candidate_count_final = 0 AND first_failing_stage = 'type') AS failing_at_type FROM pre)
      SELECT *, without_candidates / students >= 0.7 AND failing_at_type / without_candidates >= 0.7 AS abort FROM n""",
    SM,
)
def preflight_abort(t):
    return T.preflight_abort(T.alignment_preflight(t.students_gap, t.mentors))


@query(
    "A17_available_values",
    f"WITH {FUNNEL}, {FAILING}, {PRE} SELECT first_failing_stage, expected_value, available_values, count(*) AS students FROM pre WHERE first_failing_stage IS NOT NULL GROUP BY ALL",
    SM,
)
def available_values(t):
    p = T.alignment_preflight(t.students_gap, t.mentors).where(F.col("first_failing_stage").isNotNull())
    return p.groupBy("first_failing_stage", "expected_value", "available_values").agg(F.count(F.lit(1)).alias("students"))


@query(
    "X4_mismatch_details",
    f"""WITH {FUNNEL}, {FAILING}, d AS (SELECT fk.class_key, array_to_string((list_sort(list_distinct(list(m.group_code))))[1:10], ',') AS dropped FROM fk JOIN mentors m ON m.group_code <> fk.group_code GROUP BY 1)
      SELECT fk.class_key, coalesce(fk.stage, 'type') AS stage, fk.stage IS NOT NULL AS fails, CASE WHEN fk.stage IS NULL THEN d.dropped ELSE coalesce(av.available_values, '') END AS mentor_values
      FROM fk LEFT JOIN d USING (class_key) LEFT JOIN av USING (class_key)""",
    SM,
)
def mismatch_details(t):
    return T.mismatch_details(t.students_gap, t.mentors)


_CODES = " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in T.REASONS.items())


@query(
    "X5_stage_rules",
    f"WITH {FUNNEL}, {LONG} SELECT student_id, stage, total_after > 0 AS passed, CASE WHEN total_after > 0 THEN 'OK' ELSE CASE stage {_CODES} END END AS reason_code FROM tl",
    SM,
)
def stage_rules(t):
    return T.stage_rules(T.trace_long(_funnel(t))).select("student_id", "stage", "passed", "reason_code")


@query(
    "X6_phase_rule",
    """SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 8 = 0 THEN 'INVALID_CENTER_VALUE' WHEN o_orderkey % 6 = 0 AND o_orderkey % 4 = 0 THEN 'NO_MANAGER_FOR_CENTER'
      WHEN o_custkey % 3 IN (SELECT unnest(list_filter([CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 3 END, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 2 END], lambda v: v IS NOT NULL))) THEN NULL ELSE 'CENTER_MISMATCH' END AS reason FROM orders""",
)
def phase_rule(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = t.orders.select(
        o, (c % 9 == 0).alias("is_school_student"), F.when(c % 8 != 0, c % 3).alias("student_center"),
        F.when(o % 6 != 0, F.array(o % 3)).alias("allowed_centers"), F.when(o % 4 != 0, o % 2).alias("mentor_center"),
    )
    return T.phase_rule(pairs).select("o_orderkey", "reason")


@query(
    "X7_alerts",
    f"""WITH {FUNNEL}, l AS (SELECT *, CASE WHEN n_school = 0 THEN 'ELIGIBILITY_NO_MATCH' WHEN n_capacity_gate = 0 THEN 'CAPACITY_FULL' END AS error_type FROM funnel)
      SELECT student_id, error_type AS code, CASE WHEN error_type = 'CAPACITY_FULL' THEN 'capacity_gate' WHEN n_type = 0 THEN 'type' WHEN n_gender = 0 THEN 'gender' WHEN n_graduation_status = 0 THEN 'graduation_status'
        WHEN n_center = 0 THEN 'center' ELSE 'school' END AS stage FROM l WHERE error_type IS NOT NULL
      UNION ALL SELECT student_id, 'INVALID_CENTER', 'center' FROM l WHERE student_id % 19 = 0""",
    SM,
)
def alerts(t):
    f = _funnel(t)
    code = F.when(F.col("n_school") == 0, F.lit("ELIGIBILITY_NO_MATCH")).when(F.col("n_capacity_gate") == 0, F.lit("CAPACITY_FULL"))
    return T.alerts(f.withColumn("error_type", code).withColumn("invalid_center", F.col("student_id") % 19 == 0))


_LABELS = {s: s for s in STAGES}
_FA = "'0123456789', '۰۱۲۳۴۵۶۷۸۹'"


@query(
    "X8_selection_reasons",
    f"""WITH {FUNNEL}, {LONG}, a AS (SELECT student_id, log_id, mentor_id, capacity_before, capacity_after FROM alloc_log WHERE allocation_status = 'success'),
      st AS (SELECT student_id, string_agg(stage || '=' || total_after, '→' ORDER BY stage_no) AS steps FROM tl GROUP BY 1), m AS (SELECT DISTINCT mentor_id FROM mentors)
      SELECT a.student_id, a.mentor_id, translate('جنسیت: ' || CASE s.gender_code WHEN 0 THEN 'دختر' ELSE 'پسر' END || ' — مدرسه: ' || s.school_code || ' (پس‌مدرسه‌ای: خیر) — رشته/گروه: ' || s.group_code ||
        ' — ظرفیت: alloc_new=' || (capacity_before - capacity_after) || '، remaining=' || capacity_after || ' — نتیجه: ' || CASE WHEN m.mentor_id IS NOT NULL THEN 'M' || a.mentor_id ELSE CAST(a.mentor_id AS VARCHAR) END || ' (' || a.mentor_id || ') — سیاست رتبه‌بندی: {T.TIEBREAK}', {_FA}) AS reason,
        translate(st.steps, {_FA}) AS steps FROM a JOIN students_gap s USING (student_id) LEFT JOIN m ON m.mentor_id = a.mentor_id LEFT JOIN st ON st.student_id = a.student_id""",
    SM + ("alloc_log",),
)
def selection_reasons(t):
    alloc = t.alloc_log.where("allocation_status = 'success'").select("student_id", "mentor_id", "capacity_before", "capacity_after")
    mentors = t.mentors.select("mentor_id", F.concat(F.lit("M"), F.col("mentor_id").cast("string")).alias("mentor_name"))
    return T.selection_reasons(alloc, t.students_gap, mentors, T.trace_long(_funnel(t)), _LABELS)


@query(
    "X8_selection_reasons_named",
    f"""WITH {FUNNEL}, {LONG}, a AS (SELECT student_id, log_id, mentor_id, capacity_before, capacity_after FROM alloc_log WHERE allocation_status = 'success'),
      st AS (SELECT student_id, string_agg(stage || '=' || total_after, '→' ORDER BY stage_no) AS steps FROM tl GROUP BY 1)
      SELECT a.student_id, a.mentor_id, translate('جنسیت: ' || CASE s.gender_code WHEN 0 THEN 'دختر' ELSE 'پسر' END || ' — مدرسه: ' || CASE WHEN s.student_id % 3 = 0 THEN CAST(s.school_code AS VARCHAR) ELSE 'مدرسه ' || s.school_code END
        || ' (پس‌مدرسه‌ای: ' || CASE WHEN s.student_id % 4 = 1 THEN 'بله' ELSE 'خیر' END || ') — رشته/گروه: رشته ' || s.group_code || ' — ظرفیت: alloc_new=' || (capacity_before - capacity_after) || '، remaining=' || capacity_after
        || ' — نتیجه: ' || a.mentor_id || ' (' || a.mentor_id || ') — سیاست رتبه‌بندی: {T.TIEBREAK}' || coalesce(' — مراحل: ' || st.steps, ''), {_FA}) AS reason
        FROM a JOIN students_gap s USING (student_id) LEFT JOIN st ON st.student_id = a.student_id""",
    SM + ("alloc_log",),
)
def selection_reasons_named(t):
    alloc = t.alloc_log.where("allocation_status = 'success'").select("student_id", "mentor_id", "capacity_before", "capacity_after")
    k = F.col("student_id")
    students = t.students_gap.withColumns({
        "school_name": F.when(k % 3 != 0, F.concat(F.lit("مدرسه "), F.col("school_code").cast("string"))),
        "group_name": F.concat(F.lit("رشته "), F.col("group_code").cast("string")),
        "after_school": F.when(k % 4 == 1, "Yes").when(k % 4 == 2, "no"),
    })
    mentors = t.mentors.select("mentor_id", F.lit(None).cast("string").alias("mentor_name"))
    done = T.selection_reasons(alloc, students, mentors, T.trace_long(_funnel(t)), _LABELS, with_steps=True, max_chars=None)
    return done.select("student_id", "mentor_id", "reason")


@query(
    "X9_trace_ladder",
    f"""WITH {FUNNEL}, {LONG}, pbx AS (SELECT m.group_code g, m.gender_code d, m.grad_status_code t, cc.c, hh.h, count(*) AS rows FROM mentors m, LATERAL (SELECT unnest([CAST(m.center_code AS VARCHAR), '*']) AS c) cc,
        LATERAL (SELECT unnest(CASE WHEN m.has_school_constraint THEN ['*', 'R:' || m.school_code] ELSE ['*', 'U', 'U:' || m.school_code] END) AS h) hh GROUP BY ALL),
      sb AS (SELECT s.student_id, s.group_code g, s.gender_code d, s.grad_status_code t, cc.c, hh.h FROM students_gap s, LATERAL (SELECT unnest(CASE WHEN s.center_code = 0 THEN ['0'] ELSE ['0', CAST(s.center_code AS VARCHAR)] END) AS c) cc,
        LATERAL (SELECT unnest(CASE WHEN s.school_code = 0 THEN ['U'] ELSE ['R:' || s.school_code, 'U:0', 'U:' || s.school_code] END) AS h) hh),
      bs AS (SELECT sb.student_id, count(*) AS buckets, count(pbx.rows) AS filled_buckets, CAST(coalesce(sum(pbx.rows), 0) AS BIGINT) AS bucket_rows FROM sb LEFT JOIN pbx USING (g, d, t, c, h) GROUP BY 1)
      SELECT tl.student_id, tl.stage, tl.total_after, bs.buckets, bs.filled_buckets, bs.bucket_rows FROM tl JOIN bs USING (student_id)""",
    SM,
)
def trace_ladder(t):
    tl = T.trace_long(_funnel(t))
    return T.trace_ladder(tl, t.students_gap, t.mentors).select("student_id", "stage", "total_after", "buckets", "filled_buckets", "bucket_rows")


DIGEST = "CAST(('0x' || substr(md5({}), 1, 15)) AS BIGINT)"


def _digests(value: str, where: str) -> str:
    return f"CAST(coalesce(sum({DIGEST.format(value)}) FILTER (WHERE {where}), 0) AS VARCHAR)"


_REPORT_ROW = "concat_ws('|', CAST(row_index AS VARCHAR), coalesce(mentor_id, ''))"


@query(
    "X10_pipeline_trace",
    f"""WITH k AS (SELECT *, coalesce(TRY_CAST(covered_now AS BIGINT), 0) < coalesce(TRY_CAST(special_limit AS BIGINT), 0) AS gate, trim(mentor_id) <> '' AS named FROM report),
      n AS (SELECT count(*) AS a, count(*) FILTER (WHERE gate) AS b, count(*) FILTER (WHERE gate AND named) AS c, {_digests(_REPORT_ROW, 'true')} AS x, {_digests(_REPORT_ROW, 'gate')} AS y,
        {_digests(_REPORT_ROW, 'gate AND named')} AS z FROM k)
      SELECT 1 AS stage_no, 'report' AS stage, a AS rows, CAST(0 AS BIGINT) AS removed, x AS fingerprint FROM n UNION ALL SELECT 2, 'capacity_gate', b, a - b, y FROM n
      UNION ALL SELECT 3, 'valid', c, b - c, z FROM n""",
    ("report",),
)
def pipeline_trace(t):
    from matchloom.operators import governance as G

    stages = [("capacity_gate", G.gate_keeps("covered_now", "special_limit")), ("valid", G.names_mentor())]
    return T.pipeline_trace(t.report, stages, ["row_index", "mentor_id"], "report")


_POOL_ROW = "concat_ws('|', mentor_id, group_code, gender_code, grad_status_code, center_code, finance_code, school_code, pool_order)"


@query(
    "X10_governance_trace",
    f"""WITH p AS (SELECT *, CASE WHEN pool_order % 7 = 0 THEN 0 ELSE remaining_capacity END AS room, CASE mentor_id % 6 WHEN 0 THEN 'FROZEN' WHEN 1 THEN 'INACTIVE' ELSE 'ACTIVE' END AS st FROM mentors),
      raw AS (SELECT * FROM p UNION ALL SELECT * REPLACE (pool_order + 1000000 AS pool_order, 0 AS room) FROM p WHERE pool_order % 3 = 0),
      u AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY mentor_id, group_code, gender_code, grad_status_code, center_code, finance_code, school_code ORDER BY pool_order) = 1),
      f AS (SELECT *, manager NOT IN ('NATION_3', 'NATION_12', 'NATION_20') AS a, st = 'ACTIVE' AS b, room > 0 AS c FROM u),
      s AS (SELECT 1 AS stage_no, 'pool' AS stage, count(*) AS rows, {_digests(_POOL_ROW, 'true')} AS fingerprint FROM raw
        UNION ALL SELECT 2, 'deduplicate', count(*), {_digests(_POOL_ROW, 'true')} FROM f UNION ALL SELECT 3, 'manager_filter', count(*) FILTER (WHERE a), {_digests(_POOL_ROW, 'a')} FROM f
        UNION ALL SELECT 4, 'status_filter', count(*) FILTER (WHERE a AND b), {_digests(_POOL_ROW, 'a AND b')} FROM f
        UNION ALL SELECT 5, 'capacity_filter', count(*) FILTER (WHERE a AND b AND c), {_digests(_POOL_ROW, 'a AND b AND c')} FROM f)
      SELECT stage_no, stage, rows, coalesce(lag(rows) OVER (ORDER BY stage_no) - rows, 0) AS removed, fingerprint FROM s""",
    ("mentors",),
)
def governance_trace(t):
    k = F.col("mentor_id") % 6
    pool = t.mentors.withColumn("remaining_capacity", F.when(F.col("pool_order") % 7 == 0, 0).otherwise(F.col("remaining_capacity")))
    pool = pool.withColumn("mentor_status", F.when(k == 0, F.lit("FROZEN")).when(k == 1, F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")))
    later = pool.where(F.col("pool_order") % 3 == 0).withColumn("pool_order", F.col("pool_order") + 1000000).withColumn("remaining_capacity", F.lit(0).cast("bigint"))
    off = t.nation.where(F.col("n_name").isin("NATION_3", "NATION_12", "NATION_20")).select(F.col("n_name").alias("manager"))
    return T.governance_trace(pool.unionByName(later), "pool_order", off, "mentor_status")


@query(
    "X11_trace_pivot",
    """SELECT student_id, 'matrix_core' AS type, 'ok' AS "group", CASE WHEN student_id % 2 = 0 THEN 'ok' ELSE 'blocked' END AS gender, '' AS graduation_status, '' AS center, '' AS finance, '' AS school,
      CASE WHEN student_id % 3 = 0 THEN 'ok' ELSE 'blocked' END AS capacity_gate FROM students""",
    ("students",),
)
def trace_pivot(t):
    e = lambda a, b: F.struct(F.lit(a).alias("stage"), b.alias("status"))
    ok = lambda c: F.when(c, F.lit("ok")).otherwise(F.lit("blocked"))
    k = F.col("student_id")
    tr = F.array(e("type", F.lit("matrix_core")), e("group", F.lit("ok")), e("gender", ok(k % 2 == 0)), e("capacity_gate", ok(k % 3 == 0)))
    return pivot(t.students.select("student_id", tr.alias("trace")), STAGES)


ORDER_CHECK = """WITH s AS (SELECT o_custkey AS student_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, CAST(o_orderkey % 9 AS INTEGER) AS no FROM orders),
      p AS (SELECT *, lag(no) OVER (PARTITION BY student_id ORDER BY seq) AS prev FROM s)
      SELECT student_id, seq, CASE no WHEN 0 THEN 'oops' WHEN 1 THEN 'type' WHEN 2 THEN 'group' WHEN 3 THEN 'gender' WHEN 4 THEN 'graduation_status' WHEN 5 THEN 'center' WHEN 6 THEN 'finance' WHEN 7 THEN 'school' ELSE 'capacity_gate' END AS stage,
        CASE WHEN no = 0 THEN 'TRACE_UNKNOWN_STAGE' ELSE 'TRACE_STAGE_ORDER' END AS issue FROM p WHERE no = 0 OR (no <> 1 AND (prev IS NULL OR prev = 0 OR prev = 8 OR no < prev))"""


@query("W8_trace_order_check", ORDER_CHECK)
def trace_order_check(t):
    from matchloom.operators.numbering import number_rows

    names = F.array(F.lit("oops"), *[F.lit(s) for s in STAGES])
    df = t.orders.select(F.col("o_custkey").alias("student_id"), "o_orderkey", F.element_at(names, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("stage"))
    numbered = number_rows(df, [F.col("o_orderkey")], [("__q", F.floor(F.col("o_orderkey") / 65536))], by=["student_id"], name="seq")
    return T.trace_order_check(numbered)
