"""Eligibility, ranking and funnel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import KEYS, STAGES
from matchloom.operators import candidates as C
from matchloom.operators import matching as M
from matchloom.plans import check_sql as ck
from matchloom.plans.registry import query
from matchloom.session import cut_lineage

# Check-side join written as the plain rules, independent of the buckets.
PRED = """s.group_code = m.group_code AND s.gender_code = m.gender_code AND s.grad_status_code = m.grad_status_code
  AND (m.center_code = 0 OR (s.center_code <> 0 AND m.center_code = s.center_code))
  AND CASE WHEN s.school_code = 0 THEN NOT m.has_school_constraint
           WHEN m.has_school_constraint THEN m.school_code = s.school_code
           ELSE m.school_code IN (0, s.school_code) END"""
CLASS = "concat_ws('|', s.group_code, s.gender_code, s.grad_status_code, s.center_code, s.finance_code, s.school_code)"
STATE = f"""st AS (SELECT mentor_id, max(remaining_capacity) AS initial FROM mentors GROUP BY mentor_id),
pool AS (SELECT m.*, st.initial, {ck.natural('m.mentor_id')} AS mentor_sort FROM mentors m JOIN st USING (mentor_id))"""
ORDER = "initial DESC, allocations_new, mentor_sort, pool_order"


@query(
    "J1_eligible_candidates",
    f"""SELECT s.student_id, count(m.mentor_id) AS candidates, CAST(coalesce(sum(m.remaining_capacity), 0) AS BIGINT) AS places
    FROM students_gap s LEFT JOIN mentors m ON {PRED} GROUP BY s.student_id""",
    ("students_gap", "mentors"),
)
def eligible_candidates(t):
    return M.candidate_stats(t.students_gap, t.mentors).select("student_id", "candidates", "places")


PAIRS = f"""c AS (SELECT DISTINCT group_code, gender_code, grad_status_code, center_code, finance_code, school_code FROM students),
    pairs AS (SELECT {CLASS} AS class_key, m.* EXCLUDE (group_code, gender_code, grad_status_code, center_code, finance_code, school_code) FROM c s JOIN mentors m ON {PRED})"""


@query(
    "J2_class_pairs",
    f"""WITH {PAIRS} SELECT class_key, mentor_id, pool_order, remaining_capacity FROM pairs""",
    ("students", "mentors"),
)
def class_pairs(t):
    """Every class with every pool row it may take."""
    return C.candidates(t.students, t.mentors).pairs().select("class_key", "mentor_id", "pool_order", "remaining_capacity")


@query(
    "J2_class_counts",
    f"""WITH {PAIRS}
    SELECT {CLASS} AS class_key, count(p.mentor_id) AS candidates, CAST(sum(p.remaining_capacity) AS BIGINT) AS places, CAST(sum(p.pool_order) AS BIGINT) AS members_sum,
      CAST(sum(p.pool_order * (p.pool_order % 97)) AS BIGINT) AS members_mix
    FROM c s LEFT JOIN pairs p ON p.class_key = {CLASS} GROUP BY {CLASS}""",
    ("students", "mentors"),
)
def class_counts(t):
    """Links of each class: their number and two checksums over the linked rows."""
    order = F.col("pool_order")
    out = C.candidates(t.students, t.mentors).counted(places=F.col("remaining_capacity"), members_sum=order, members_mix=order * (order % 97))
    return out.select("class_key", "candidates", "places", "members_sum", "members_mix")


@query(
    "J2_class_membership",
    f"""WITH {PAIRS}, hit AS (SELECT DISTINCT pool_order FROM pairs)
    SELECT m.mentor_id, m.pool_order, h.pool_order IS NOT NULL AS wanted,
      (SELECT count(*) FROM pairs p WHERE p.pool_order = m.pool_order) AS classes FROM mentors m LEFT JOIN hit h USING (pool_order)""",
    ("students", "mentors"),
)
def class_membership(t):
    """From the rows' side: how many classes each pool row is a candidate of."""
    c = C.candidates(t.students, t.mentors)
    readers = c.links.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    per_row = c.members.join(readers, "bucket", "left").groupBy("mentor_id", "pool_order").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("classes"))
    return per_row.select("mentor_id", "pool_order", (F.col("classes") > 0).alias("wanted"), "classes")


VARIANT_HITS = """c AS (SELECT DISTINCT group_code, gender_code, grad_status_code, center_code, finance_code, school_code FROM students),
    k AS (SELECT concat_ws('|', group_code, gender_code, grad_status_code, center_code, finance_code, school_code) AS class_key, * FROM c),
    hit AS (SELECT k.class_key, p.mentor_id, p.pool_order, p.remaining_capacity FROM k JOIN mentors p ON k.group_code = p.group_code AND k.gender_code = p.gender_code
      AND k.grad_status_code = p.grad_status_code AND (p.center_code = 0 OR (k.center_code <> 0 AND p.center_code = k.center_code))
      AND (k.school_code = 0 OR p.school_code IN (0, k.school_code)))"""


def _variants(t):
    return C.variant_candidates(t.students, t.mentors.drop("has_school_constraint"))


@query(
    "J3_bucket_variant_join",
    f"WITH {VARIANT_HITS} SELECT class_key, mentor_id, pool_order FROM hit",
    ("students", "mentors"),
)
def bucket_variant_join(t):
    """Every link by key variants; the check states them as wildcard rules over a pool without the school flag."""
    return _variants(t).pairs().select("class_key", "mentor_id", "pool_order")


@query(
    "J3_bucket_variant_counts",
    f"""WITH {VARIANT_HITS}
    SELECT k.class_key, k.school_code > 0 AND k.center_code > 0 AS by_variants, count(h.pool_order) AS candidates, CAST(sum(h.remaining_capacity) AS BIGINT) AS places,
      CAST(sum(h.pool_order) AS BIGINT) AS members_sum FROM k LEFT JOIN hit h USING (class_key) GROUP BY 1, 2""",
    ("students", "mentors"),
)
def bucket_variant_counts(t):
    """The links of ``J3_bucket_variant_join`` added up per class."""
    out = _variants(t).counted(places=F.col("remaining_capacity"), members_sum=F.col("pool_order"))
    return out.select("class_key", ((F.col("school_code") > 0) & (F.col("center_code") > 0)).alias("by_variants"), "candidates", "places", "members_sum")


STRICT_ROWS = """m AS (SELECT *, remaining_capacity + 2 - (1 + allocations_new) AS rest FROM mentors),
    c AS (SELECT DISTINCT group_code, gender_code, grad_status_code, center_code, finance_code, school_code FROM students),
    k AS (SELECT concat_ws('|', group_code, gender_code, grad_status_code, center_code, finance_code, school_code) AS class_key, * FROM c)"""


def _strict(t):
    mentors = t.mentors.withColumn("capacity_limit", F.col("remaining_capacity") + 2).withColumn("assigned_baseline", F.lit(1).cast("bigint"))
    return C.strict_candidates(t.students, mentors)


STRICT_RULES = """k.group_code = m.group_code AND k.gender_code = m.gender_code AND k.grad_status_code = m.grad_status_code
      AND k.finance_code = m.finance_code AND m.center_code IN (0, k.center_code) AND m.school_code IN (0, k.school_code)"""


@query(
    "J4_matrix_core",
    f"""WITH {STRICT_ROWS}
    SELECT k.class_key, m.mentor_id, m.rest AS remaining_capacity, 1 + m.allocations_new AS total_allocations,
      CASE WHEN m.rest <= 0 THEN 'capacity_exhausted' ELSE '' END AS blocking_codes, m.rest > 0 AS capacity_ok,
      'type=matrix_core,group=ok,gender=ok,graduation_status=ok,center=ok,finance=ok,school=ok,capacity_gate=' ||
        CASE WHEN m.rest > 0 THEN 'ok' ELSE 'blocked' END AS trace
    FROM k JOIN m ON {STRICT_RULES}""",
    ("students", "mentors"),
)
def matrix_core(t):
    """Every link under the strict rules with its capacity outcome and trace."""
    from matchloom.operators.matrix_core import strict_trace

    text = F.array_join(F.transform("trace", lambda e: F.concat(e["stage"], F.lit("="), e["status"])), ",")
    return strict_trace(_strict(t).pairs()).select(
        "class_key", "mentor_id", "remaining_capacity", "total_allocations",
        F.array_join("blocking_codes", ",").alias("blocking_codes"), "capacity_ok", text.alias("trace"),
    )


@query(
    "J4_matrix_core_counts",
    f"""WITH {STRICT_ROWS}
    SELECT k.class_key, count(m.mentor_id) AS candidates, CAST(sum(m.rest) AS BIGINT) AS places, CAST(sum(1 + m.allocations_new) AS BIGINT) AS allocations,
      CAST(sum(CASE WHEN m.rest <= 0 THEN 1 WHEN m.rest > 0 THEN 0 END) AS BIGINT) AS blocked, CAST(sum(m.pool_order) AS BIGINT) AS members_sum
    FROM k LEFT JOIN m ON k.group_code = m.group_code AND k.gender_code = m.gender_code AND k.grad_status_code = m.grad_status_code
      AND k.finance_code = m.finance_code AND m.center_code IN (0, k.center_code) AND m.school_code IN (0, k.school_code) GROUP BY k.class_key""",
    ("students", "mentors"),
)
def matrix_core_counts(t):
    """Links of each class under the strict rules, with their capacity outcome added up."""
    out = _strict(t).counted(
        places=F.col("remaining_capacity"), allocations=F.col("total_allocations"),
        blocked=F.when(F.col("capacity_ok"), 0).otherwise(1), members_sum=F.col("pool_order"),
    )
    return out.select("class_key", "candidates", "places", "allocations", "blocked", "members_sum")


@query(
    "J4_matrix_core_rows",
    f"""WITH {STRICT_ROWS}
    SELECT m.mentor_id, m.pool_order, m.rest AS remaining_capacity, 1 + m.allocations_new AS total_allocations,
      CASE WHEN m.rest <= 0 THEN 'capacity_exhausted' ELSE '' END AS blocking_codes,
      'type=matrix_core,group=ok,gender=ok,graduation_status=ok,center=ok,finance=ok,school=ok,capacity_gate=' || CASE WHEN m.rest > 0 THEN 'ok' ELSE 'blocked' END AS trace,
      (SELECT count(*) FROM k WHERE k.group_code = m.group_code AND k.gender_code = m.gender_code AND k.grad_status_code = m.grad_status_code
        AND k.finance_code = m.finance_code AND m.center_code IN (0, k.center_code) AND m.school_code IN (0, k.school_code)) AS classes FROM m""",
    ("students", "mentors"),
)
def matrix_core_rows(t):
    """The rows behind the links: capacity outcome, trace, and the number of classes each is linked with."""
    from matchloom.operators.matrix_core import strict_trace

    c = _strict(t)
    readers = c.links.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"))
    text = F.array_join(F.transform("trace", lambda e: F.concat(e["stage"], F.lit("="), e["status"])), ",")
    return strict_trace(c.members.join(readers, "bucket", "left")).select(
        "mentor_id", "pool_order", "remaining_capacity", "total_allocations", F.array_join("blocking_codes", ",").alias("blocking_codes"),
        text.alias("trace"), F.coalesce("classes", F.lit(0)).cast("bigint").alias("classes"),
    )


@query(
    "F8_stage_predicates",
    f"""WITH c AS (SELECT DISTINCT s.* EXCLUDE (student_id) FROM students_gap s JOIN mentors m ON {PRED}),
    n AS (SELECT DISTINCT group_code, gender_code, grad_status_code, center_code, finance_code, school_code FROM students_gap)
    SELECT concat_ws('|', n.group_code, n.gender_code, n.grad_status_code, n.center_code, n.finance_code, n.school_code) AS class_key,
      EXISTS (SELECT 1 FROM c WHERE c.group_code = n.group_code AND c.gender_code = n.gender_code AND c.grad_status_code = n.grad_status_code
        AND c.center_code = n.center_code AND c.finance_code = n.finance_code AND c.school_code = n.school_code) AS matched
    FROM n""",
    ("students_gap", "mentors"),
)
def stage_predicates(t):
    """Predicates evaluated on the class level pairs that share the strict keys."""
    from matchloom.operators.predicates import stage_predicates as op

    classes = M.student_classes(t.students_gap)
    profiles = M.pool_profiles(t.mentors)
    m = profiles.select(*[F.col(c).alias(f"m_{c}") for c in (*KEYS, "has_school_constraint")])
    p = op(lambda k: F.col(k), lambda k: F.col(f"m_{k}"))
    strict = [F.col(k) == F.col(f"m_{k}") for k in ("group_code", "gender_code", "grad_status_code")]
    hit = classes.join(m, [*strict, p["center"] & p["finance"] & p["school"]], "left_semi").select("class_key")
    hit = hit.withColumn("matched", F.lit(True))
    return classes.select("class_key").join(hit, "class_key", "left").select(
        "class_key", F.coalesce("matched", F.lit(False)).alias("matched")
    )


FUNNEL = """funnel AS (SELECT s.student_id,
  count(*) FILTER (WHERE g) AS n_type, count(*) FILTER (WHERE g) AS n_group, count(*) FILTER (WHERE g AND d) AS n_gender,
  count(*) FILTER (WHERE g AND d AND t) AS n_graduation_status, count(*) FILTER (WHERE g AND d AND t AND c) AS n_center,
  count(*) FILTER (WHERE g AND d AND t AND c) AS n_finance, count(*) FILTER (WHERE g AND d AND t AND c AND h) AS n_school,
  count(*) FILTER (WHERE g AND d AND t AND c AND h AND remaining_capacity > 0) AS n_capacity_gate,
  CAST((SELECT count(*) FROM mentors) AS BIGINT) AS pool_rows
FROM (SELECT s.student_id, s.group_code = m.group_code AS g, s.gender_code = m.gender_code AS d, s.grad_status_code = m.grad_status_code AS t,
   (m.center_code = 0 OR (s.center_code <> 0 AND m.center_code = s.center_code)) AS c,
   CASE WHEN s.school_code = 0 THEN NOT m.has_school_constraint WHEN m.has_school_constraint THEN m.school_code = s.school_code
     ELSE m.school_code IN (0, s.school_code) END AS h, m.remaining_capacity
   FROM students_gap s CROSS JOIN mentors m) s GROUP BY s.student_id)"""


@query("F9_stage_funnel", f"WITH {FUNNEL} SELECT * FROM funnel", ("students_gap", "mentors"))
def stage_funnel(t):
    return M.stage_funnel(t.students_gap, t.mentors).select("student_id", *[f"n_{s}" for s in STAGES], "pool_rows")


@query(
    "F13_capacity_positive",
    f"""SELECT s.student_id, count(m.mentor_id) AS open_candidates
    FROM students s LEFT JOIN mentors m ON {PRED} AND m.remaining_capacity > 0 GROUP BY s.student_id""",
    ("students", "mentors"),
)
def capacity_positive(t):
    return M.candidate_stats(t.students, t.mentors).select("student_id", "open_candidates")


RANKED = f"""{PAIRS}, {STATE},
    r AS (SELECT p.class_key, m.mentor_id, m.pool_order, row_number() OVER (PARTITION BY p.class_key ORDER BY m.initial DESC, m.allocations_new, m.mentor_sort, m.pool_order) AS rank,
      count(*) OVER (PARTITION BY p.class_key) AS candidates FROM pairs p JOIN pool m USING (pool_order))"""


@query(
    "W1_rank_candidates",
    f"""WITH {RANKED} SELECT class_key, mentor_id, pool_order, rank FROM r""",
    ("students", "mentors"),
)
def rank_candidates(t):
    """Every candidate of every class with its rank."""
    placed = cut_lineage(C.placed_pool(t.mentors))
    return C.ranked_pairs(C.candidates(t.students, placed)).select("class_key", "mentor_id", "pool_order", "rank")


@query(
    "W1_rows_at_ranks",
    f"""WITH {RANKED} SELECT class_key, rank, mentor_id, pool_order FROM r WHERE rank <= 3 OR rank = candidates OR rank = (candidates + 1) // 2""",
    ("students", "mentors"),
)
def rows_at_ranks(t):
    """The first three, the middle and the last candidate of every class, found by their ranks."""
    c = C.candidates(t.students, C.placed_pool(t.mentors))
    n = F.col("candidates")
    wanted = c.counted().select("class_key", F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 3)], F.floor((n + 1) / 2), n)).alias("rank"))
    tree = C.PlaceTree(c)
    named = tree.members.select("place", "mentor_id", "pool_order").distinct()
    return tree.rows_at(wanted).join(named, "place").select("class_key", "rank", "mentor_id", "pool_order")


@query(
    "W1_rank_of_candidate",
    f"""WITH {RANKED} SELECT s.student_id, r.pool_order, r.rank FROM students s JOIN r ON r.class_key = {CLASS}
      AND r.pool_order = (SELECT min(p.pool_order) FROM pairs p WHERE p.class_key = {CLASS})""",
    ("students", "mentors"),
)
def rank_of_candidate(t):
    """The rank of one candidate of each student: of its class's least pool order."""
    c = C.candidates(t.students, C.placed_pool(t.mentors))
    least = c.members.groupBy("bucket").agg(F.min(F.struct("pool_order", "place")).alias("x"))
    asked = c.links.join(least, "bucket").groupBy("class_key").agg(F.min("x").alias("x")).select("class_key", "x.*")
    ranks = C.PlaceTree(c).ranks_of(asked).join(asked, ["class_key", "place"])
    return t.students.select("student_id", M.class_key().alias("class_key")).join(ranks, "class_key").select("student_id", "pool_order", "rank")


@query(
    "W1_top_five",
    f"""WITH {RANKED} SELECT class_key, rank, mentor_id, pool_order FROM r WHERE rank <= 5""",
    ("students", "mentors"),
)
def top_five(t):
    return C.top_ranked(C.candidates(t.students, C.placed_pool(t.mentors)), 5).select("class_key", "rank", "mentor_id", "pool_order")


@query(
    "W2_top_candidate",
    f"""WITH {STATE}, r AS (SELECT s.student_id, m.mentor_id, m.initial, row_number() OVER (PARTITION BY s.student_id ORDER BY {ORDER}) AS rn
      FROM students s JOIN pool m ON {PRED})
    SELECT s.student_id, r.mentor_id AS best_mentor, r.initial AS best_remaining FROM students s LEFT JOIN r ON r.student_id = s.student_id AND rn = 1""",
    ("students", "mentors"),
)
def top_candidate(t):
    return M.candidate_stats(t.students, t.mentors).select("student_id", "best_mentor", "best_remaining")


FAIR = f"""{PAIRS}, {STATE},
    tie AS (SELECT *, sha256(CAST(mentor_id AS VARCHAR)) AS round_robin, sha256(CAST(pool_order AS VARCHAR)) AS deterministic_jitter FROM pool),
    r AS (SELECT p.class_key, m.mentor_id, m.pool_order, s.strategy,
      row_number() OVER (PARTITION BY s.strategy, p.class_key ORDER BY m.initial DESC, m.allocations_new, m.mentor_sort, m.pool_order) AS plain_rank,
      row_number() OVER (PARTITION BY s.strategy, p.class_key ORDER BY m.initial DESC, m.allocations_new,
        CASE s.strategy WHEN 'round_robin' THEN round_robin ELSE deterministic_jitter END, m.mentor_sort, m.pool_order) AS rank
      FROM pairs p JOIN tie m USING (pool_order) CROSS JOIN (VALUES ('round_robin'), ('deterministic_jitter')) s(strategy))"""


@query(
    "W3_fairness_order",
    f"""WITH {FAIR}
    SELECT strategy, class_key, mentor_id, pool_order, rank, bool_or(rank <> plain_rank) OVER (PARTITION BY strategy, class_key) AS order_changed FROM r""",
    ("students", "mentors"),
)
def fairness_order(t):
    """Every candidate of every class with its rank under both strategies; the flag tells whether the class's order is another than the plain one."""
    return C.fair_pairs(t.students, t.mentors)


@query(
    "W3_fairness_top_five",
    f"""WITH {FAIR}, f AS (SELECT strategy, class_key, bool_or(rank <= 5 AND plain_rank <> rank) AS order_changed FROM r GROUP BY ALL)
    SELECT strategy, class_key, rank, mentor_id, pool_order, order_changed FROM r JOIN f USING (strategy, class_key) WHERE rank <= 5""",
    ("students", "mentors"),
)
def fairness_top_five(t):
    """First five of each class under both strategies; the flag tells whether they are other rows, or in another order, than the plain five."""
    return C.fairness_report(t.students, t.mentors)


@query(
    "W3_jitter_by_counter",
    """WITH p AS (SELECT mentor_id, pool_order, remaining_capacity, allocations_new, CASE WHEN pool_order % 4 = 0 THEN concat(' ', CAST(pool_order AS VARCHAR), 'x') WHEN pool_order % 4 = 1 THEN ''
        ELSE lpad(CAST(pool_order AS VARCHAR), 9, '0') END AS counter FROM mentors),
      st AS (SELECT mentor_id, max(remaining_capacity) AS initial FROM p GROUP BY mentor_id),
      h AS (SELECT p.*, initial, sha256(coalesce(nullif(regexp_replace(counter, '[^0-9]', '', 'g'), ''), '0')) AS tie, MENTOR_SORT AS mentor_sort FROM p JOIN st USING (mentor_id)),
      n AS (SELECT *, row_number() OVER (ORDER BY initial DESC, allocations_new, tie, mentor_sort, pool_order) - 1 AS place,
        row_number() OVER (ORDER BY initial DESC, allocations_new, mentor_sort, pool_order) - 1 AS plain FROM h)
      SELECT pool_order, place, bool_or(place <> plain) OVER (PARTITION BY initial, allocations_new) AS block_changed FROM n""".replace("MENTOR_SORT", ck.natural("mentor_id")),
    ("mentors",),
)
def jitter_by_counter(t):
    """Places by the jitter of a counter column with odd cells, and the tie blocks whose order it changes."""
    order = F.col("pool_order")
    cell = F.when(order % 4 == 0, F.concat(F.lit(" "), order.cast("string"), F.lit("x"))).when(order % 4 == 1, F.lit("")).otherwise(F.lpad(order.cast("string"), 9, "0"))
    return C.changed_blocks(t.mentors.withColumn("counter", cell), "deterministic_jitter").select("pool_order", "place", "block_changed")


@query(
    "A4_mentor_state",
    "SELECT mentor_id, max(remaining_capacity) AS initial FROM mentors GROUP BY mentor_id",
    ("mentors",),
)
def mentor_state(t):
    return M.mentor_state(t.mentors)
