"""Gates, pool governance, key validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, KEYS, Policy
from matchloom.functions import text
from matchloom.operators import governance as G
from matchloom.operators import keys_check as V
from matchloom.operators import references as R
from matchloom.plans import check_sql as ck
from matchloom.plans.registry import query

_DUAL = ",".join(str(c) for c in DUAL_STATUS)
K = ", ".join(KEYS)
CUR, SPEC = "coalesce(TRY_CAST(covered_now AS BIGINT), 0)", "coalesce(TRY_CAST(special_limit AS BIGINT), 0)"


@query(
    "F1_capacity_gate",
    f"SELECT row_index, {CUR} < {SPEC} AS kept FROM report",
    ("report",),
)
def capacity_gate(t):
    kept, removed, _ = G.capacity_gate(t.report, "covered_now", "special_limit")
    return kept.select("row_index", F.lit(True).alias("kept")).unionByName(
        removed.select("row_index", F.lit(False).alias("kept"))
    )


@query(
    "F1_capacity_gate_metrics",
    f"""SELECT count(*) FILTER (WHERE {CUR} >= {SPEC}) AS total_removed, CAST(coalesce(sum({SPEC}) FILTER (WHERE {CUR} >= {SPEC}), 0) AS BIGINT) AS special_capacity_lost,
      count(*) FILTER (WHERE {CUR} < {SPEC}) / count(*) AS percent_pool_kept FROM report""",
    ("report",),
)
def capacity_gate_metrics(t):
    return G.capacity_gate(t.report, "covered_now", "special_limit")[2]


@query(
    "F2_drop_invalid_mentors",
    """SELECT row_index, CASE WHEN trim(mentor_id) = '' THEN 'missing mentor employee code' ELSE 'negative remaining capacity' END AS reason
      FROM report WHERE trim(mentor_id) = '' OR balance < 0""",
    ("report",),
)
def drop_invalid_mentors(t):
    return G.invalid_mentors(t.report, "mentor_id", "balance")[1].select("row_index", "reason")


@query(
    "F3_virtual_mentors",
    """WITH m AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'در  انتظار تخصیص ' || s_suppkey WHEN 1 THEN 'گروه فراگیر' ELSE s_name END AS name, 6950 + s_suppkey AS alias FROM supplier)
      SELECT s_suppkey, (s_suppkey % 5 IN (0, 1)) AS virtual_name, (s_suppkey % 5 IN (0, 1) OR alias BETWEEN 7000 AND 7999) AS virtual_any FROM m""",
)
def virtual_mentors(t):
    name = F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("در  انتظار تخصیص "), F.col("s_suppkey").cast("string"))).when(
        F.col("s_suppkey") % 5 == 1, F.lit("گروه فراگیر")
    ).otherwise(F.col("s_name"))
    m = t.supplier.select("s_suppkey", name.alias("name"), (F.col("s_suppkey") + 6950).alias("alias"))
    return m.select("s_suppkey", G.is_virtual("name").alias("virtual_name"), G.is_virtual("name", "alias").alias("virtual_any"))


STATUS_SRC = """ms AS (SELECT s_suppkey AS mentor_id, CASE s_suppkey % 6 WHEN 0 THEN ' frozen' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN '' ELSE NULL END AS raw FROM supplier),
es AS (SELECT mentor_id, CASE WHEN mentor_id % 21 = 0 THEN 'ACTIVE' WHEN mentor_id % 17 = 0 THEN 'INACTIVE' WHEN mentor_id % 8 = 0 THEN 'FROZEN'
   WHEN trim(raw) = 'frozen' THEN 'FROZEN' WHEN raw = 'ACTIVE' THEN 'ACTIVE' ELSE 'ACTIVE' END AS effective_status,
   CASE WHEN mentor_id % 8 = 0 THEN 'FROZEN' WHEN trim(raw) = 'frozen' THEN 'FROZEN' ELSE 'ACTIVE' END AS base_status FROM ms)"""


def _status_inputs(t):
    m = F.col("s_suppkey")
    raw = F.when(m % 6 == 0, F.lit(" frozen")).when(m % 6 == 1, F.lit("ACTIVE")).when(m % 6 == 2, F.lit(""))
    mentors = t.supplier.select(m.alias("mentor_id"), raw.alias("raw"))
    policy_map = t.supplier.where(m % 8 == 0).select(m.alias("mentor_id"), F.lit("Frozen").alias("status"))
    overrides = t.supplier.where((m % 21 == 0) | (m % 17 == 0)).select(m.alias("mentor_id"), (m % 21 == 0).alias("enabled"))
    return mentors, policy_map, overrides


@query("F4_effective_status", f"WITH {STATUS_SRC} SELECT mentor_id, effective_status FROM es")
def effective_status(t):
    m, p, o = _status_inputs(t)
    return G.effective_status(m, p, o, "raw").select("mentor_id", "effective_status")


@query(
    "F5_active_mentors",
    f"WITH {STATUS_SRC} SELECT mentor_id FROM es WHERE effective_status = 'ACTIVE' AND mentor_id % 7 > 0",
)
def active_mentors(t):
    m, p, o = _status_inputs(t)
    m = m.withColumn("remaining_capacity", F.col("mentor_id") % 7)
    return G.active_mentors(G.effective_status(m, p, o, "raw")).select("mentor_id")


GOV_SRC = f"""{STATUS_SRC}, pool AS (SELECT *, pool_order AS ord FROM mentors UNION ALL SELECT *, pool_order + 1000000000 FROM mentors WHERE mentor_id % 4 = 1),
u AS (SELECT *, CASE WHEN mentor_id % 9 = 0 THEN 0 ELSE remaining_capacity END AS room FROM pool QUALIFY row_number() OVER (PARTITION BY mentor_id, {K} ORDER BY ord) = 1),
s AS (SELECT u.*, es.effective_status, es.base_status FROM u JOIN es USING (mentor_id))"""


def _gov(t):
    _, p, o = _status_inputs(t)
    status = _status_inputs(t)[0]
    pool = t.mentors.withColumn("ord", F.col("pool_order"))
    twice = pool.unionByName(pool.where(F.col("mentor_id") % 4 == 1).withColumn("ord", F.col("ord") + 1000000000))
    room = F.when(F.col("mentor_id") % 9 == 0, F.lit(0).cast("bigint")).otherwise(F.col("remaining_capacity"))
    twice = twice.withColumn("remaining_capacity", room).join(status, "mentor_id")
    return G.pool_governance(twice, "ord", p, o, status="raw")


@query(
    "F6_pool_governance",
    f"WITH {GOV_SRC} SELECT mentor_id, pool_order FROM s WHERE effective_status = 'ACTIVE' AND room > 0",
    ("mentors",),
)
def pool_governance(t):
    return _gov(t)[0].select("mentor_id", "pool_order")


@query(
    "F6_pool_governance_stages",
    f"""WITH {GOV_SRC}, n AS (SELECT (SELECT count(*) FROM pool) AS raw, count(*) AS uniq, count(*) FILTER (WHERE effective_status = 'ACTIVE') AS act,
        count(*) FILTER (WHERE effective_status = 'ACTIVE' AND room > 0) AS fin, count(*) FILTER (WHERE effective_status <> 'ACTIVE' AND base_status = 'ACTIVE') AS ovr FROM s)
      SELECT 'deduplicate_profiles' AS stage, raw AS rows_before, uniq AS rows_after, raw - uniq AS duplicates_removed, CAST(0 AS BIGINT) AS inactive_removed, CAST(0 AS BIGINT) AS override_removed, CAST(0 AS BIGINT) AS capacity_removed FROM n
      UNION ALL SELECT 'status_filter', uniq, act, 0, uniq - act - ovr, ovr, 0 FROM n UNION ALL SELECT 'capacity_filter', act, fin, 0, 0, 0, act - fin FROM n""",
    ("mentors",),
)
def pool_governance_stages(t):
    return _gov(t)[1]


@query(
    "F7_manager_governance",
    "SELECT mentor_id, pool_order FROM mentors WHERE manager NOT IN ('NATION_3', 'NATION_12', 'NATION_20')",
    ("mentors",),
)
def manager_governance(t):
    off = t.nation.where(F.col("n_name").isin("NATION_3", "NATION_12", "NATION_20")).select(F.col("n_name").alias("manager"))
    return G.manager_governance(t.mentors, off).select("mentor_id", "pool_order")


RAW_KEYS = """raw AS (SELECT row_id, CASE row_id % 5 WHEN 0 THEN '1' WHEN 1 THEN ' ۲۷ ' WHEN 2 THEN '2' WHEN 3 THEN '' ELSE '24' END AS g,
  CASE row_id % 4 WHEN 0 THEN 'پسر' WHEN 1 THEN '0' WHEN 2 THEN 'زن' ELSE '1' END AS d, CASE row_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '-1' ELSE '1' END AS t,
  CASE row_id % 3 WHEN 0 THEN '0' ELSE '۲' END AS c, CASE row_id % 10 WHEN 0 THEN 'x' ELSE '3' END AS f, CASE row_id % 4 WHEN 0 THEN '' ELSE '12' END AS s FROM messy)"""


def _raw_keys(t):
    r = F.col("row_id")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (r % n + 1).cast("int"))
    return t.messy.select(
        "row_id", pick(5, "1", " ۲۷ ", "2", "", "24").alias("g"), pick(4, "پسر", "0", "زن", "1").alias("d"),
        F.when(r % 9 == 0, F.lit(None)).when(r % 9 == 1, F.lit("-1")).otherwise(F.lit("1")).alias("t"),
        pick(3, "0", "۲", "۲").alias("c"), F.when(r % 10 == 0, F.lit("x")).otherwise(F.lit("3")).alias("f"),
        F.when(r % 4 == 0, F.lit("")).otherwise(F.lit("12")).alias("s"),
    )


_MAP = dict(zip(KEYS, "gdtcfs"))


@query(
    "F10_split_valid_keys",
    f"""WITH {RAW_KEYS} SELECT row_id, CAST(CASE row_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 27 ELSE 24 END AS BIGINT) AS group_code,
      CAST(CASE WHEN d IN ('پسر', '1') THEN 1 ELSE 0 END AS BIGINT) AS gender_code, CAST(t AS BIGINT) AS grad_status_code,
      CAST(CASE WHEN c = '0' THEN 0 ELSE 2 END AS BIGINT) AS center_code, CAST(f AS BIGINT) AS finance_code, CAST(CASE WHEN s = '' THEN '0' ELSE s END AS BIGINT) AS school_code
      FROM raw WHERE row_id % 5 IN (0, 1, 4) AND t = '1' AND f = '3'""",
    ("messy",),
)
def split_valid_keys(t):
    return V.split_valid_keys(_raw_keys(t), "student", "row_id", _MAP)[0].select("row_id", *KEYS)


@query(
    "F10_key_issues",
    f"""WITH {RAW_KEYS} SELECT 'student' AS entity_type, row_id AS row_index, 'group_code' AS "column", g AS raw_value, CASE WHEN g = '' THEN 'DATA_MISSING' ELSE 'DATA_INVALID' END AS error_code FROM raw WHERE g IN ('2', '')
      UNION ALL SELECT 'student', row_id, 'grad_status_code', t, 'DATA_MISSING' FROM raw WHERE t IS NULL OR t = '-1'
      UNION ALL SELECT 'student', row_id, 'finance_code', f, 'DATA_INVALID' FROM raw WHERE f = 'x'""",
    ("messy",),
)
def key_issues(t):
    return V.split_valid_keys(_raw_keys(t), "student", "row_id", _MAP)[1]


@query(
    "F11_student_domain_split",
    f"""WITH s AS (SELECT student_id, CASE WHEN student_id % 31 = 0 THEN NULL ELSE group_code END AS group_code,
        CASE WHEN student_id % 29 = 0 THEN NULL ELSE student_id % 3 % 2 END AS grad_status_code FROM students)
      SELECT student_id AS row_index, group_code, grad_status_code, CASE WHEN group_code IN ({_DUAL}) THEN '1,0' ELSE '1' END AS allowed,
        CASE WHEN group_code IS NULL THEN 'MISSING_GROUP_CODE' WHEN grad_status_code IS NULL THEN 'MISSING_GRADUATION_STATUS' ELSE 'INVALID_GRADUATION_FOR_GROUP' END AS error_code
      FROM s WHERE group_code IS NULL OR grad_status_code IS NULL OR (grad_status_code = 0 AND group_code NOT IN ({_DUAL}))""",
    ("students",),
)
def student_domain_split(t):
    s = t.students.select(
        "student_id",
        F.when(F.col("student_id") % 31 != 0, F.col("group_code")).alias("group_code"),
        F.when(F.col("student_id") % 29 != 0, F.col("student_id") % 3 % 2).alias("grad_status_code"),
    )
    return V.student_domain_split(s, "student_id")[1]


@query(
    "F12_numeric_key_issues",
    f"""WITH {RAW_KEYS} SELECT 'pool' AS entity_type, row_id AS row_index, 'grad_status_code' AS "column", t AS raw_value, 'MISSING_JOIN_KEY_VALUE' AS error_code FROM raw WHERE t IS NULL
      UNION ALL SELECT 'pool', row_id, 'finance_code', f, 'UNKNOWN_JOIN_KEY_VALUE' FROM raw WHERE f = 'x'
      UNION ALL SELECT 'pool', row_id, 'group_code', g, 'MISSING_JOIN_KEY_VALUE' FROM raw WHERE trim(g) = ''
      UNION ALL SELECT 'pool', row_id, 'group_code', g, 'UNKNOWN_JOIN_KEY_VALUE' FROM raw WHERE trim(g) <> '' AND NOT regexp_matches(trim(g), '^[+-]?[0-9]+$')
      UNION ALL SELECT 'pool', row_id, 'school_code', NULL, 'MISSING_JOIN_KEY_COLUMN' FROM raw
      UNION ALL SELECT 'pool', row_id, 'gender_code', d, 'UNKNOWN_JOIN_KEY_VALUE' FROM raw WHERE NOT regexp_matches(d, '^[0-9]+$')
      UNION ALL SELECT 'pool', row_id, 'center_code', c, 'UNKNOWN_JOIN_KEY_VALUE' FROM raw WHERE NOT regexp_matches(c, '^[0-9]+$')""",
    ("messy",),
)
def numeric_key_issues(t):
    df = _raw_keys(t).select("row_id", *[F.col(v).alias(k) for k, v in _MAP.items() if k != "school_code"])
    return V.numeric_key_issues(df, "pool", "row_id")


@query(
    "F17_id_integrity",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 25 = 0 THEN -o_orderkey ELSE o_custkey END AS student_id FROM orders),
      n AS (SELECT student_id, count(*) AS n FROM o GROUP BY 1)
      SELECT o_orderkey, o.student_id, unnest(list_filter([CASE WHEN o.student_id IS NULL THEN 'missing' END, CASE WHEN n > 1 AND o.student_id IS NOT NULL THEN 'duplicate' END,
        CASE WHEN o.student_id IS NOT NULL AND c_custkey IS NULL THEN 'unknown' END], lambda v: v IS NOT NULL)) AS violation
      FROM o LEFT JOIN n ON n.student_id = o.student_id LEFT JOIN customer ON c_custkey = o.student_id""",
)
def id_integrity(t):
    k = F.col("o_orderkey")
    o = t.orders.select(k, F.when(k % 40 == 0, F.lit(None)).when(k % 25 == 0, -k).otherwise(F.col("o_custkey")).alias("student_id"))
    spine = t.customer.select(F.col("c_custkey").alias("student_id"))
    return V.id_integrity(o, spine, "student_id", "o_orderkey")


@query(
    "F18_status_values_valid",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 'UNKNOWN_STATUS' ELSE 'STATUS_NOT_ALLOWED' END AS issue FROM supplier WHERE s_suppkey % 4 IN (1, 2)""",
)
def status_values_valid(t):
    m = F.col("s_suppkey")
    raw = F.when(m % 4 == 1, F.lit("retired")).when(m % 4 == 2, F.lit("Inactive ")).when(m % 4 == 3, F.lit("")).otherwise(F.lit("active"))
    df = t.supplier.select("s_suppkey", raw.alias("raw"))
    return G.status_issues(df, "raw", Policy(allowed_statuses=("ACTIVE", "FROZEN"))).select("s_suppkey", "issue")


@query(
    "S4_required_columns",
    """SELECT 'mentor_id' AS field, 'NULL_VALUES' AS issue, count(*) FILTER (WHERE entry_id IS NULL) AS rows FROM entries HAVING count(*) FILTER (WHERE entry_id IS NULL) > 0
      UNION ALL SELECT 'school_code', 'MISSING_COLUMN', CAST(NULL AS BIGINT)""",
    ("entries",),
)
def required_columns(t):
    from matchloom.sources.tables import contract_issues

    df = t.entries.withColumnRenamed("entry_id", "mentor_id")
    return contract_issues(df, required=("mentor_id", "form_id", "school_code"))


@query(
    "J7_inject_mentor_id",
    f"""WITH m AS (SELECT {ck.norm('mentor_name')} AS k, arg_min(trim(mentor_id), row_index) AS id FROM report WHERE trim(mentor_id) <> '' AND {ck.norm('mentor_name')} <> '' GROUP BY 1),
      p AS (SELECT row_index, replace(mentor_name, 'ي', 'ی') AS mentor_name, CASE WHEN row_index % 2 = 0 THEN mentor_id ELSE '' END AS mentor_id FROM report)
      SELECT row_index, CASE WHEN trim(mentor_id) <> '' THEN mentor_id ELSE coalesce(m.id, '') END AS mentor_id FROM p LEFT JOIN m ON {ck.norm('p.mentor_name')} = m.k""",
    ("report",),
)
def inject_mentor_id(t):
    pool = t.report.select(
        "row_index", F.translate("mentor_name", "ي", "ی").alias("mentor_name"),
        F.when(F.col("row_index") % 2 == 0, F.col("mentor_id")).otherwise(F.lit("")).alias("mentor_id"),
    )
    return R.inject_mentor_id(pool, t.report, "row_index").select("row_index", "mentor_id")


ALIAS_SRC = """p AS (SELECT row_index, CASE WHEN row_index % 3 = 0 THEN '' ELSE mentor_id END AS mentor_id, CAST(100 + row_index % 20 AS VARCHAR) AS alias FROM report),
m AS (SELECT alias, arg_min(mentor_id, row_index) AS id FROM p WHERE trim(mentor_id) <> '' AND alias <> '' GROUP BY alias)"""


def _alias_pool(t):
    return t.report.select(
        "row_index", F.when(F.col("row_index") % 3 == 0, F.lit("")).otherwise(F.col("mentor_id")).alias("mentor_id"),
        (F.lit(100) + F.col("row_index") % 20).cast("string").alias("alias"),
    )


@query(
    "J8_alias_to_mentor",
    f"WITH {ALIAS_SRC} SELECT row_index, CASE WHEN trim(p.mentor_id) = '' THEN coalesce(m.id, '') ELSE p.mentor_id END AS mentor_id FROM p LEFT JOIN m USING (alias)",
    ("report",),
)
def alias_to_mentor(t):
    return R.alias_to_mentor(_alias_pool(t), "alias", "row_index")[0].select("row_index", "mentor_id")


@query(
    "J8_alias_counts",
    f"""WITH {ALIAS_SRC} SELECT count(*) FILTER (WHERE trim(p.mentor_id) = '' AND m.id IS NOT NULL) AS alias_autofill,
      count(*) FILTER (WHERE trim(p.mentor_id) = '' AND m.id IS NULL) AS alias_unmatched FROM p LEFT JOIN m USING (alias)""",
    ("report",),
)
def alias_counts(t):
    return R.alias_to_mentor(_alias_pool(t), "alias", "row_index")[1]


@query(
    "J5_school_lookup",
    f"""WITH n AS (SELECT {ck.norm('school_name')} AS k, min(school_code) AS code FROM schools GROUP BY 1),
      p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(c_nationkey + 1 AS VARCHAR) WHEN 1 THEN '999' WHEN 2 THEN '' ELSE '7' END AS code,
        CASE c_custkey % 3 WHEN 0 THEN 'nation_' || c_nationkey ELSE 'x' END AS name FROM customer)
      SELECT c_custkey, CASE WHEN s.school_code IS NOT NULL THEN s.school_code ELSE coalesce(n.code, TRY_CAST(p.code AS BIGINT)) END AS resolved_school
      FROM p LEFT JOIN schools s ON s.school_code = TRY_CAST(p.code AS BIGINT) LEFT JOIN n ON n.k = {ck.norm('p.name')} AND n.k <> ''""",
    ("schools",),
)
def school_lookup(t):
    k = F.col("c_custkey")
    code = F.when(k % 4 == 0, (F.col("c_nationkey") + 1).cast("string")).when(k % 4 == 1, F.lit("999")).when(k % 4 == 2, F.lit("")).otherwise(F.lit("7"))
    name = F.when(k % 3 == 0, F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))).otherwise(F.lit("x"))
    df = t.customer.select("c_custkey", code.alias("code"), name.alias("name"))
    return R.fill_school_code(df, "code", "name", t.schools).select("c_custkey", "resolved_school")
