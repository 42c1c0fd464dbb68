"""Reports, exports, set operations, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.config import KEYS
from matchloom.operators import report as P
from matchloom.plans import check_sql as ck
from matchloom.plans.queries_matrix import CENTER
from matchloom.plans.queries_references import HIST, _tagged
from matchloom.plans.registry import query
from matchloom.session import ensure_checkpoint_dir
from matchloom.sources import imports as I
from matchloom.sources import tables as D
from matchloom.streaming import entries as E

K = ", ".join(KEYS)


def _folder(t) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/run-{uuid.uuid4().hex}"


# Reports ---------------------------------------------------------------------------


@query(
    "A6_history_metrics",
    f"""WITH {HIST}, h AS (SELECT *, CASE student_id % 3 WHEN 0 THEN 'SCHOOL' WHEN 1 THEN 'GOLESTAN' ELSE 'GENERIC' END AS allocation_channel, coalesce(student_id % 50 = history_mentor_id % 50, false) AS same FROM tagged)
      SELECT allocation_channel, count(*) AS students_total, count(*) FILTER (WHERE history_status = 'already_allocated') AS history_already_allocated, count(*) FILTER (WHERE history_status = 'no_history_match') AS history_no_history_match,
        count(*) FILTER (WHERE history_status = 'missing_or_invalid_national_code') AS history_missing_or_invalid, count(*) FILTER (WHERE same) AS same_history_mentor_true, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS same_history_mentor_ratio
      FROM h GROUP BY allocation_channel""",
    ("history",),
)
def history_metrics(t):
    k = F.col("student_id")
    h = _tagged(t).withColumn("allocation_channel", F.when(k % 3 == 0, F.lit("SCHOOL")).when(k % 3 == 1, F.lit("GOLESTAN")).otherwise(F.lit("GENERIC")))
    return P.history_metrics(h.withColumn("same_history_mentor", k % 50 == F.col("history_mentor_id") % 50))


@query(
    "A8_unallocated_summary",
    "SELECT student_id, 'NO_CAPACITY' AS final_status, group_code FROM students WHERE student_id % 4 <> 0",
    ("students",),
)
def unallocated_summary(t):
    s = t.students.withColumn("final_status", F.when(F.col("student_id") % 4 == 0, F.lit("ALLOCATED")).otherwise(F.lit("NO_CAPACITY")))
    return P.unallocated_summary(s, ["student_id", "final_status", "failure_stage", "group_code"])


@query(
    "A9_key_provenance",
    f"""WITH {CENTER}, s AS (SELECT CASE WHEN r.row_index % 5 = 0 THEN 'missing' ELSE 'raw' END AS g, CASE WHEN r.row_index % 4 = 0 THEN 'missing' WHEN r.row_index % 3 <> 0 THEN 'raw' ELSE 'manager_x' END AS c FROM report r)
      SELECT 'gender_source' AS key_source, CAST(0 AS BIGINT) AS inferred, count(*) FILTER (WHERE g = 'missing') AS defaulted FROM s UNION ALL SELECT 'center_source', count(*) FILTER (WHERE c = 'manager_x'), count(*) FILTER (WHERE c = 'missing') FROM s""",
    ("report", "manager_map"),
)
def key_provenance(t):
    from matchloom.plans.queries_references import join_key_sources

    return P.key_provenance(join_key_sources(t), ["gender_source", "center_source"])


@query(
    "A10_profile_metrics",
    "WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS profile_rows, count(*) AS unique_mentor_ids, count(*) FILTER (WHERE n > 1) AS multi_profile_mentors, round(count(*) FILTER (WHERE n > 1) / count(*), 6) AS multi_profile_ratio FROM p",
)
def profile_metrics(t):
    return P.profile_metrics(t.events.select(F.col("user_id").alias("mentor_id")))


@query(
    "A10_condense",
    """WITH p AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS c FROM p)
      SELECT min(n) AS "min", max(n) FILTER (WHERE rn = CAST(floor((c - 1) * 0.5) AS BIGINT) + 1) AS p50, max(n) FILTER (WHERE rn = CAST(floor((c - 1) * 0.9) AS BIGINT) + 1) AS p90, max(n) AS "max" FROM r""",
)
def condense(t):
    return P.condense(t.events.select(F.col("user_id").alias("mentor_id")))


def _issues(t):
    from matchloom.plans.queries_governance import key_issues

    return key_issues(t)


@query(
    "A12_issue_summary",
    """WITH i AS (SELECT row_id, CASE row_id % 5 WHEN 2 THEN 'DATA_INVALID' WHEN 3 THEN 'DATA_MISSING' END AS e, 'group_code' AS c FROM messy WHERE row_id % 5 IN (2, 3)
        UNION ALL SELECT row_id, 'DATA_MISSING', 'grad_status_code' FROM messy WHERE row_id % 9 IN (0, 1) UNION ALL SELECT row_id, 'DATA_INVALID', 'finance_code' FROM messy WHERE row_id % 10 = 0)
      SELECT 'student' AS entity_type, e AS error_code, count(*) AS issues, min(row_id) AS sample_row, arg_min(c, (row_id, c)) AS sample_column FROM i GROUP BY e""",
    ("messy",),
)
def issue_summary(t):
    return P.issue_summary(_issues(t))


@query("A12_exit_severity", "SELECT count(*) AS issues, CAST(2 AS BIGINT) AS exit_code FROM (SELECT 1 FROM messy WHERE row_id % 5 IN (2, 3) UNION ALL SELECT 1 FROM messy WHERE row_id % 9 IN (0, 1) UNION ALL SELECT 1 FROM messy WHERE row_id % 10 = 0)", ("messy",))
def exit_severity(t):
    return P.exit_severity(_issues(t))


@query(
    "A14_registration_distribution",
    f"SELECT count({ck.to_long('registration_cell')}) AS non_null, count(*) FILTER (WHERE {ck.to_long('registration_cell')} = 0) AS zeros, count(*) FILTER (WHERE {ck.to_long('registration_cell')} = 3) AS threes FROM messy",
    ("messy",),
)
def registration_distribution(t):
    return P.registration_distribution(t.messy, "registration_cell")


@query(
    "A18_export_summary",
    "SELECT (SELECT count(*) FROM customer) AS total_students, count(*) FILTER (WHERE allocation_status = 'success') AS allocated, count(*) FILTER (WHERE allocation_status <> 'success') AS failed FROM alloc_log",
    ("alloc_log",),
)
def export_summary(t):
    return P.export_summary(t.alloc_log, t.customer)


@query("A18_export_errors", "SELECT student_id, coalesce(error_type, allocation_status) AS error FROM alloc_log WHERE allocation_status <> 'success'", ("alloc_log",))
def export_errors(t):
    return P.export_errors(t.alloc_log)


@query(
    "A21_reference_readiness",
    "SELECT 'schools' AS table_name, (SELECT count(*) > 0 FROM schools) AS ready UNION ALL SELECT 'group_codes', true UNION ALL SELECT 'managers', (SELECT count(*) > 0 FROM manager_map WHERE center_code > 7)",
    ("schools", "manager_map"),
)
def reference_readiness(t):
    return D.reference_readiness({"schools": t.schools, "group_codes": t.group_dim, "managers": t.manager_map.where("center_code > 7")})


# Exports ---------------------------------------------------------------------------

_SPECS = {
    "کد ثبت نام": {"source": "df", "field": "row_id"},
    "کد ملی": {"source": "df", "field": "cell", "normalize": ["digits_10"]},
    "تلفن": {"source": "df", "field": "phone_1", "normalize": ["mobile"]},
    "وضعیت": {"source": "df", "field": "registration_cell", "normalize": ["digits"], "map": {"3": "حکمت", "1": "بنیاد", "0": "عادی"}},
    "کد رهگیری": {"source": "literal", "value": "1111111111111111", "when": "وضعیت=3"},
    "تاریخ": {"source": "system", "field": "today"},
    "سال": {"source": "lookup", "lookup": "years", "field": "finance_cell"},
    "خالی": {"source": "empty"},
    "تکرار": {"source": "derived", "from": "finance_cell", "crosswalk": "years"},
}


@query(
    "N30_sabt_projection",
    f"""WITH b AS (SELECT *, regexp_replace({ck.digits(ck.blankable('cell'))}, '[^0-9]', '', 'g') AS d, regexp_replace({ck.digits(ck.blankable('registration_cell'))}, '[^0-9]', '', 'g') AS r FROM messy)
      SELECT CAST(row_id AS VARCHAR) AS "کد ثبت نام", coalesce(lpad(right(nullif(d, ''), 10), 10, '0'), '') AS "کد ملی", coalesce({ck.mobile('phone_1')}, '') AS "تلفن",
        CASE r WHEN '3' THEN 'حکمت' WHEN '1' THEN 'بنیاد' WHEN '0' THEN 'عادی' ELSE r END AS "وضعیت", CASE WHEN r = '3' THEN '1111111111111111' ELSE '' END AS "کد رهگیری", '2024-01-01' AS "تاریخ",
        CASE finance_cell WHEN '0' THEN 'صفر' WHEN '3' THEN 'سه' ELSE '' END AS "سال", '' AS "خالی", CASE finance_cell WHEN '0' THEN 'صفر' WHEN '3' THEN 'سه' ELSE '' END AS "تکرار" FROM b""",
    ("messy",),
)
def sabt_projection(t):
    return P.sabt_projection(t.messy, _SPECS, {"years": {"0": "صفر", "3": "سه"}}, "2024-01-01")


_FORM_SPECS = {
    "کد": {"source": "df", "field": "row_id"},
    "کد ملی": {"source": "gf", "field": "GF_NationalCode", "normalize": ["digits_10"]},
    "نام": {"source": "gf", "field": "101"},
    "پستی": {"source": "gf", "field": "61", "on_value_9000_use": "national_id"},
    "ثبت": {"source": "system", "field": "date_created", "format": "yyyy/mm/dd"},
    "نبود": {"source": "gf", "field": "102"},
}


@query(
    "N30_form_fields",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "کد", lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey + 1 END AS VARCHAR), 10, '0') AS "کد ملی", o_orderstatus AS "نام",
      CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE o_orderkey END AS VARCHAR) AS "پستی", strftime(o_orderdate, '%Y/%m/%d') AS "ثبت", '' AS "نبود" FROM orders WHERE o_custkey > 0""",
)
def form_fields(t):
    k = F.col("o_orderkey")
    rows = t.orders.where("o_custkey > 0").select(
        k.alias("row_id"), F.when(k % 3 == 0, "0.0").otherwise((k + 1).cast("string")).alias("GF_NationalCode"), F.col("o_custkey").alias("national_id"),
        F.col("o_orderstatus").alias("student_name"), F.when(k % 5 == 0, "9000").otherwise(k.cast("string")).alias("کدپستی جایگزین"), F.col("o_orderdate").alias("created_at"),
    )
    return P.sabt_projection(rows, _FORM_SPECS)


@query(
    "N31_export_frame",
    "SELECT CAST(log_id AS VARCHAR) AS \"ردیف\", CAST(mentor_id AS VARCHAR) AS \"پشتیبان\", coalesce(CAST(s.group_code AS VARCHAR), '') AS \"رشته\", '' AS \"نام\" FROM alloc_log LEFT JOIN students s USING (student_id)",
    ("alloc_log", "students"),
)
def export_frame(t):
    profile = [("ردیف", "alloc", "log_id"), ("پشتیبان", "alloc", "mentor_id"), ("رشته", "student", "group_code"), ("نام", "student", "first_name")]
    return P.export_frame(t.alloc_log, t.students, profile)[0]


@query(
    "N31_export_by_profile",
    """SELECT CAST(student_id AS VARCHAR) AS "کد ثبت نام0", coalesce(CAST(s.group_code AS VARCHAR), '') AS "رشته", 'تهران' AS "شهر", CAST(mentor_id AS VARCHAR) AS "پيدا كردن رديف پشتيبان از فيلد ۱۴۱"
      FROM alloc_log LEFT JOIN students s USING (student_id)""",
    ("alloc_log", "students"),
)
def export_by_profile(t):
    """A profile with rows out of order, a removed one, one without order, Arabic letters in a header, and a literal."""
    rows = [
        ("پيدا كردن رديف پشتيبان از فيلد ۱۴۱", None, "40", P.PROFILE_ALLOCATION), ("رشته", "کد رشته", "20.0", P.PROFILE_STUDENT), ("نام", None, "x", P.PROFILE_STUDENT),
        ("کد ثبت نام0", "", "3", P.PROFILE_ALLOCATION), ("تلفن", "", None, P.PROFILE_REMOVED), ("شهر", "تهران", "30", ""), (None, None, None, None),
    ]
    profile = t.spark.createDataFrame(rows, "header string, value_map string, order string, source string")
    columns = P.compile_profile(profile, {"کد رشته": "group_code"})
    return P.export_by_profile(t.alloc_log, t.students, columns)[0]


@query(
    "N32_alias_rule",
    f"""WITH b AS (SELECT row_id, lpad(right(nullif(regexp_replace({ck.digits(ck.blankable('school_cell'))}, '[^0-9]', '', 'g'), ''), 10), 10, '0') AS a, lpad(right(nullif(regexp_replace({ck.digits(ck.blankable('cell'))}, '[^0-9]', '', 'g'), ''), 10), 10, '0') AS p FROM messy)
      SELECT row_id, coalesce(a, p, '') AS postal_out FROM b""",
    ("messy",),
)
def alias_rule(t):
    return P.alias_rule(t.messy, "school_cell", "cell").select("row_id", "postal_out")


# Set operations --------------------------------------------------------------------

SNAP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate"


def _snaps(t):
    li = t.lineitem
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return li.where(F.col("l_shipdate") < "2000-01-01").select(*cols), li.where(F.col("l_shipdate") >= "1998-01-01").select(*cols)


@query(
    "U1_union_branches",
    "SELECT mentor_id, pool_order, 'NORMAL' AS branch FROM mentors WHERE NOT has_school_constraint UNION ALL SELECT mentor_id, pool_order, 'SCHOOL' FROM mentors WHERE has_school_constraint",
    ("mentors",),
)
def union_branches(t):
    m = t.mentors.select("mentor_id", "pool_order", "has_school_constraint")
    a = m.where("not has_school_constraint").withColumn("branch", F.lit("NORMAL")).drop("has_school_constraint")
    b = m.where("has_school_constraint").withColumn("branch", F.lit("SCHOOL")).drop("has_school_constraint")
    return P.union_branches(a, b)


@query(
    "U2_snapshot_diff",
    f"""WITH a AS ({SNAP} < TIMESTAMP '2000-01-01'), b AS ({SNAP} >= TIMESTAMP '1998-01-01')
      SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS added, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS removed, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS row_delta, false AS equal""",
)
def snapshot_diff(t):
    return P.snapshot_diff(*_snaps(t))


@query(
    "U3_same_ids",
    """WITH a AS (SELECT DISTINCT student_id FROM alloc_log WHERE allocation_status = 'success' AND log_id % 9 > 0), b AS (SELECT DISTINCT student_id FROM alloc_log WHERE allocation_status = 'success' AND log_id % 7 > 0)
      SELECT student_id, 'left' AS side FROM a WHERE student_id NOT IN (SELECT student_id FROM b) UNION ALL SELECT student_id, 'right' FROM b WHERE student_id NOT IN (SELECT student_id FROM a)""",
    ("alloc_log",),
)
def same_ids(t):
    ok = t.alloc_log.where("allocation_status = 'success'")
    return P.id_differences(ok.where("log_id % 9 > 0"), ok.where("log_id % 7 > 0"), "student_id")


@query(
    "U4_disjoint_ids",
    "SELECT student_id FROM alloc_log WHERE allocation_status = 'success' INTERSECT SELECT student_id FROM alloc_log WHERE allocation_status = 'failed'",
    ("alloc_log",),
)
def disjoint_ids(t):
    return P.shared_ids(t.alloc_log.where("allocation_status = 'success'"), t.alloc_log.where("allocation_status = 'failed'"), "student_id")


@query(
    "U5_frame_equal",
    """WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
      SELECT *, 'expected' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'actual' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def frame_equal(t):
    li = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber")
    return P.frame_differences(li.where("l_linenumber <= 4"), li.where("l_linenumber >= 3"), ["l_partkey", "l_suppkey"])


# Sources and sinks -----------------------------------------------------------------


@query("S1_read_table", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def read_table(t):
    return D.read_table(t.spark, f"{t.sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey")


@query("S1_read_csv", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, '00' || s_suppkey AS alias, s_name FROM supplier")
def read_csv(t):
    path = _folder(t)
    t.supplier.select("s_suppkey", F.concat(F.lit("00"), F.col("s_suppkey").cast("string")).alias("alias"), "s_name").write.option("header", True).csv(path)
    return D.read_table(t.spark, path, "csv")


@query("S2_load_run_evidence", "SELECT 'r2' AS run_id, mentor_id, count(*) AS n FROM alloc_log WHERE log_id % 2 = 0 GROUP BY mentor_id", ("alloc_log",))
def load_run_evidence(t):
    path = _folder(t)
    for run, rest in (("r1", 1), ("r2", 0)):
        D.append_run(path, run, {"metrics": t.alloc_log.where(F.col("log_id") % 2 == rest).groupBy("mentor_id").agg(F.count(F.lit(1)).alias("n"))})
    return D.load_run_evidence(t.spark, path, "r2", ["metrics"])["metrics"].select("run_id", "mentor_id", "n")


@query("S5_add_lineage", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS src_ordinal FROM events")
def add_lineage(t):
    ev = t.events.select("event_id", "ts")
    return D.add_lineage(ev, [F.col("ts"), F.col("event_id")], [("__d", F.to_date("ts")), ("__s", F.unix_timestamp("ts"))]).select("event_id", "src_ordinal")


@query("S6_load_schools", "SELECT CAST(n_nationkey + 1 AS BIGINT) AS school_code, n_name AS school_name, 'none' AS city FROM nation")
def load_schools(t):
    raw = t.nation.select((F.col("n_nationkey") + 1).cast("string").alias("school_code"), F.col("n_name").alias("school_name"))
    return D.load_schools(raw, {"city": "none"})[0].select("school_code", "school_name", "city")


@query("S6_school_repeats", "SELECT CAST(c_nationkey AS BIGINT) AS school_code, count(*) AS rows FROM customer GROUP BY 1 HAVING count(*) > 1")
def school_repeats(t):
    return D.load_schools(t.customer.select(F.col("c_nationkey").cast("string").alias("school_code")))[1]


@query(
    "S7_load_group_codes",
    """WITH r AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS group_code, CASE p_partkey % 3 WHEN 0 THEN 'کنکوری' WHEN 1 THEN 'هنرستان' ELSE 'x' END AS level FROM part)
      SELECT p_partkey, CASE WHEN group_code NOT IN (SELECT group_code FROM group_dim) THEN 'INVALID_CODE' WHEN level = 'x' THEN 'UNKNOWN_LEVEL' ELSE 'پایه ' || p_partkey % 5 END AS outcome FROM r""",
    ("group_dim",),
)
def load_group_codes(t):
    k = F.col("p_partkey")
    level = F.when(k % 3 == 0, F.lit("کنکوری")).when(k % 3 == 1, F.lit("هنرستان")).otherwise(F.lit("x"))
    df = t.part.select(k, F.col("p_size").cast("bigint").alias("group_code"), level.alias("level"), F.lit("پایه ").alias("grade"), (k % 5).cast("string").alias("track"))
    good, bad = D.load_group_codes(df)
    return good.select("p_partkey", F.col("display_name").alias("outcome")).unionByName(bad.select("p_partkey", F.col("reason").alias("outcome")))


@query(
    "S8_load_managers",
    "SELECT trim(s_name) AS manager, CAST(s_nationkey AS BIGINT) AS center_code FROM supplier WHERE s_suppkey % 5 <> 0",
)
def load_managers(t):
    df = t.supplier.select(F.concat(F.lit("  "), "s_name").alias("manager"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("string")).otherwise(F.lit("?")).alias("center_code"), F.col("s_acctbal").alias("phone"))
    return D.load_managers(df, ["phone"])[0]


@query("S9_students_cache", "SELECT student_id, group_code FROM students", ("students",))
def students_cache(t):
    path = _folder(t)
    D.write_students_cache(t.students, path)
    return D.load_cache(t.spark, path).select("student_id", "group_code")


@query("S10_pool_cache", f"SELECT DISTINCT mentor_id, {K}, '1.0.4' AS policy_version FROM mentors", ("mentors",))
def pool_cache(t):
    path = _folder(t)
    D.write_pool_cache(t.mentors.select("mentor_id", *KEYS).distinct(), path, "1.0.4", "abc")
    return D.load_cache(t.spark, path, {"policy_version": "1.0.4", "policy_hash": "abc"}).drop("policy_hash")


@query("S10_version_state", "SELECT count(*) AS rows, CAST(2 AS BIGINT) AS versions, false AS usable FROM mentors", ("mentors",))
def version_state(t):
    v = F.when(F.col("mentor_id") % 2 == 0, F.lit("1.0.4")).otherwise(F.lit("1.0.3"))
    return D.version_state(t.mentors.withColumn("policy_version", v).withColumn("policy_hash", F.lit("abc")), "1.0.4", "abc")


@query(
    "S11_append_run_metrics",
    """WITH k AS (SELECT center_code, count(*) AS n, CAST(sum(CASE WHEN gender_code = 1 THEN 1 ELSE 0 END) AS BIGINT) AS m FROM students GROUP BY 1)
      SELECT center_code, 'students' AS metric, CAST(n AS DOUBLE) AS value, 'r1' AS run_id FROM k UNION ALL SELECT center_code, 'males', CAST(m AS DOUBLE), 'r1' FROM k""",
    ("students",),
)
def append_run_metrics(t):
    kpi = t.students.groupBy("center_code").agg(F.count(F.lit(1)).alias("students"), F.sum("gender_code").alias("males"))
    path = _folder(t)
    D.append_run(path, "r0", {"kpi": D.metric_rows(kpi.limit(0), ["center_code"], "r0")})
    D.append_run(path, "r1", {"kpi": D.metric_rows(kpi, ["center_code"], "r1")})
    return D.load_run_evidence(t.spark, path, "r1", ["kpi"])["kpi"].select("center_code", "metric", "value", "run_id")


_WORDS = " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))


@query(
    "S12_archive_snapshot",
    f"""WITH r AS (SELECT sha256(CAST(n_name AS VARCHAR) || chr(31) || CAST(n_nationkey AS VARCHAR) || chr(31) || CAST(n_regionkey AS VARCHAR)) AS h FROM nation)
      SELECT count(*) AS rows, {_WORDS} AS hash_sum, false AS truncated, 'r1' AS run_id FROM r""",
)
def archive_snapshot(t):
    return D.archive_snapshot(t.nation.select("n_name", "n_nationkey", "n_regionkey"), _folder(t), {"run_id": "r1"})


@query("S12_stored_snapshot", "SELECT * FROM supplier")
def stored_snapshot(t):
    path = _folder(t)
    D.archive_snapshot(t.supplier, path, {"run_id": "r1"})
    return D.stored_snapshot(t.spark, path)


@query("S13_write_outputs", 'SELECT s_suppkey AS "کد | s_suppkey", s_name AS "نام | s_name" FROM supplier')
def write_outputs(t):
    path = _folder(t) + "/out"
    D.write_outputs({"suppliers": t.supplier.select("s_suppkey", "s_name")}, path, {"s_suppkey": "کد", "s_name": "نام"})
    return t.spark.read.parquet(f"{path}/suppliers")


@query("S14_table_counts", "SELECT 'customer' AS table_name, (SELECT count(*) FROM customer) AS rows UNION ALL SELECT 'orders', (SELECT count(*) FROM orders)")
def table_counts(t):
    return D.table_counts({"customer": t.customer, "orders": t.orders})


@query(
    "S15_import_students",
    """SELECT student_id AS row_id, group_code, grad_status_code FROM students WHERE student_id % 8 <> 0 AND (grad_status_code = 1 OR group_code IN (1, 3))""",
    ("students",),
)
def import_students(t):
    text = lambda c: F.col(c).cast("string")
    raw = t.students.select(
        F.col("student_id").alias("row_id"), F.col("student_id").cast("string").alias("student_id"),
        F.when(F.col("student_id") % 8 != 0, text("group_code")).otherwise(F.lit("?")).alias("کد رشته"), text("gender_code").alias("جنسیت"),
        text("grad_status_code").alias("دانش آموز فارغ"), text("center_code").alias("مرکز"), text("finance_code").alias("مالی"), text("school_code").alias("کد مدرسه"),
    )
    aliases = dict(zip(["کد رشته", "جنسیت", "دانش آموز فارغ", "مرکز", "مالی", "کد مدرسه"], KEYS))
    done = I.import_kind(raw, "students", aliases, "row_id", path=_folder(t))
    return done.rows.select("row_id", "group_code", "grad_status_code")


@query(
    "S16_load_crosswalk",
    "SELECT 'group' AS kind, name AS source, CAST(group_code AS VARCHAR) AS target FROM group_dim UNION ALL SELECT 'synonym', n_name, lower(n_name) FROM nation",
    ("group_dim",),
)
def load_crosswalk(t):
    path = _folder(t)
    D.write_crosswalk(t.group_dim, t.nation.select(F.col("n_name").alias("src"), F.lower("n_name").alias("dst")), path)
    groups, synonyms = D.load_crosswalk(t.spark, path)
    named = groups.select(F.lit("group").alias("kind"), F.col("name").alias("source"), F.col("group_code").cast("string").alias("target"))
    return named.unionByName(synonyms.select(F.lit("synonym").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target")))


# Streams ---------------------------------------------------------------------------


def _entry_stream(t):
    raw = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events*.parquet")
    key = F.when(F.col("event_id") % 40 != 0, F.col("user_id").cast("string"))
    return raw.select("event_id", key.alias("entry_id"), F.col("event_type").alias("formId"), F.col("ts").alias("submitted_at"), F.from_json("props", "map<string,string>").alias("fields"))


@query("T1s_stream_entries", "SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN CAST(user_id AS VARCHAR) END AS entry_id, event_type AS form_id, ts AS received_at, props->>'k' AS k FROM events")
def stream_entries(t):
    path = _folder(t)
    flat = E.flatten_entries(_entry_stream(t), ["k"])
    q = flat.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{path}/data")


LATEST = "SELECT arg_max(event_id, (ts, event_id)) AS event_id, CAST(user_id AS VARCHAR) AS entry_id, arg_max(event_type, (ts, event_id)) AS form_id, max(ts) AS received_at FROM events WHERE event_id % 40 <> 0 GROUP BY user_id"


@query("T2s_upsert_latest_stream", LATEST)
def upsert_latest_stream(t):
    path = _folder(t)
    q = E.upsert_latest(E.flatten_entries(_entry_stream(t)), f"{path}/log", f"{path}/offsets")
    q.awaitTermination()
    return E.read_latest(t.spark, f"{path}/log").select("event_id", "entry_id", "form_id", "received_at")


@query("T2s_upsert_latest_batch", LATEST)
def upsert_latest_batch(t):
    return E.latest_entries(t.entries).select("event_id", "entry_id", "form_id", "received_at")


@query("T3s_resumed_stream", "SELECT event_id, CASE WHEN event_id % 40 <> 0 THEN CAST(user_id AS VARCHAR) END AS entry_id, ts AS received_at FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'")
def resumed_stream(t):
    """A run over the files there were, later files, and a second run on the same checkpoint: its rows."""
    path = _folder(t)
    early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp")

    def run(name: str):
        raw = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/landed")
        key = F.when(F.col("event_id") % 40 != 0, F.col("user_id").cast("string"))
        named = raw.select("event_id", key.alias("entry_id"), F.col("event_type").alias("formId"), F.col("ts").alias("submitted_at"))
        return E.run_once(E.flatten_entries(named), f"{path}/runs", f"{path}/offsets", name)

    t.events.where(early).write.parquet(f"{path}/landed")
    run("first")
    t.events.where(~early).write.mode("append").parquet(f"{path}/landed")
    return run("second").select("event_id", "entry_id", "received_at")


@query(
    "T1s_normalised_rows",
    """SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 11 <> 0 AND event_id % 3 <> 0 THEN event_id % 100 END AS score,
      CASE WHEN event_id % 11 <> 0 THEN event_type END AS tag, event_id % 11 = 0 AS malformed, CASE WHEN event_id % 11 <> 0 AND event_id % 3 = 0 THEN 'score' ELSE '' END AS wrong_types,
      CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN 'odd' ELSE '' END AS unknown_fields FROM events""",
)
def normalised_rows(t):
    """Nested fields, wrong types, unknown names and broken payloads, made of the events."""
    k, kind = F.col("event_id"), F.col("event_type")
    score = F.when(k % 3 == 0, F.lit('"none"')).otherwise((k % 100).cast("string"))
    payload = F.concat(
        F.lit('{"meta":{"kind":"'), kind, F.lit('","score":'), score, F.lit('},"tags":["a","'), kind, F.lit('"]'),
        F.when(k % 7 == 0, F.lit(',"odd":1')).otherwise(F.lit("")), F.when(k % 11 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    fields = {"kind": ("$.meta.kind", "string"), "score": ("$.meta.score", "bigint"), "tag": ("$.tags[1]", "string")}
    out = E.normalise_rows(t.events.select("event_id", payload.alias("payload")), fields)
    return out.select("event_id", "kind", "score", "tag", "malformed", *[F.array_join(c, ",").alias(c) for c in ("wrong_types", "unknown_fields")])


@query("T3s_incremental_since", "SELECT event_id, entry_id FROM entries WHERE received_at >= TIMESTAMP '2024-01-10 00:00:00'", ("entries",))
def incremental_since(t):
    return E.incremental_since(t.entries, "2024-01-10 00:00:00").select("event_id", "entry_id")


@query("T4s_privacy_hook", "SELECT event_id, sha256(entry_id) AS entry_id FROM entries", ("entries",))
def privacy_hook(t):
    return E.privacy_hook(t.entries, lambda d: d.withColumn("entry_id", F.sha2("entry_id", 256))).select("event_id", "entry_id")
