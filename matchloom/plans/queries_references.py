"""Reference joins, history, counters, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import KEYS
from matchloom.functions import ids, keys, text
from matchloom.operators import audit as A
from matchloom.operators import matrix as X
from matchloom.operators import numbering as NUM
from matchloom.operators import references as R
from matchloom.operators import standardise as S
from matchloom.plans import check_sql as ck
from matchloom.plans.queries_matrix import BUILD, CELLS, CENTER, VIEWS
from matchloom.plans.queries_matrix import _built
from matchloom.plans.registry import query

K = ", ".join(KEYS)

XWALK = """xw AS (SELECT name AS group_name, group_code, level FROM group_dim)"""
NAME_CELL = """nm AS (SELECT c_custkey AS row_id, CASE c_custkey % 12 WHEN 0 THEN 'دهم رياضی' WHEN 1 THEN 'کل دبستان' WHEN 2 THEN '27' WHEN 3 THEN 'متوسطه 1'
  WHEN 4 THEN 'دهم علوم انسانی' WHEN 5 THEN 'هنر' WHEN 6 THEN '' WHEN 7 THEN 'پایه 11 تجربی' WHEN 8 THEN 'متوسطه اول' WHEN 9 THEN 'ناشناخته' WHEN 10 THEN 'کنکوریها' ELSE 'نهم' END AS token FROM customer)"""


def _names(t):
    words = ["دهم رياضی", "کل دبستان", "27", "متوسطه 1", "دهم علوم انسانی", "هنر", "", "پایه 11 تجربی", "متوسطه اول", "ناشناخته", "کنکوریها", "نهم"]
    pick = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % 12 + 1).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("row_id"), pick.alias("token"), (F.col("c_custkey") % 40).cast("string").alias("major"))


def _xwalk(t):
    return t.group_dim.select(F.col("name").alias("group_name"), "group_code", "level")


_T = "t.t"
_GRADES = " UNION ALL ".join(
    f"SELECT t, 3 AS p, '{n} {m}' AS title FROM d WHERE (contains(t, '{n}') OR contains(t, '{num}')) AND contains(t, '{m}')"
    for num, n in S.GRADES
    for m in S.MAJORS
)
_LEVELS = " UNION ALL ".join(f"SELECT t, '{lv}' AS level FROM d WHERE contains(t, '{w}')" for w, lv in S.LEVEL_WORDS)
_BUCKETS = ", ".join(f"('{k}', '{v}')" for k, v in S.BUCKET_SYNONYMS.items())
_SYN = ", ".join(f"('{k}', '{v}')" for k, v in S.SYNONYMS.items())


@query(
    "N10_expand_group_names",
    f"""WITH {XWALK}, {NAME_CELL}, f AS (SELECT row_id, token, {ck.norm('token')} AS t FROM nm), d AS (SELECT DISTINCT t FROM f WHERE t <> ''),
    x AS (SELECT *, {ck.norm('group_name')} AS k FROM xw),
    b AS (SELECT {ck.norm('s')} AS t, level FROM (VALUES {_BUCKETS}) v(s, level)), sy AS (SELECT {ck.norm('s')} AS t, {ck.norm('dst')} AS k, dst FROM (VALUES {_SYN}) v(s, dst)),
    hits AS (SELECT d.t, 0 AS p, x.group_code, x.group_name FROM d JOIN x ON TRY_CAST(d.t AS BIGINT) = x.group_code
      UNION ALL SELECT d.t, 1, x.group_code, sy.dst FROM d JOIN sy USING (t) JOIN x ON x.k = sy.k
      UNION ALL SELECT d.t, 1, x.group_code, x.group_name FROM d JOIN b USING (t) JOIN x ON x.level = b.level
      UNION ALL SELECT l.t, 2, x.group_code, x.group_name FROM (SELECT DISTINCT * FROM ({_LEVELS})) l JOIN x ON x.level = l.level
      UNION ALL SELECT g.t, 3, x.group_code, g.title FROM ({_GRADES}) g JOIN x ON x.k = g.title),
    al AS (SELECT * FROM hits UNION ALL SELECT d.t, 4, x.group_code, NULL FROM d JOIN x ON x.k = d.t WHERE d.t NOT IN (SELECT t FROM hits)),
    best AS (SELECT t, group_code, min(p) AS p FROM al GROUP BY ALL)
    SELECT f.row_id, best.group_code, CAST(best.p AS BIGINT) AS priority FROM f JOIN best USING (t)""",
    ("group_dim",),
)
def expand_group_names(t):
    return S.expand_group_names(_names(t), "token", "row_id", _xwalk(t)).select("row_id", "group_code", "priority")


RESOLVE = f"""{XWALK}, {NAME_CELL}, kx AS (SELECT {ck.norm('group_name')} AS k, max(group_code) AS code FROM xw GROUP BY 1),
 r AS (SELECT nm.row_id, CASE WHEN list_contains({ck.VALID}, nm.row_id % 40) THEN nm.row_id % 40 END AS m, nm.row_id % 40 AS raw, kx.code AS n FROM nm LEFT JOIN kx ON kx.k = {ck.norm('nm.token')} AND kx.k <> '')"""


@query(
    "N18_resolve_group_code",
    f"WITH {RESOLVE} SELECT row_id, coalesce(m, n) AS resolved_group, CASE WHEN m IS NOT NULL THEN 'major_code' WHEN n IS NOT NULL THEN 'crosswalk' ELSE 'unresolved' END AS resolved_by FROM r",
    ("group_dim",),
)
def resolve_group_code(t):
    return S.resolve_group_code(_names(t), "major", "token", _xwalk(t))[0].select("row_id", "resolved_group", "resolved_by")


@query(
    "N18_resolve_group_counts",
    f"""WITH {RESOLVE} SELECT count(*) FILTER (WHERE m IS NOT NULL) AS resolved_by_major_code, count(*) FILTER (WHERE m IS NULL AND n IS NOT NULL) AS resolved_by_crosswalk,
      count(*) FILTER (WHERE m IS NULL AND n IS NULL) AS unresolved_group_code, count(*) FILTER (WHERE m <> n) AS mismatch_major_vs_group,
      count(*) FILTER (WHERE m IS NULL) AS invalid_major_code FROM r""",
    ("group_dim",),
)
def resolve_group_counts(t):
    return S.resolve_group_code(_names(t), "major", "token", _xwalk(t))[1]


@query(
    "N19_apply_crosswalk",
    f"""WITH {XWALK}, {NAME_CELL}, kx AS (SELECT {ck.norm('group_name')} AS k, max(group_code) AS code FROM xw GROUP BY 1)
      SELECT nm.row_id, coalesce(num.group_code + 1000, kx.code) AS mapped FROM nm LEFT JOIN xw num ON num.group_code = TRY_CAST({ck.numlike('nm.token')} AS BIGINT) LEFT JOIN kx ON kx.k = {ck.norm('nm.token')} AND kx.k <> ''""",
    ("group_dim",),
)
def apply_crosswalk(t):
    textual = t.group_dim.select(F.col("name").alias("source"), F.col("group_code").alias("target"))
    numeric = t.group_dim.select(F.col("group_code").cast("string").alias("source"), (F.col("group_code") + 1000).alias("target"))
    good, bad = S.apply_crosswalk(_names(t), "token", textual.unionByName(numeric))
    return good.select("row_id", "mapped").unionByName(bad.select("row_id", F.lit(None).cast("bigint").alias("mapped")))


@query(
    "N38_join_key_sources",
    f"""WITH {CENTER} SELECT r.row_index, 'raw' AS group_source, CASE WHEN r.row_index % 5 = 0 THEN 'missing' ELSE 'raw' END AS gender_source,
      CASE WHEN r.row_index % 4 = 0 THEN 'missing' WHEN r.row_index % 3 <> 0 THEN 'raw' WHEN mc.k IS NULL THEN 'manager_wildcard' WHEN mc.k = mc.m THEN 'manager_exact' ELSE 'manager_substring' END AS center_source
      FROM report r JOIN mc ON {ck.norm('r.manager')} = mc.m""",
    ("report", "manager_map"),
)
def join_key_sources(t):
    n = F.col("row_index")
    one = F.lit(1).cast("bigint")
    df = t.report.select(
        n, "manager", one.alias("group_code"), F.when(n % 5 != 0, one).alias("gender_code"), one.alias("grad_status_code"),
        F.when(n % 4 != 0, n % 3).alias("center_code"), one.alias("finance_code"), one.alias("school_code"),
    )
    m = R.center_from_manager(df, "manager", t.manager_map)
    out = S.join_key_sources(m, "manager", F.col("manager_match") == "manager_exact", F.col("manager_match") == "manager_substring")
    return out.select("row_index", "group_source", "gender_source", "center_source")


@query(
    "N39_standard_columns",
    f"SELECT row_id, TRY_CAST(regexp_extract({ck.numlike('cell')}, '^(-?[0-9]+)', 1) AS BIGINT) AS \"کد مدرسه\" FROM messy",
    ("messy",),
)
def standard_columns(t):
    rules = {"school id": ("کد مدرسه", "school_code", True)}
    df = t.messy.select("row_id", F.regexp_extract(text.numlike("cell"), "^(-?[0-9]+)", 1).alias("school id"))
    out, _ = S.standard_columns(df, rules)
    return out.select("row_id", "کد مدرسه")


@query(
    "N40_mentor_report_defaults",
    """SELECT row_index, CAST(CASE WHEN coalesce(school_code_1, '') NOT IN ('', '0') THEN 1 ELSE 0 END + CASE WHEN coalesce(school_name_2, '') NOT IN ('', '-') THEN 1 ELSE 0 END AS BIGINT) AS school_count,
      CAST(NULL AS VARCHAR) AS postal_code, CAST(0 AS BIGINT) AS covered_now, special_limit FROM report""",
    ("report",),
)
def mentor_report_defaults(t):
    df = t.report.drop("school_count", "postal_code", "covered_now")
    out = S.mentor_report_defaults(df, ("mentor_id", "group_spec", "school_count"), ("school_code_1", "school_name_2"))
    return out.select("row_index", "school_count", "postal_code", "covered_now", "special_limit")


@query(
    "S3_resolve_headers",
    """SELECT row_id, coalesce(phone_1, phone_2) AS mobile, birth_cell AS birth FROM messy""",
    ("messy",),
)
def resolve_headers(t):
    df = t.messy.select("row_id", F.col("phone_1").alias("تلفن همراه"), F.col("phone_2").alias("Mobile_Number"), F.col("birth_cell").alias("تاريخ تولد"))
    aliases = {"تلفن همراه": "mobile", "mobile number": "mobile", "تاریخ تولد": "birth", "Mobile_Number": "mobile"}
    return S.resolve_headers(df, aliases)[0]


@query(
    "S3_header_issues",
    """SELECT 'row_id' AS header, CAST(NULL AS VARCHAR) AS canonical_field, 'UNKNOWN_HEADER' AS message, CAST(0 AS BIGINT) AS conflict_count
      UNION ALL SELECT 'تلفن همراه,Mobile_Number', 'mobile', 'AMBIGUOUS_HEADER', count(*) FILTER (WHERE phone_1 <> phone_2) FROM messy""",
    ("messy",),
)
def header_issues(t):
    df = t.messy.select("row_id", F.col("phone_1").alias("تلفن همراه"), F.col("phone_2").alias("Mobile_Number"))
    return S.resolve_headers(df, {"تلفن همراه": "mobile", "Mobile_Number": "mobile"})[1]


HIST = """snap AS (SELECT national_code AS code, arg_max(mentor_id, (o_orderdate, o_orderkey)) AS history_mentor_id, arg_max(center_code, (o_orderdate, o_orderkey)) AS history_center_code FROM history GROUP BY 1),
stu AS (SELECT c_custkey AS student_id, CASE WHEN c_custkey % 15 = 0 THEN '-' WHEN c_custkey % 15 = 1 THEN CAST(c_custkey + 100000000 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS national_code FROM customer),
tagged AS (SELECT s.*, snap.history_mentor_id, snap.history_center_code, CASE WHEN national_code = '-' THEN 'missing_or_invalid_national_code' WHEN snap.code IS NOT NULL THEN 'already_allocated' ELSE 'no_history_match' END AS history_status
  FROM stu s LEFT JOIN snap ON snap.code = lpad(national_code, 10, '0') AND national_code <> '-')"""


def _hist_students(t):
    k = F.col("c_custkey")
    code = F.when(k % 15 == 0, F.lit("-")).when(k % 15 == 1, (k + 100000000).cast("string")).otherwise(k.cast("string"))
    return t.customer.select(k.alias("student_id"), code.alias("national_code"))


def _tagged(t):
    return R.dedupe_by_history(_hist_students(t), t.history, ["o_orderdate", "o_orderkey"])


@query(
    "J9_dedupe_by_history",
    f"WITH {HIST} SELECT student_id, history_status, CASE WHEN history_status = 'already_allocated' THEN 'history_match' ELSE history_status END AS dedupe_reason, history_mentor_id, history_center_code FROM tagged",
    ("history",),
)
def dedupe_by_history(t):
    return _tagged(t).drop("national_code")


@query(
    "J10_attach_history",
    f"""WITH {HIST} SELECT c.c_custkey AS student_id, coalesce(t.history_status, '') AS history_status, t.history_mentor_id, coalesce(c.c_custkey % (SELECT count(*) FROM supplier) = t.history_mentor_id, false) AS same_history_mentor
      FROM customer c LEFT JOIN tagged t ON t.student_id = c.c_custkey AND c.c_custkey % 7 <> 0""",
    ("history",),
)
def attach_history(t):
    summary = t.customer.select(F.col("c_custkey").alias("student_id"), (F.col("c_custkey") % t.supplier.count()).alias("mentor_id"))
    info = _tagged(t).where(F.col("student_id") % 7 != 0).withColumn("seq", F.lit(1))
    return R.attach_history(summary, info, ["seq"]).select("student_id", "history_status", "history_mentor_id", "same_history_mentor")


ALLOC = """al AS (SELECT o_orderkey AS row_id, o_custkey AS student_id, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_orderkey % (SELECT count(*) FROM supplier) END AS mentor_id, CAST(1000 + o_orderkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS alias FROM orders),
pl AS (SELECT *, CAST(1000 + mentor_id AS VARCHAR) AS alias FROM mentors),
pr AS (SELECT al.row_id, al.student_id, al.mentor_id AS asked, pl.mentor_id, pl.mentor_id IS NOT NULL AS found, al.mentor_id IN (SELECT mentor_id FROM pl) AS by_id,
  s.group_code = pl.group_code AS g, s.gender_code = pl.gender_code AS d, s.grad_status_code = pl.grad_status_code AS t, s.center_code = pl.center_code AS c,
  s.finance_code = pl.finance_code AS f, s.school_code = pl.school_code AS h, pl.has_school_constraint AS r, pl.center_code = 0 AS c0, s.school_code = 0 OR pl.school_code = 0 AS h0
  FROM al LEFT JOIN students s USING (student_id) LEFT JOIN pl ON pl.mentor_id = al.mentor_id OR (al.mentor_id NOT IN (SELECT mentor_id FROM pl) AND pl.alias = al.alias))"""


def _alloc(t):
    k, mentors = F.col("o_orderkey"), t.supplier.count()
    return t.orders.select(
        k.alias("row_id"), F.col("o_custkey").alias("student_id"),
        F.when(k % 13 == 0, F.lit(-1).cast("bigint")).otherwise(k % mentors).alias("mentor_id"),
        (F.lit(1000) + k % mentors).cast("string").alias("alias"),
    )


def _alloc_pool(t):
    return t.mentors.withColumn("alias", (F.col("mentor_id") + 1000).cast("string"))


@query(
    "J11_join_key_audit",
    f"""WITH {ALLOC}, a AS (SELECT row_id, any_value(student_id) AS student_id, any_value(CASE WHEN by_id THEN 'mentor_id' WHEN found THEN 'mentor_alias' ELSE 'missing' END) AS lookup_mode,
        coalesce(bool_or(g AND d AND t AND c AND f AND h), false) AS valid, coalesce(bool_or(g), false) AS g, coalesce(bool_or(d), false) AS d, coalesce(bool_or(t), false) AS t,
        coalesce(bool_or(c), false) AS c, coalesce(bool_or(f), false) AS f, coalesce(bool_or(h), false) AS h FROM pr GROUP BY row_id)
      SELECT row_id, student_id, lookup_mode, valid, CASE WHEN valid THEN '' ELSE concat_ws(',', CASE WHEN NOT g THEN 'group' END, CASE WHEN NOT d THEN 'gender' END, CASE WHEN NOT t THEN 'status' END,
        CASE WHEN NOT c THEN 'center' END, CASE WHEN NOT f THEN 'finance' END, CASE WHEN NOT h THEN 'school' END) END AS mismatch_summary FROM a""",
    ("students", "mentors"),
)
def join_key_audit(t):
    return A.join_key_audit(_alloc(t), t.students, _alloc_pool(t)).select(
        "row_id", "student_id", "lookup_mode", "valid", "mismatch_summary"
    )


_J12 = f"""{ALLOC}, w AS (SELECT *, coalesce(CASE WHEN NOT r THEN true ELSE h0 OR h END, false) AS hw, c0 OR c AS cw FROM pr),
a12 AS (SELECT student_id, coalesce(bool_or(g AND d AND t AND cw AND found AND hw), false) AS valid FROM w GROUP BY student_id)"""


@query("J12_join_key_audit_wildcard", f"WITH {_J12} SELECT student_id, valid FROM a12", ("students", "mentors"))
def join_key_audit_wildcard(t):
    return A.join_key_audit_wildcard(_alloc(t), t.students, _alloc_pool(t)).select("student_id", "valid")


@query(
    "Q14_alloc_join_02",
    f"WITH {_J12} SELECT count(*) FILTER (WHERE NOT valid) AS invalid_count, count(*) AS total, round(count(*) FILTER (WHERE NOT valid) / count(*), 6) AS invalid_ratio, count(*) FILTER (WHERE NOT valid) = 0 AS passed FROM a12",
    ("students", "mentors"),
)
def alloc_join_02(t):
    return A.audit_summary(A.join_key_audit_wildcard(_alloc(t), t.students, _alloc_pool(t)))


@query(
    "J13_validate_selected",
    """WITH p AS (SELECT s.student_id, s.group_code sg, s.gender_code sd, CASE WHEN s.student_id % 17 = 0 THEN NULL ELSE s.grad_status_code END st, s.center_code sc, s.finance_code sf, s.school_code sh,
       m.group_code mg, m.gender_code md, m.grad_status_code mt, m.center_code mc, m.finance_code mf, m.school_code mh FROM students s JOIN (SELECT * FROM mentors QUALIFY row_number() OVER (PARTITION BY mentor_id ORDER BY pool_order) = 1) m ON m.mentor_id = s.student_id % (SELECT count(*) FROM supplier))
      SELECT student_id, sg = mg AND sd = md AND coalesce(st = mt, false) AND (sc = 0 OR mc = 0 OR sc = mc) AND (sh = 0 OR mh = 0 OR sh = mh) AS join_valid,
       concat_ws(',', CASE WHEN sg <> mg THEN 'group:unequal' END, CASE WHEN sd <> md THEN 'gender:unequal' END, CASE WHEN st IS NULL THEN 'status:missing' WHEN st <> mt THEN 'status:unequal' END,
         CASE WHEN NOT (sc = 0 OR mc = 0 OR sc = mc) THEN 'center:unequal' END, CASE WHEN NOT (sh = 0 OR mh = 0 OR sh = mh) THEN 'school:unequal' END) AS mismatches FROM p""",
    ("students", "mentors"),
)
def validate_selected(t):
    m = NUM.first_row(t.mentors, ["mentor_id"], ["pool_order"]).select("mentor_id", *[F.col(k).alias(f"m_{k}") for k in KEYS])
    s = t.students.select("student_id", (F.col("student_id") % t.supplier.count()).alias("mentor_id"), *[F.col(k).alias(f"s_{k}") for k in KEYS])
    s = s.withColumn("s_grad_status_code", F.when(F.col("student_id") % 17 != 0, F.col("s_grad_status_code")))
    return A.validate_selected(s.join(m, "mentor_id")).select("student_id", "join_valid", "mismatches")


@query("J14_safe_join_violations", "SELECT o_custkey AS student_id, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def safe_join_violations(t):
    return R.unique_violations(t.orders.withColumnRenamed("o_custkey", "student_id"), ["student_id"])


@query(
    "J14_safe_join",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
)
def safe_join(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.safe_join(t.orders, right, ["o_custkey"]).select("o_orderkey", "c_name")


@query(
    "J15_export_join",
    """WITH m AS (SELECT mentor_id, arg_min(manager, pool_order) AS mentor_manager, arg_min(CASE WHEN group_code > 1 THEN group_code END, CASE WHEN group_code > 1 THEN pool_order END) AS mentor_big_group FROM mentors GROUP BY mentor_id)
      SELECT o_orderkey AS row_id, s.center_code AS student_center_code, m.mentor_manager, m.mentor_big_group FROM orders LEFT JOIN students s ON s.student_id = o_custkey LEFT JOIN m ON m.mentor_id = o_orderkey % (SELECT count(*) FROM supplier)""",
    ("students", "mentors"),
)
def export_join(t):
    alloc = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % t.supplier.count()).alias("mentor_id"))
    mentors = t.mentors.select("mentor_id", "manager", F.when(F.col("group_code") > 1, F.col("group_code")).alias("big_group"), "pool_order")
    return A.export_join(alloc, t.students.select("student_id", "center_code"), mentors, "pool_order").select(
        "row_id", "student_center_code", "mentor_manager", "mentor_big_group"
    )


@query(
    "J16_coalesce_from_summary",
    "SELECT c_custkey AS student_id, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 2 = 0 THEN 'S' || c_custkey END AS name FROM customer",
)
def coalesce_from_summary(t):
    k = F.col("c_custkey")
    students = t.customer.select(k.alias("student_id"), F.when(k % 3 == 0, F.col("c_name")).alias("name"))
    summary = t.customer.where(k % 2 == 0).select(k.alias("student_id"), F.concat(F.lit("S"), k.cast("string")).alias("name"))
    return A.coalesce_from_summary(students, summary, ["name"])


@query(
    "J17_policy_violations",
    f"""WITH s AS (SELECT *, CASE student_id % 4 WHEN 0 THEN 'ALLOCATED' WHEN 1 THEN 'RULE_EXCLUDED' ELSE 'NO_CAPACITY' END AS final_status FROM students),
      c AS (SELECT {K}, max(remaining_capacity) AS max_capacity FROM mentors GROUP BY ALL)
      SELECT student_id, final_status, max_capacity FROM s JOIN c USING ({K}) WHERE max_capacity > 0 AND final_status NOT IN ('ALLOCATED', 'RULE_EXCLUDED')""",
    ("students", "mentors"),
)
def policy_violations(t):
    k = F.col("student_id") % 4
    s = t.students.withColumn("final_status", F.when(k == 0, F.lit("ALLOCATED")).when(k == 1, F.lit("RULE_EXCLUDED")).otherwise(F.lit("NO_CAPACITY")))
    return A.policy_violations(s, t.mentors).select("student_id", "final_status", "max_capacity")


@query(
    "J18_preferred_managers",
    "SELECT mentor_id, pool_order, (center_code = 1 AND manager IN ('NATION_1', 'NATION_4')) OR (center_code = 2 AND manager = 'NATION_8') AS preferred FROM mentors",
    ("mentors",),
)
def preferred_managers(t):
    n = F.col("n_name")
    conf = t.nation.select(F.when(n.isin("NATION_1", "NATION_4"), 1).when(n == "NATION_8", 2).when(n == "NATION_9", 7).alias("center_code"), n.alias("manager")).where(F.col("center_code").isNotNull())
    return R.preferred_managers(t.mentors, conf)[0].select("mentor_id", "pool_order", "preferred")


@query(
    "J18_centers_without_manager",
    "SELECT CAST(c AS BIGINT) AS center_code FROM (VALUES (1, 'NATION_1'), (2, 'NATION_8'), (7, 'NATION_9')) v(c, n) WHERE NOT EXISTS (SELECT 1 FROM mentors m WHERE m.center_code = c AND m.manager = n)",
    ("mentors",),
)
def centers_without_manager(t):
    n = F.col("n_name")
    conf = t.nation.select(F.when(n == "NATION_1", 1).when(n == "NATION_8", 2).when(n == "NATION_9", 7).alias("center_code"), n.alias("manager")).where(F.col("center_code").isNotNull())
    return R.preferred_managers(t.mentors, conf)[1]


def _manager_layers(t):
    """Policy, stored and run rows out of the nations: which manager serves which center."""
    k, n = F.col("n_nationkey"), F.col("n_name")
    rows = lambda cond, center: t.nation.where(cond).select(center.cast("bigint").alias("center_code"), n.alias("manager"), k.cast("int").alias("position"))
    return [rows(k < 9, k % 3), rows((k >= 9) & (k < 12), F.lit(1)), rows((k >= 12) & (k < 15), F.when(k == 14, F.lit(7)).otherwise(F.lit(2)))]


LAYERS = """l AS (SELECT n_nationkey % 3 AS c, n_name AS m, 0 AS layer FROM nation WHERE n_nationkey < 9 UNION ALL SELECT 1, n_name, 1 FROM nation WHERE n_nationkey BETWEEN 9 AND 11
  UNION ALL SELECT CASE WHEN n_nationkey = 14 THEN 7 ELSE 2 END, n_name, 2 FROM nation WHERE n_nationkey BETWEEN 12 AND 14), r AS (SELECT * FROM l QUALIFY layer = max(layer) OVER (PARTITION BY c))"""


@query(
    "J18_managers_by_settings",
    f"WITH {LAYERS} SELECT mentor_id, pool_order, EXISTS (SELECT 1 FROM r WHERE r.c = center_code AND r.m = manager) AS preferred FROM mentors",
    ("mentors",),
)
def managers_by_settings(t):
    from matchloom.operators import settings as S

    return R.preferred_managers(t.mentors, S.resolved_managers(_manager_layers(t)))[0].select("mentor_id", "pool_order", "preferred")


@query(
    "J18_setting_warnings",
    f"""WITH {LAYERS} SELECT DISTINCT CAST(c AS BIGINT) AS center_code, 'MANAGER_OF_UNDEFINED_CENTER' AS warning FROM r WHERE c NOT IN (SELECT n_nationkey % 3 FROM nation)
      UNION ALL SELECT CAST(9 AS BIGINT), 'PRIORITY_OF_UNDEFINED_CENTER' UNION ALL SELECT CAST(0 AS BIGINT), 'CENTER_0_WITHOUT_PRIORITY'""",
)
def setting_warnings(t):
    from matchloom.operators import settings as S

    order = t.spark.createDataFrame([(1, 0), (9, 1)], "center_code bigint, position int")
    priority = S.resolved_priority([order], default_center=None)
    centers = t.nation.select((F.col("n_nationkey") % 3).alias("center_code"))
    return S.setting_warnings(S.resolved_managers(_manager_layers(t)), priority, centers)


J21 = f"""{BUILD}, mm AS (SELECT DISTINCT mentor_type, alias, CAST(school_code AS VARCHAR) AS school, gender_code, CAST(grad_status_code AS BIGINT) AS status, center_code, group_code FROM rows_all),
st AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(900 + c_custkey % 9300 AS VARCHAR) ELSE 'none' END AS alias_norm, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + 1 AS VARCHAR) ELSE '' END AS school_text,
  c_custkey % 2 AS gender_code, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 27 WHEN 2 THEN 3 ELSE 24 END END AS group_code, c_nationkey % 2 AS expected_center FROM customer),
nn AS (SELECT DISTINCT alias FROM mm WHERE mentor_type = 'NORMAL'),
cd AS (SELECT st.*, mm.gender_code AS mg, mm.status AS ms, mm.center_code AS mcn, mm.group_code AS mgr FROM st LEFT JOIN mm ON
  (mm.mentor_type = 'NORMAL' AND st.alias_norm = mm.alias) OR (mm.mentor_type = 'SCHOOL' AND st.alias_norm NOT IN (SELECT alias FROM nn) AND st.school_text <> '' AND mm.school = st.school_text)),
fl AS (SELECT row_id, any_value(school_text) AS school_text, any_value(group_code) AS group_code, count(mg) AS n, coalesce(bool_or(mg = gender_code), false) AS g, coalesce(bool_or(mg = gender_code AND ms = 1), false) AS s,
  coalesce(bool_or(mg = gender_code AND ms = 1 AND mcn = expected_center), false) AS c, coalesce(bool_or(mg = gender_code AND ms = 1 AND mcn = expected_center AND mgr = group_code), false) AS k FROM cd GROUP BY row_id),
rs AS (SELECT row_id, CASE WHEN n = 0 AND school_text = '' THEN 'no normal alias match' WHEN n = 0 THEN 'no school-code match' WHEN NOT g THEN 'gender mismatch' WHEN NOT s THEN 'status mismatch'
  WHEN NOT c THEN 'center mismatch (manager-based)' WHEN group_code IS NULL THEN 'no group code' WHEN NOT k THEN 'group_code mismatch' ELSE 'MATCHED' END AS reason FROM fl)"""


def _roster_check(t):
    k = F.col("c_custkey")
    g = F.when(k % 4 == 0, 1).when(k % 4 == 1, 27).when(k % 4 == 2, 3).otherwise(24).cast("bigint")
    students = t.customer.select(
        k.alias("row_id"), F.when(k % 3 == 0, (F.lit(900) + k % 9300).cast("string")).otherwise(F.lit("none")).alias("alias_norm"),
        F.when(k % 2 == 0, (F.col("c_nationkey") + 1).cast("string")).otherwise(F.lit("")).alias("school_text"),
        F.lit("NORMAL").alias("binding"), (k % 2).alias("gender_code"), F.lit(1).cast("bigint").alias("status_code"),
        (F.col("c_nationkey") % 2).cast("bigint").alias("expected_center"), F.when(k % 11 != 0, g).alias("group_code"),
    )
    return A.roster_validate(students, _built(t).matrix)


@query("J21_roster_validate", f"WITH {J21} SELECT row_id, reason FROM rs", VIEWS)
def roster_validate(t):
    return _roster_check(t).select("row_id", "reason")


@query("A13_reason_breakdown", f'WITH {J21} SELECT reason, count(*) AS "count" FROM rs GROUP BY reason', VIEWS)
def reason_breakdown(t):
    return _roster_check(t).groupBy("reason").agg(F.count(F.lit(1)).alias("count"))


PRIOR = """pr AS (SELECT row_id, lpad(national_id, CAST(greatest(10, length(national_id)) AS INTEGER), '0') AS nat, student_id AS counter FROM prior_roster WHERE regexp_matches(student_id, '^[0-9]{9}$')),
ow AS (SELECT counter, arg_min(nat, row_id) AS owner FROM pr GROUP BY counter), mp AS (SELECT pr.nat, arg_max(pr.counter, pr.row_id) AS counter FROM pr JOIN ow USING (counter) WHERE pr.nat = ow.owner GROUP BY pr.nat)"""


@query("J22_prior_counter_map", f"WITH {PRIOR} SELECT nat, counter FROM mp", ("prior_roster",))
def prior_counter_map(t):
    return R.prior_counter_map(t.prior_roster, "row_id")[0]


@query(
    "J22_prior_counter_conflicts",
    f"WITH {PRIOR} SELECT DISTINCT counter, owner, nat FROM pr JOIN ow USING (counter) WHERE nat <> owner",
    ("prior_roster",),
)
def prior_counter_conflicts(t):
    return R.prior_counter_map(t.prior_roster, "row_id")[1]


@query(
    "J23_global_prefilter",
    "SELECT mentor_id, pool_order FROM mentors WHERE group_code IN (SELECT group_code FROM students)",
    ("students", "mentors"),
)
def global_prefilter(t):
    return R.global_prefilter(t.mentors, t.students)[0].select("mentor_id", "pool_order")


J24 = f"""{CELLS}, {CENTER}, rr AS (SELECT *, CASE row_index % 5 WHEN 0 THEN group_spec WHEN 1 THEN '7' ELSE '' END AS legacy_group, CASE row_index % 6 WHEN 0 THEN '' WHEN 1 THEN '3' WHEN 2 THEN '9' ELSE '0' END AS finance_raw FROM report),
gg AS (SELECT rr.*, {ck.valid_codes('group_spec')} AS gl, {ck.valid_codes('legacy_group')} AS ll FROM rr)"""


def _key_derivation(t):
    n = F.col("row_index")
    report = t.report.withColumn("legacy_group", F.when(n % 5 == 0, F.col("group_spec")).when(n % 5 == 1, F.lit("7")).otherwise(F.lit("")))
    report = report.withColumn("finance_raw", F.when(n % 6 == 0, F.lit("")).when(n % 6 == 1, F.lit("3")).when(n % 6 == 2, F.lit("9")).otherwise(F.lit("0")))
    report = report.withColumn("status_text", F.lit("دانش آموز"))
    return A.mentor_key_issues(report, X.school_binding(t.report, t.schools), R.center_from_manager(t.report, "manager", t.manager_map))


@query(
    "J24_mentor_key_derivation",
    f"""WITH {J24} SELECT gg.row_index, gl[1] AS group_code, {ck.gender('gender_text')} AS gender_code, CAST(1 AS BIGINT) AS grad_status_code, mc.center AS center_code,
      CAST(CASE finance_raw WHEN '3' THEN 3 ELSE 0 END AS BIGINT) AS finance_code, coalesce(b.bound[1], 0) AS school_code FROM gg JOIN mc ON {ck.norm('gg.manager')} = mc.m LEFT JOIN bind b ON b.row_index = gg.row_index""",
    ("report", "schools", "manager_map"),
)
def mentor_key_derivation(t):
    return _key_derivation(t)[0].select("row_index", *KEYS)


@query(
    "J24_mentor_key_issues",
    f"""WITH {J24}, i AS (SELECT gg.row_index, unnest([CASE WHEN len(gl) = 0 THEN 'INVALID_GROUP_CODE' WHEN legacy_group <> '' AND (len(ll) = 0 OR ll <> gl) THEN 'LEGACY_GROUP_CONFLICT' END,
      CASE WHEN b.refs IS NOT NULL AND len(b.bound) = 0 THEN 'SCHOOL_NOT_FOUND' END, CASE WHEN mc.k IS NULL THEN 'CENTER_FALLBACK_WILDCARD' END, CASE WHEN finance_raw = '9' THEN 'FINANCE_UNKNOWN' END]) AS reason
      FROM gg JOIN mc ON {ck.norm('gg.manager')} = mc.m LEFT JOIN bind b ON b.row_index = gg.row_index) SELECT * FROM i WHERE reason IS NOT NULL""",
    ("report", "schools", "manager_map"),
)
def mentor_key_issues(t):
    return _key_derivation(t)[1].select("row_index", "reason")


@query(
    "J25_success_spine",
    """WITH ok AS (SELECT DISTINCT CAST(student_id AS VARCHAR) AS student_id FROM alloc_log WHERE allocation_status = 'success'),
      al AS (SELECT CAST(o_custkey AS VARCHAR) AS student_id, max(o_orderkey) AS allocation FROM orders GROUP BY 1)
      SELECT ok.student_id, al.allocation FROM ok JOIN (SELECT CAST(c_custkey AS VARCHAR) AS student_id FROM customer) USING (student_id) LEFT JOIN al USING (student_id)""",
    ("alloc_log",),
)
def success_spine(t):
    alloc = t.orders.groupBy(F.col("o_custkey").alias("student_id")).agg(F.max("o_orderkey").alias("allocation"))
    return A.success_spine(t.students, t.alloc_log, alloc)[0]


@query(
    "W4_first_last_wins",
    """SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id""",
)
def first_last_wins(t):
    ev = t.events.select("user_id", "ts", "event_id")
    a = NUM.first_row(ev, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("first_event"))
    b = NUM.last_row(ev, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_event"))
    return a.join(b, "user_id")


COUNTERS = f"""{PRIOR}, cur AS (SELECT CAST(substr(student_id, 3, 3) AS VARCHAR) AS mid, max(CAST(right(student_id, 4) AS BIGINT)) AS top FROM current_roster WHERE student_id LIKE '54%' GROUP BY 1),
rw AS (SELECT row_id, lpad(national_id, CAST(greatest(10, length(national_id)) AS INTEGER), '0') AS nat, gender FROM roster), pe AS (SELECT nat, arg_min(gender, row_id) AS g, min(row_id) AS first FROM rw GROUP BY nat),
nw AS (SELECT nat, g, row_number() OVER (PARTITION BY g ORDER BY {ck.natural('nat')}) AS n FROM pe WHERE nat NOT IN (SELECT nat FROM mp)),
mk AS (SELECT nat, n + coalesce(top, 0) AS seq, '54' || CASE WHEN g = 1 THEN '357' ELSE '373' END || lpad(CAST(n + coalesce(top, 0) AS VARCHAR), 4, '0') AS made FROM nw LEFT JOIN cur ON mid = CASE WHEN g = 1 THEN '357' ELSE '373' END),
asg AS (SELECT rw.row_id, rw.nat, CASE WHEN mp.counter IS NULL AND mk.seq > 9999 THEN NULL ELSE coalesce(mp.counter, mk.made) END AS student_id, mp.counter IS NOT NULL OR rw.row_id <> pe.first AS reused, pe.g, coalesce(mk.seq, 0) AS seq
  FROM rw JOIN pe USING (nat) LEFT JOIN mp USING (nat) LEFT JOIN mk USING (nat))"""
_ROSTERS = ("roster", "prior_roster", "current_roster")


def _assigned(t):
    """Rows past the 9,999 numbers of a gender stay, without an id, as the check says."""
    return R.assign_counters(t.roster, "row_id", t.prior_roster, t.current_roster, 1404, on_overflow="null")


@query("W5_assign_counters", f"WITH {COUNTERS} SELECT row_id, nat, student_id, reused FROM asg", _ROSTERS)
def assign_counters(t):
    return _assigned(t).select("row_id", "nat", "student_id", "reused")


@query(
    "A15_counter_summary",
    f"""WITH {COUNTERS}, held AS (SELECT student_id AS counter, lpad(national_id, 10, '0') AS nat, row_id FROM prior_roster WHERE regexp_matches(student_id, '^[0-9]{{9}}$')),
      own AS (SELECT counter, arg_min(nat, row_id) AS owner FROM held GROUP BY 1), clash AS (SELECT DISTINCT counter, nat FROM held JOIN own USING (counter) WHERE nat <> owner),
      c AS (SELECT count(*) FILTER (WHERE reused) AS reused_count, count(*) FILTER (WHERE NOT reused AND g = 1) AS new_male_count, count(*) FILTER (WHERE NOT reused AND g = 0) AS new_female_count FROM asg)
      SELECT c.*, coalesce((SELECT top FROM cur WHERE mid = '357'), 0) + new_male_count + 1 AS next_male_start, coalesce((SELECT top FROM cur WHERE mid = '373'), 0) + new_female_count + 1 AS next_female_start,
        (SELECT count(*) FROM clash) AS prior_conflict_counter_count, coalesce((SELECT string_agg(counter, ',' ORDER BY counter) FROM (SELECT DISTINCT counter FROM clash ORDER BY counter LIMIT 3)), '') AS prior_conflict_counter_samples FROM c""",
    _ROSTERS,
)
def counter_summary(t):
    return R.counter_summary(_assigned(t), t.current_roster, 1404, prior=t.prior_roster)


@query("W6_duplicate_ids", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t):
    return R.duplicate_ids(t.orders, "o_custkey")


@query(
    "W6_resolve_duplicates",
    """WITH d AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
      n AS (SELECT o_orderkey, 5000000 + row_number() OVER (ORDER BY o_orderkey) AS fresh FROM d WHERE rn > 1)
      SELECT d.o_orderkey, coalesce(n.fresh, d.o_custkey) AS new_id FROM d LEFT JOIN n USING (o_orderkey)""",
)
def resolve_duplicates(t):
    df = t.orders.select("o_orderkey", "o_custkey")
    return R.resolve_duplicates(df, "o_custkey", "o_orderkey", "assign-new", 5000000).select("o_orderkey", "new_id")


@query(
    "W9_academic_year",
    """WITH y AS (SELECT row_id, CAST(left(student_id, 2) AS BIGINT) + 1350 AS y FROM prior_roster WHERE regexp_matches(student_id, '^[0-9]{9}$'))
      SELECT arg_min(y, row_id) AS first_year, CASE WHEN min(y) = max(y) THEN min(y) END AS strict_year FROM y""",
    ("prior_roster",),
)
def academic_year(t):
    return R.academic_year(t.prior_roster, "row_id")
