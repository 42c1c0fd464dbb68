"""Source views over the benchmark tables.

Each view is one SELECT that both Spark SQL and an ANSI engine accept unchanged, so a
query and its check start from the same rows (``SPARK_VIEWS`` restates one of them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import group_dim_sql

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _students(group_expr: str) -> str:
    return f"""
SELECT *, CAST(CASE WHEN group_code IN (1,3) AND student_id % 5 = 0 THEN 0 ELSE 1 END AS BIGINT)
          AS grad_status_code
FROM (SELECT c_custkey AS student_id,
  CAST({group_expr} AS BIGINT) AS group_code,
  CAST(floor(c_custkey/4.0) AS BIGINT) % 2 AS gender_code,
  CAST(c_nationkey % 3 AS BIGINT) AS center_code,
  CAST(CASE c_custkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS BIGINT) AS finance_code,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN c_nationkey + 1 ELSE 0 END AS BIGINT) AS school_code
  FROM {{customer}}) t"""


_GROUP = "CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 27 ELSE 24 END"

# name -> (tables and views it reads, SELECT)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "group_dim": ((), group_dim_sql()),
    "students": (("customer",), _students(_GROUP)),
    "students_gap": (
        ("customer",),
        _students(f"CASE WHEN c_custkey % 50 = 0 THEN 89 ELSE ({_GROUP}) END"),
    ),
    "mentors": (
        ("supplier",),
        """
SELECT s_suppkey AS mentor_id, CAST(g.group_code AS BIGINT) AS group_code,
  CAST(floor(s_suppkey/2.0) AS BIGINT) % 2 AS gender_code,
  CAST(st.grad_status_code AS BIGINT) AS grad_status_code,
  CAST(s_nationkey % 3 AS BIGINT) AS center_code, CAST(0 AS BIGINT) AS finance_code,
  CAST(CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE 0 END AS BIGINT) AS school_code,
  s_suppkey % 10 = 0 AS has_school_constraint,
  1 + s_suppkey % 20 AS remaining_capacity,
  s_suppkey % 3 AS allocations_new,
  concat('NATION_', CAST(s_nationkey AS STRING)) AS manager,
  s_suppkey * 100 + g.group_code * 2 + st.grad_status_code AS pool_order
FROM {supplier}
CROSS JOIN (SELECT 1 AS group_code UNION ALL SELECT 3 UNION ALL SELECT 27
            UNION ALL SELECT 24) g
CROSS JOIN (SELECT 0 AS grad_status_code UNION ALL SELECT 1) st
WHERE (s_suppkey % 2 = 0 AND g.group_code IN (1,27)
       OR s_suppkey % 2 = 1 AND g.group_code IN (3,24))
  AND (st.grad_status_code = 1 OR g.group_code IN (1,3) AND s_suppkey % 10 <> 0)""",
    ),
    # Mentor report rows in the shape of the raw source.
    "report": (
        ("supplier",),
        """
SELECT s_suppkey + 1 AS row_index,
  concat('پشتيبان ', CAST(s_suppkey AS STRING)) AS mentor_name,
  concat('NATION_', CAST(s_nationkey AS STRING)) AS manager,
  CASE WHEN s_suppkey % 37 = 5 THEN '' ELSE concat('0', CAST(s_suppkey AS STRING)) END AS mentor_id,
  CASE s_suppkey % 6 WHEN 0 THEN '1,27' WHEN 1 THEN '24:27' WHEN 2 THEN '5 3،1'
    WHEN 3 THEN '۳-۱' WHEN 4 THEN '99,7' ELSE '2' END AS group_spec,
  CASE s_suppkey % 3 WHEN 0 THEN 'دختر' WHEN 1 THEN 'پسر' ELSE 'مذکر' END AS gender_text,
  CASE WHEN s_suppkey % 8 = 7 THEN 'خیر' ELSE 'بلی' END AS can_allocate,
  CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE CAST(900 + s_suppkey % 9300 AS STRING) END AS postal_code,
  CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE CAST(s_suppkey % 10 AS STRING) END AS covered_now,
  CASE WHEN s_suppkey % 13 = 6 THEN '-' ELSE CAST(4 + s_suppkey % 16 AS STRING) END AS special_limit,
  CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_nationkey + 1 AS STRING)
       WHEN s_suppkey % 5 = 1 THEN '0' ELSE '' END AS school_code_1,
  CASE WHEN s_suppkey % 10 = 0 THEN concat('NATION_', CAST((s_nationkey + 3) % 30 AS STRING))
       WHEN s_suppkey % 10 = 3 THEN '-' ELSE NULL END AS school_name_2,
  CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '0' END AS school_count,
  s_acctbal AS balance
FROM {supplier}""",
    ),
    "schools": (
        ("nation",),
        "SELECT CAST(n_nationkey + 1 AS BIGINT) AS school_code, n_name AS school_name FROM {nation}",
    ),
    # Manager name -> center; NATION_1 is contained in NATION_12.
    "manager_map": (
        ("nation",),
        """SELECT n_name AS manager_key, CAST(n_nationkey % 3 AS BIGINT) AS center_code FROM {nation}
WHERE n_nationkey IN (1, 2, 12, 20, 21)""",
    ),
    # Messy cells derived from keys: foreign digits, separators, blanks, noise.
    "messy": (
        ("customer",),
        """
SELECT c_custkey AS row_id,
  CASE c_custkey % 9
    WHEN 0 THEN translate(CAST(c_custkey AS STRING), '0123456789', '۰۱۲۳۴۵۶۷۸۹')
    WHEN 1 THEN concat(' ', translate(CAST(c_custkey AS STRING), '0123456789', '٠١٢٣٤٥٦٧٨٩'), '٫50')
    WHEN 2 THEN concat('-00', CAST(c_custkey AS STRING))
    WHEN 3 THEN concat(CAST(c_custkey AS STRING), '.0')
    WHEN 4 THEN concat('1٬', CAST(c_custkey AS STRING), ',0_0')
    WHEN 5 THEN ''
    WHEN 6 THEN NULL
    WHEN 7 THEN concat('EMP-', CAST(c_custkey % 100 AS STRING))
    ELSE CAST(c_custkey AS STRING) END AS cell,
  CASE c_custkey % 13
    WHEN 0 THEN 'پسر' WHEN 1 THEN 'دختر' WHEN 2 THEN ' Male ' WHEN 3 THEN 'girl' WHEN 4 THEN '۰'
    WHEN 5 THEN '1.0' WHEN 6 THEN 'آقای مذكر' WHEN 7 THEN 'مونث است' WHEN 8 THEN NULL WHEN 9 THEN 'زن'
    WHEN 10 THEN '١' WHEN 11 THEN 'خانم' ELSE 'x' END AS gender_cell,
  CASE c_custkey % 8
    WHEN 0 THEN 'دانش‌آموز' WHEN 1 THEN 'فارغ التحصيل' WHEN 2 THEN '0' WHEN 3 THEN 'Student'
    WHEN 4 THEN 'grad' WHEN 5 THEN NULL WHEN 6 THEN 'فارغ‌التحصیل' ELSE '?' END AS status_cell,
  CASE c_custkey % 7
    WHEN 0 THEN '1,3 24-27' WHEN 1 THEN '27:24' WHEN 2 THEN '۵،۷' WHEN 3 THEN 'کد 33'
    WHEN 4 THEN '2, 99' WHEN 5 THEN '' ELSE '0 8 x' END AS group_cell,
  CASE c_custkey % 6
    WHEN 0 THEN concat('0912', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'))
    WHEN 1 THEN concat('912-', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'))
    WHEN 2 THEN concat('+98912', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'))
    WHEN 3 THEN NULL
    WHEN 4 THEN translate(concat('09', lpad(CAST(c_custkey AS STRING), 9, '0')), '0123456789', '۰۱۲۳۴۵۶۷۸۹')
    ELSE concat('3', CAST(c_custkey AS STRING)) END AS phone_1,
  CASE c_custkey % 4
    WHEN 0 THEN concat('0912', lpad(CAST(c_custkey % 10000000 AS STRING), 7, '0'))
    WHEN 1 THEN NULL
    WHEN 2 THEN '00000000000'
    ELSE concat('5', CAST(c_custkey AS STRING), '.0') END AS phone_2,
  CASE c_custkey % 10
    WHEN 0 THEN concat('13', CAST(70 + c_custkey % 29 AS STRING), '/12/30')
    WHEN 1 THEN '1380/07/31' WHEN 2 THEN '۱۳۷۵/۰۵/۳۱' WHEN 3 THEN '' WHEN 4 THEN NULL
    WHEN 5 THEN '1380-13-01' WHEN 6 THEN '80/1/1'
    ELSE concat('13', CAST(60 + c_custkey % 39 AS STRING), '-', CAST(1 + c_custkey % 12 AS STRING), '-',
         CAST(1 + c_custkey % 30 AS STRING)) END AS birth_cell,
  CASE c_custkey % 5 WHEN 0 THEN '۳' WHEN 1 THEN '1' WHEN 2 THEN NULL WHEN 3 THEN 'x' ELSE '0' END
    AS registration_cell,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 4 AS STRING) ELSE NULL END AS finance_cell,
  CASE c_custkey % 6 WHEN 0 THEN '35-81' WHEN 1 THEN '' WHEN 2 THEN '۱۲' WHEN 3 THEN '-5'
    WHEN 4 THEN 'na' ELSE CAST(c_nationkey AS STRING) END AS school_cell,
  CASE c_custkey % 5 WHEN 0 THEN 'شهدخت كشاورز' WHEN 1 THEN '2' WHEN 2 THEN ' ' WHEN 3 THEN '-1'
    ELSE 'abc' END AS center_cell,
  CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN 'مدرسه‌ای' WHEN 2 THEN '۱' WHEN 3 THEN 'no'
    WHEN 4 THEN NULL ELSE '1.0' END AS flag_cell,
  CASE c_custkey % 4 WHEN 0 THEN ' الف،ب |الف' WHEN 1 THEN '۰,0.0,ج' WHEN 2 THEN 'كتاب؛گروه ١' ELSE 'nan' END
    AS list_cell
FROM {customer}""",
    ),
    # Earlier allocations, later rows win.
    "history": (
        ("orders", "supplier"),
        """
SELECT lpad(CAST(o_custkey AS STRING), 10, '0') AS national_code, o_custkey AS student_id,
  o_orderkey % (SELECT count(*) FROM {supplier}) AS mentor_id, o_orderkey % 3 AS center_code, o_orderdate, o_orderkey
FROM {orders}""",
    ),
    # Allocation log with an outcome per attempt.
    "alloc_log": (
        ("orders", "supplier"),
        """
SELECT o_orderkey AS log_id, o_custkey AS student_id,
  o_orderkey % (SELECT count(*) FROM {supplier}) AS mentor_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' ELSE 'failed' END AS allocation_status,
  CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 'CAPACITY_FULL' ELSE 'ELIGIBILITY_NO_MATCH' END
    AS error_type,
  CAST(floor(o_totalprice) AS BIGINT) % 7 AS capacity_before,
  CAST(floor(o_totalprice) AS BIGINT) % 7 - CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 1 END AS capacity_after,
  CAST(o_orderkey % 4 AS BIGINT) AS candidate_count
FROM {orders}""",
    ),
    "roster": (
        ("customer",),
        """
SELECT c_custkey AS row_id, CAST((c_custkey - c_custkey % 11 % 2) * 7919 AS STRING) AS national_id,
  c_custkey % 2 AS gender
FROM {customer}""",
    ),
    "prior_roster": (
        ("customer",),
        """
SELECT c_custkey AS row_id, CAST(c_custkey * 7919 AS STRING) AS national_id,
  CASE WHEN c_custkey % 12 = 0 THEN 'bad'
    ELSE concat('53', CASE WHEN c_custkey % 2 = 1 THEN '357' ELSE '373' END,
         lpad(CAST((c_custkey - CASE WHEN c_custkey % 30 = 0 THEN 10 ELSE 0 END) % 10000 AS STRING), 4, '0'))
    END AS student_id
FROM {customer} WHERE c_custkey % 5 = 0""",
    ),
    "current_roster": (
        ("supplier",),
        """
SELECT s_suppkey AS row_id,
  concat('54', CASE WHEN s_suppkey % 2 = 1 THEN '357' ELSE '373' END,
     lpad(CAST(s_suppkey % 300 AS STRING), 4, '0')) AS student_id
FROM {supplier}""",
    ),
    # Form entries in arrival order.
    "entries": (
        ("events",),
        """
SELECT event_id, CASE WHEN event_id % 40 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS entry_id,
  event_type AS form_id, ts AS received_at, value, props
FROM {events}""",
    ),
}


def _mentors(supplier: DataFrame) -> DataFrame:
    """The ``mentors`` view with explodes in place of its cross joins: one pass, no join."""
    k = F.col("s_suppkey")
    long = lambda *v: F.array(*[F.lit(x).cast("bigint") for x in v])
    rows = supplier.withColumn("group_code", F.explode(F.when(k % 2 == 0, long(1, 27)).otherwise(long(3, 24))))
    both = F.col("group_code").isin(1, 3) & (k % 10 != 0)
    rows = rows.withColumn("grad_status_code", F.explode(F.when(both, long(0, 1)).otherwise(long(1))))
    nation = F.col("s_nationkey").cast("bigint")
    return rows.select(
        k.alias("mentor_id"), "group_code", (F.floor(k / 2.0) % 2).alias("gender_code"), "grad_status_code",
        (nation % 3).alias("center_code"), F.lit(0).cast("bigint").alias("finance_code"),
        F.when(k % 10 == 0, nation + 1).otherwise(F.lit(0).cast("bigint")).alias("school_code"),
        (k % 10 == 0).alias("has_school_constraint"), (k % 20 + 1).alias("remaining_capacity"), (k % 3).alias("allocations_new"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("manager"),
        (k * 100 + F.col("group_code") * 2 + F.col("grad_status_code")).alias("pool_order"),
    )


# Views whose Spark side is better said with DataFrame functions.
SPARK_VIEWS = {"mentors": _mentors}


def view_text(name: str) -> str:
    """SELECT text of a view with plain table names."""
    deps, sql = VIEWS[name]
    return sql.format(**{d: d for d in deps}) if deps else sql


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Put the view definitions (and what they read) in front of a SELECT."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            if dep in VIEWS:
                visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        visit(name)
    body = sql.strip().rstrip(";")
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({view_text(n)})" for n in ordered)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Lazy access to the benchmark tables and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in SPARK_VIEWS:
                self._cache[name] = SPARK_VIEWS[name](*[getattr(self, d) for d in VIEWS[name][0]])
            elif name in VIEWS:
                deps, sql = VIEWS[name]
                args = {d: getattr(self, d) for d in deps}
                self._cache[name] = self.spark.sql(sql, **args) if deps else self.spark.sql(sql)
            elif name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._cache[name]
