"""Queries on tables larger than the given ones, next to their check SQL."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchloom.functions import keys
from oracle import compare


@pytest.fixture
def grown(spark, tmp_path):
    """Write tables under one folder and open them in DuckDB as well."""

    def make(**tables):
        con = duckdb.connect()
        for name, df in tables.items():
            df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        return str(tmp_path), con

    return make


def check(spark, made, name):
    folder, con = made
    ok, text = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, text


def test_counters_past_the_last_number(spark, grown):
    """45,000 customers need more than 9,999 new numbers a gender."""
    made = grown(customer=spark.range(45000).withColumnRenamed("id", "c_custkey"), supplier=spark.range(20).withColumnRenamed("id", "s_suppkey"))
    check(spark, made, "W5_assign_counters")
    rows = entry.queries()["W5_assign_counters"](spark, made[0])
    assert rows.count() == 45000 and rows.where(F.col("student_id").isNull()).count() > 0


def test_group_cells_are_read_once_for_all_codes(spark):
    """Naming the valid codes of a cell costs about as much as reading its tokens, not that much for each code."""
    cells = spark.range(20000, numPartitions=1).select(F.concat_ws(" ", F.lit("1,3 24-27"), F.col("id").cast("string")).alias("c")).localCheckpoint()

    def seconds(column):
        took = []
        for _ in range(3):
            start = time.time()
            cells.select(column).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        return min(took)

    assert seconds(keys.parse_group_codes("c")) < 5 * seconds(keys._bounds("c"))


def test_import_reads_the_report_once(spark):
    """No join of the report with itself, and the keys are worked out in one generator that filters stay above."""
    from matchloom.config import KEYS
    from matchloom.sources.imports import import_kind

    cells = [("1", "1", "1", "1", "1", "0", "0"), ("2", "?", "1", "1", "1", "0", "0"), (None, "3", "دختر", "0", "1", "0", "")]
    raw = spark.createDataFrame(cells, "row_id string, " + ", ".join(f"{k} string" for k in KEYS)).withColumn("student_id", F.col("row_id"))
    done = import_kind(raw, "students", {k: k for k in KEYS}, "row_id")
    plan = done.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate inline") == 1
    assert {(r["row_id"], r["group_code"], r["gender_code"]) for r in done.rows.collect()} == {("1", 1, 1), (None, 3, 0)}


def multiplies(df):
    """Whether rows are dealt into one a check."""
    return "Generate explode(concat(" in df._jdf.queryExecution().optimizedPlan().toString()


def test_audit_summary_does_not_multiply_allocations(spark):
    df = entry.queries()["Q14_alloc_join_02"](spark, "/root/testdata/sf0.001")
    assert not multiplies(df) and df.count() == 1


def test_audit_does_not_multiply_allocations(spark):
    df = entry.queries()["J12_join_key_audit_wildcard"](spark, "/root/testdata/sf0.001")
    assert not multiplies(df) and {r["valid"] for r in df.collect()} == {True, False}
