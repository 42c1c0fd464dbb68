"""Sinks, caches and the entry stream."""

import os

import pytest
from pyspark.sql import functions as F

from matchloom.sources import tables as D
from matchloom.streaming import entries as E


def test_outputs_are_all_or_nothing(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "student_id")
    path = str(tmp_path / "out")
    prints = D.write_outputs({"a": df, "b": df}, path, {"student_id": "شناسه"}, "fa")
    assert spark.read.parquet(f"{path}/a").columns == ["شناسه"] and prints["a"] == prints["b"]
    assert not (tmp_path / "out.__staging").exists()
    with pytest.raises(ValueError):
        D.write_outputs({"a": df}, path, {}, "en")


def test_cache_refuses_duplicates_and_stale_versions(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "student_id int")
    with pytest.raises(ValueError):
        D.write_students_cache(df, str(tmp_path / "s"))
    D.write_cache(df.distinct(), str(tmp_path / "p"), ["student_id"], {"policy_version": "1"})
    assert D.load_cache(spark, str(tmp_path / "p"), {"policy_version": "1"}).count() == 1
    with pytest.raises(ValueError):
        D.load_cache(spark, str(tmp_path / "p"), {"policy_version": "2"})


def test_fingerprint_ignores_row_and_column_order(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("v"))
    a = D.content_fingerprint(df).first()
    assert a == D.content_fingerprint(df.select("v", "id").orderBy(F.rand(1))).first()
    assert a != D.content_fingerprint(df.where("id > 0")).first()


def test_large_snapshot_is_only_described(spark, tmp_path):
    info = D.archive_snapshot(spark.range(10), str(tmp_path / "x"), {"run_id": "r"}, limit=3).first()
    assert info["truncated"] and info["rows"] == 10 and not (tmp_path / "x" / "rows").exists()
    with pytest.raises(ValueError):
        D.stored_snapshot(spark, str(tmp_path / "x"))


def test_run_evidence_is_partitioned(spark, tmp_path):
    for run in ("a", "b"):
        D.append_run(str(tmp_path), run, {"qa": spark.range(3).withColumn("run", F.lit(run))})
    got = D.load_run_evidence(spark, str(tmp_path), "b", ["qa"])["qa"]
    assert {r["run"] for r in got.collect()} == {"b"}
    assert "PartitionFilters: [isnotnull(run_id" in got._jdf.queryExecution().executedPlan().toString()


def test_stream_keeps_the_last_arrival_over_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id string, form_id string, created_at timestamp, event_id bigint, fields map<string,string>"
    mk = lambda rows: spark.createDataFrame(rows, "id string, form_id string, t string, event_id bigint, fields map<string,string>").select(
        "id", "form_id", F.to_timestamp("t").alias("created_at"), "event_id", "fields"
    )
    target, offsets = str(tmp_path / "log"), str(tmp_path / "offsets")

    def run():
        E.upsert_latest(E.stream_entries(spark, src, schema, fields=["name"]), target, offsets).awaitTermination()

    mk([("1", "f", "2024-01-01 00:00:00", 1, {"name": "a"}), ("2", "f", "2024-01-01 00:00:00", 2, {"name": "b"}), (None, "f", "2024-01-01 00:00:00", 3, {})]).write.mode("append").parquet(src)
    run()
    mk([("1", "f", "2024-01-02 00:00:00", 4, {"name": "c"}), ("2", "f", "2023-01-01 00:00:00", 5, {"name": "old"})]).write.mode("append").parquet(src)
    run()
    run()  # nothing new: same state
    assert {(r["entry_id"], r["name"]) for r in E.read_latest(spark, target).collect()} == {("1", "c"), ("2", "b")}
    mk([("2", "f", "2024-02-01 00:00:00", 6, {"name": "d"}), ("3", "f", "2024-02-01 00:00:00", 7, {"name": "e"})]).write.mode("append").parquet(src)
    run()
    want = {("1", "c"), ("2", "d"), ("3", "e")}
    assert {(r["entry_id"], r["name"]) for r in E.read_latest(spark, target).collect()} == want
    for k in range(4):  # more batches than slots
        mk([("9", "f", f"2024-03-0{k + 1} 00:00:00", 10 + k, {"name": str(k)})]).write.mode("append").parquet(src)
        run()
        assert {(r["entry_id"], r["name"]) for r in E.read_latest(spark, target).collect()} == want | {("9", str(k))}
    assert len(os.listdir(f"{target}/state")) == 4


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """The last commit is taken back, as if the run had ended between the state and the commit."""
    src, target, offsets = (str(tmp_path / x) for x in ("in", "log", "offsets"))
    schema = "id string, created_at timestamp, event_id bigint"
    for k in range(3):
        spark.createDataFrame([("a", k), (f"x{k}", k)], "id string, event_id bigint").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")).write.mode("append").parquet(src)
        E.upsert_latest(E.stream_entries(spark, src, schema), target, offsets).awaitTermination()
    state = lambda: sorted((r["entry_id"], r["event_id"]) for r in E.read_latest(spark, target).collect())
    before = state()
    assert before == [("a", 2), ("x0", 0), ("x1", 1), ("x2", 2)]
    for name in ("2", ".2.crc"):
        if os.path.exists(f"{offsets}/commits/{name}"):
            os.remove(f"{offsets}/commits/{name}")
    E.upsert_latest(E.stream_entries(spark, src, schema), target, offsets).awaitTermination()
    assert state() == before


def test_a_second_run_has_the_later_files_only(spark, tmp_path):
    src, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    read = lambda: spark.readStream.schema("id long").parquet(src)
    spark.range(3).write.parquet(src)
    assert E.run_once(read(), out, offsets, "a").count() == 3
    assert E.run_once(read(), out, offsets, "b").count() == 0
    spark.range(10, 14).write.mode("append").parquet(src)
    assert sorted(r[0] for r in E.run_once(read(), out, offsets, "c").collect()) == [10, 11, 12, 13]


def test_normalised_rows(spark):
    rows = [(1, '{"a": {"b": [5, 6]}, "n": 7, "x": 1}'), (2, '{"a": {"b": 3}, "n": "seven"}'), (3, "{broken"), (4, None), (5, '{"n": null}'), (6, "[1]"), (7, '{"n": {"k": 1}, "z": 0, "y": 0}')]
    df = spark.createDataFrame(rows, "id long, payload string")
    got = {r["id"]: r for r in E.normalise_rows(df, {"second": ("$.a.b[1]", "bigint"), "n": ("$.n", "bigint")}).collect()}
    assert [(got[i]["second"], got[i]["n"]) for i in range(1, 8)] == [(6, 7), (None, None), (None, None), (None, None), (None, None), (None, None), (None, None)]
    assert [got[i]["malformed"] for i in range(1, 8)] == [False, False, True, False, False, True, False]
    assert [got[i]["wrong_types"] for i in (1, 2, 4, 5, 7)] == [[], ["n"], [], [], ["n"]]
    assert [got[i]["unknown_fields"] for i in (1, 2, 3, 7)] == [["x"], [], [], ["y", "z"]]
    assert E.normalise_rows(df.where("false"), {"n": ("$.n", "bigint")}).count() == 0


def test_privacy_hook(spark):
    df = spark.range(2).withColumn("phone", F.lit("x"))
    assert E.privacy_hook(df, lambda d: d.drop("phone")).columns == ["id"] and E.privacy_hook(df, None).columns == df.columns


def test_header_issues_count_conflicts(spark):
    from matchloom.operators.standardise import resolve_headers

    df = spark.createDataFrame([("1", "2"), ("3", None), (None, "4")], "a string, b string")
    out, issues = resolve_headers(df, {"a": "x", "b": "x"})
    assert [r[0] for r in out.collect()] == ["1", "3", "4"] and issues.first()["conflict_count"] == 1


def test_wrong_statuses_and_full_counters_fail(spark):
    from matchloom.operators.governance import effective_status
    from matchloom.operators.references import assign_counters

    mentors = spark.createDataFrame([(1, "active"), (2, "odd")], "mentor_id long, raw string")
    with pytest.raises(Exception, match="not allowed for mentor 2"):
        effective_status(mentors, status="raw").where("effective_status <> 'ACTIVE'").collect()
    assert len(effective_status(mentors, status="raw", on_invalid="ignore").collect()) == 2
    twice = spark.createDataFrame([(1, "active", 1), (1, "inactive", 2)], "mentor_id long, status string, n int")
    with pytest.raises(Exception, match="several values"):
        effective_status(mentors.where("mentor_id = 1"), twice).collect()
    got = effective_status(mentors.where("mentor_id = 1"), twice, order="n").first()
    assert got.effective_status == "INACTIVE"
    students = spark.createDataFrame([(1, "0012345678", 1), (2, "0012345679", 1)], "row_id long, national_id string, gender long")
    current = spark.createDataFrame([("543579998",)], "student_id string")
    with pytest.raises(Exception, match="above 9999"):
        assign_counters(students, "row_id", None, current, 1404).select("student_id").collect()
    lenient = assign_counters(students, "row_id", None, current, 1404, on_overflow="null").collect()
    assert {r.student_id for r in lenient} == {"543579999", None}
