"""Layered settings, export profiles and the thresholds of the matrix build."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from matchloom.config import Policy
from matchloom.operators import matrix as X
from matchloom.operators import report as P
from matchloom.operators import settings as S

PROFILE = "header string, value_map string, order string, source string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), "center_code bigint, manager string, position int")


def test_the_strongest_layer_replaces_a_center(spark):
    policy = rows(spark, (1, "a", 0), (2, "b", 0), (0, None, 0))
    stored = rows(spark, (2, "c", 0), (2, " d ", 1), (2, "c", 2), (3, "  ", 0))
    run = rows(spark, (1, "e", 0), (None, "f", 0))
    got = {(r["center_code"], r["manager"], r["position"], r["layer"]) for r in S.resolved_managers([policy, stored, run]).collect()}
    assert got == {(1, "e", 0, 2), (2, "c", 0, 1), (2, "d", 1, 1)}
    centers = spark.createDataFrame([(0,), (1,), (3,)], "center_code bigint")
    with pytest.raises(ValueError, match="3"):
        S.resolved_managers([policy, stored, run], centers, strict=True)
    assert S.resolved_managers([policy], centers.where("center_code < 2"), strict=True).count() == 2
    assert {r["manager"] for r in S.resolved_managers([S.policy_managers(spark, Policy())]).collect()} == {"شهدخت کشاورز", "آیناز هوشمند"}


def test_priority_keeps_first_places(spark):
    order = lambda *codes: spark.createDataFrame(list(zip(codes, range(len(codes)), strict=True)), "center_code bigint, position int")
    take = lambda df: [r[0] for r in df.orderBy("priority").collect()]
    assert take(S.resolved_priority([order(1, 2, 0), order(2, 5, 2)])) == [2, 5, 1, 0]
    assert take(S.resolved_priority([order(1, 2)], default_center=0)) == [1, 2, 0]
    assert take(S.resolved_priority([order(1)], default_center=None)) == [1]


def test_setting_warnings(spark):
    managers, centers = rows(spark, (1, "a", 0), (8, "b", 0)), spark.createDataFrame([(0,), (1,)], "center_code bigint")
    priority = spark.createDataFrame([(1, 0), (9, 1)], "center_code bigint, priority int")
    got = {tuple(r) for r in S.setting_warnings(managers, priority, centers).collect()}
    assert got == {(8, "MANAGER_OF_UNDEFINED_CENTER"), (9, "PRIORITY_OF_UNDEFINED_CENTER"), (0, "CENTER_0_WITHOUT_PRIORITY")}


@pytest.mark.parametrize("bad,message", [
    ([("a", "x (y)", "1", "")], "annotated"), ([("a", "اگر y", "1", "")], "annotated"), ([("a", None, "1", P.PROFILE_ALLOCATION)], "allocation"),
    ([("a", None, "1", ""), ("b", None, "1.0", "")], "repeat"), ([(None, None, "4", "")], "differ"), ([("a", None, "4", P.PROFILE_REMOVED)], "differ"),
    ([("a", "no", "1", P.PROFILE_STUDENT)], "not known"),
])
def test_profiles_are_checked(spark, bad, message):
    with pytest.raises(ValueError, match=message):
        P.compile_profile(spark.createDataFrame(bad, PROFILE), {"name": "name"})


def test_profile_export(spark):
    profile = spark.createDataFrame([("b", P.PROFILE_EMPTY, "2", P.PROFILE_STUDENT), ("a", "name", "1", P.PROFILE_STUDENT), ("c", "", "3", "x"), ("d", "gone", "4", P.PROFILE_STUDENT), ("e", None, "soon", "")], PROFILE)
    columns = P.compile_profile(profile)
    out, issues = P.export_by_profile(spark.createDataFrame([(1,), (2,)], "student_id int"), spark.createDataFrame([(1, "n")], "student_id int, name string"), columns)
    assert out.columns == ["a", "b", "c", "d"] and sorted(map(tuple, out.collect())) == [("", "", "c", ""), ("n", "", "c", "")]
    assert issues.first()["issue"] == "COLUMN_NOT_FOUND"
    assert P.compile_profile(spark.createDataFrame([], PROFILE)) == []


@pytest.fixture(scope="module")
def sources(spark):
    from matchloom.plans.fixtures import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    return t.report, t.schools, t.manager_map


def test_school_gate_on_both_sides(sources):
    report, schools, managers = sources
    sources = report.withColumn("school_code_1", F.when(F.col("row_index") % 2 == 0, F.lit("9999")).otherwise(F.lit("1"))), schools, managers
    ratio = X.school_figures(X.school_cells(*sources[:2])).first()["ratio"]
    assert 0 < ratio < 1
    over = Policy(school_mismatch_ratio=ratio - 0.001, failing_gates=("school_lookup",))
    with pytest.raises(X.ThresholdExceeded) as found:
        X.build_matrix(*sources, over, enforce=True)
    assert found.value.figures["gate"] == "school_lookup"
    under = replace(over, school_mismatch_ratio=ratio + 0.001)
    assert X.build_matrix(*sources, under, enforce=True).matrix.count() > 0
    warned = {r["gate"]: r["status"] for r in X.build_matrix(*sources, replace(over, failing_gates=())).gates.collect()}
    assert warned["school_lookup"] == "warning"


def test_dedupe_gate_on_both_sides(sources):
    report, schools, managers = sources
    # A mentor's group cell names a group twice through its range: the exploded rows repeat once renamed alike.
    built = X.build_matrix(report, schools, managers, Policy(school_mismatch_ratio=1.0))
    figures = built.dedupe.first()
    assert figures["rows_before"] >= figures["rows_after"] == built.rows.count()
    tight = Policy(school_mismatch_ratio=1.0, dedup_removed_ratio=figures["removed_ratio"] - 0.001, coverage_threshold=0.0)
    with pytest.raises(X.ThresholdExceeded) as found:
        X.build_matrix(report, schools, managers, tight, enforce=True)
    assert found.value.figures["gate"] == "dedupe"
    assert X.build_matrix(report, schools, managers, replace(tight, dedup_removed_ratio=figures["removed_ratio"]), enforce=True)


def test_copies_are_counted_in_the_deduplication(spark, sources):
    rows = X.build_matrix(*sources).rows.drop("copies")
    again = rows.withColumn("row_index", F.col("row_index") + 1000)
    kept, stats = X.matrix_dedupe(rows.unionByName(again), Policy(dedup_removed_ratio=0.5))
    n = rows.count()
    assert tuple(stats.first()) == (2 * n, n, n, 0.5, False)
    assert {r["copies"] for r in kept.select("copies").distinct().collect()} == {2} and kept.agg(F.max("row_index")).first()[0] < 1000
    assert X.dedupe_figures(kept, Policy(dedup_removed_ratio=0.49)).first()["threshold_exceeded"]
    assert tuple(X.matrix_dedupe(rows.where("false"))[1].first()) == (0, 0, 0, 0.0, False)


def test_governance_trace_keeps_first_rows(spark):
    from matchloom.operators.trace import governance_trace

    pool = spark.createDataFrame(
        [(1, 1, 10, "مدیر", "ACTIVE", 5), (1, 1, 11, "مدیر", "FROZEN", 0), (2, 1, 12, "مدیر", "FROZEN", 5), (3, 1, 13, "بسته", "ACTIVE", 5), (4, 1, 14, "مدیر", "ACTIVE", 0)],
        "mentor_id long, group_code long, pool_order long, manager string, st string, remaining_capacity long",
    )
    off = spark.createDataFrame([("بسته",)], "manager string")
    got = [(r["stage"], r["rows"], r["removed"]) for r in governance_trace(pool, "pool_order", off, "st", keys=("group_code",)).orderBy("stage_no").collect()]
    assert got == [("pool", 5, 0), ("deduplicate", 4, 1), ("manager_filter", 3, 1), ("status_filter", 2, 1), ("capacity_filter", 1, 1)]
