"""The pair queries return every link, and ranks and flags hold over stretches of places."""

import duckdb
import pytest

import __spark_entry__ as entry
from matchloom.operators import candidates as C
from matchloom.operators import matching as M
from matchloom.plans.fixtures import with_views
from test_matching import eligible, small

SF = "/root/testdata/sf0.001"
BASE = "s.group_code = m.group_code AND s.gender_code = m.gender_code AND s.grad_status_code = m.grad_status_code"
CENTER = "m.center_code IN (0, s.center_code)"
FLAGGED = "CASE WHEN s.school_code = 0 THEN NOT m.has_school_constraint WHEN m.has_school_constraint THEN m.school_code = s.school_code ELSE m.school_code IN (0, s.school_code) END"


def links(rule):
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    classes = "(SELECT DISTINCT * EXCLUDE (student_id) FROM students)"
    return con.execute(with_views(f"SELECT count(*) FROM {classes} s JOIN mentors m ON {BASE} AND {rule}", ("students", "mentors"))).fetchone()[0]


def whole(spark, name, columns, rule, times=1):
    df = entry.queries()[name](spark, SF)
    assert set(columns) <= set(df.columns)
    assert df.count() == times * links(rule) > 0


def test_class_pairs_are_whole(spark):
    whole(spark, "J2_class_pairs", ["class_key", "mentor_id", "pool_order"], f"{CENTER} AND {FLAGGED}")


def test_variant_pairs_are_whole(spark):
    rule = f"{CENTER} AND (s.school_code = 0 OR m.school_code IN (0, s.school_code))"
    whole(spark, "J3_bucket_variant_join", ["class_key", "mentor_id", "pool_order"], rule)


def test_strict_pairs_are_whole(spark):
    rule = f"s.finance_code = m.finance_code AND {CENTER} AND m.school_code IN (0, s.school_code)"
    whole(spark, "J4_matrix_core", ["class_key", "mentor_id", "blocking_codes", "trace"], rule)


def test_ranked_pairs_are_whole(spark):
    whole(spark, "W1_rank_candidates", ["class_key", "mentor_id", "pool_order", "rank"], f"{CENTER} AND {FLAGGED}")


def brute_places(sdf, pool, place):
    out = {}
    for r in sdf.withColumn("class_key", M.class_key()).collect():
        out[r["class_key"]] = sorted(place[m[1]] for m in pool if eligible(tuple(r)[:7], m))
    return {k: v for k, v in out.items() if v}


def test_ranks_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH_BITS", 2)
    _, pool, sdf, pdf = small(spark, 13)
    c = C.candidates(sdf, C.placed_pool(pdf))
    place = {r[0]: r[1] for r in c.members.select("pool_order", "place").distinct().collect()}
    got = {(r["class_key"], r["rank"]): r["place"] for r in C.ranked_pairs(c).collect()}
    assert got == {(k, i + 1): p for k, v in brute_places(sdf, pool, place).items() for i, p in enumerate(v)} and got


def test_fair_pairs_are_whole(spark):
    whole(spark, "W3_fairness_order", ["strategy", "class_key", "mentor_id", "pool_order", "rank", "order_changed"], f"{CENTER} AND {FLAGGED}", times=2)


def test_order_flags_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH_BITS", 2)
    _, pool, sdf, pdf = small(spark, 14)
    plain = {r["pool_order"]: r["place"] for r in C.placed_pool(pdf).collect()}
    fair = {r["pool_order"]: r["place"] for r in C.placed_pool(pdf, "round_robin").collect()}
    back = {p: o for o, p in fair.items()}
    want = {}
    for key, places in brute_places(sdf, pool, fair).items():
        order = [plain[back[p]] for p in places]
        want[key] = order != sorted(order)
    got = {r["class_key"]: r["order_changed"] for r in C.fair_pairs(sdf, pdf, ["round_robin"]).collect()}
    assert got == want and set(want.values()) == {True, False}
