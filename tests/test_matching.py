"""Path parity and wildcard rules, against a plain nested loop over small tables."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy
from matchloom.operators import candidates as C
from matchloom.operators import matching as M
from matchloom.operators import numbering as N
from matchloom.operators import references as R

STUDENT = "student_id bigint, " + ", ".join(f"{k} bigint" for k in KEYS)
POOL = "mentor_id bigint, pool_order bigint, " + ", ".join(f"{k} bigint" for k in KEYS) + ", has_school_constraint boolean, remaining_capacity bigint, allocations_new bigint"


def small(spark, seed):
    rnd = random.Random(seed)
    pick = rnd.choice
    students = [
        (i, pick([1, 3, 27]), pick([0, 1]), pick([0, 1]), pick([0, 1, 2, None]), pick([0, 1, 2, 3]), pick([0, 0, 5, 6, None]))
        for i in range(60)
    ]
    pool = [
        (i // 2, i, pick([1, 3, 27]), pick([0, 1]), pick([0, 1]), pick([0, 1, 2, None]), pick([0, 1, 2, 3]), pick([0, 5, 6, None]), pick([True, False, None]), pick([0, 1, 2, 3]), pick([0, 1]))
        for i in range(40)
    ]
    return students, pool, spark.createDataFrame(students, STUDENT), spark.createDataFrame(pool, POOL)


def eligible(s, m):
    sg, sd, st, sc, sf, sh = s[1:7]
    mg, md, mt, mc, mf, mh, r = m[2:9]
    mh, r = mh or 0, bool(r)
    cluster = lambda f: 0 if f in (0, 1, 3) else f
    center = True if sc is None else (mc == 0 if sc == 0 else mc in (0, sc)) if mc is not None else False
    school = True if sh is None else (not r if sh == 0 else (mh == sh if r else mh in (0, sh)))
    return sg == mg and sd == md and st == mt and center and cluster(sf) == cluster(mf) and school


def expanded(c):
    """Links joined with members: only for small test tables."""
    return c.links.join(c.members, "bucket")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_match_nested_loop(spark, seed):
    students, pool, sdf, pdf = small(spark, seed)
    want = {(s[0], m[1]) for s in students for m in pool if eligible(s, m)}
    got = {(r[0], r[1]) for r in sdf.withColumn("class_key", M.class_key()).join(expanded(C.candidates(sdf, pdf)), "class_key").select("student_id", "pool_order").collect()}
    assert got == want and want
    stats = {r[0]: r[1] for r in M.candidate_stats(sdf, pdf).select("student_id", "candidates").collect()}
    assert stats == {s[0]: sum(1 for m in pool if eligible(s, m)) for s in students}


def test_no_pair_is_counted_twice(spark):
    _, _, sdf, pdf = small(spark, 7)
    pairs = expanded(C.candidates(sdf, pdf)).select("class_key", "pool_order")
    assert pairs.count() == pairs.distinct().count()


def test_funnel_never_grows(spark):
    from matchloom.config import STAGES

    _, _, sdf, pdf = small(spark, 4)
    for r in M.stage_funnel(sdf, pdf).collect():
        counts = [r["pool_rows"]] + [r[f"n_{s}"] for s in STAGES]
        assert counts == sorted(counts, reverse=True)


def test_pool_without_constraint_column(spark):
    sdf = spark.createDataFrame([(1, 1, 1, 1, 0, 0, 0)], STUDENT)
    _, pool, _, pdf = small(spark, 5)
    free = pdf.drop("has_school_constraint").withColumn("group_code", F.lit(1).cast("bigint")).withColumn("gender_code", F.lit(1).cast("bigint"))
    free = free.withColumn("grad_status_code", F.lit(1).cast("bigint")).withColumn("center_code", F.lit(0).cast("bigint")).withColumn("finance_code", F.lit(3).cast("bigint"))
    assert M.candidate_stats(sdf, free).first()["candidates"] == len(pool)


def test_ranking_order(spark):
    rows = [(2, 0, 5, 0), (10, 1, 5, 0), (1, 2, 5, 1), (3, 3, 9, 7)]
    df = spark.createDataFrame(rows, "mentor_id bigint, pool_order bigint, remaining_capacity bigint, allocations_new bigint")
    assert [r[0] for r in C.placed_pool(df).orderBy("place").select("mentor_id").collect()] == [3, 2, 10, 1]


@pytest.mark.parametrize("seed", [11, 12])
def test_ranks_without_pairs(spark, seed):
    students, pool, sdf, pdf = small(spark, seed)
    c = C.candidates(sdf, C.placed_pool(pdf))
    place = {r[0]: r[1] for r in c.members.select("pool_order", "place").distinct().collect()}
    brute = {}
    for r in sdf.withColumn("class_key", M.class_key()).collect():
        brute[r["class_key"]] = sorted(place[m[1]] for m in pool if eligible(tuple(r)[:7], m))
    tree = C.PlaceTree(c)
    wanted = c.classes.select("class_key", F.explode(F.sequence(F.lit(0), F.lit(45))).alias("rank"))
    got = {(r[0], r[1]): r[2] for r in tree.rows_at(wanted).collect()}
    assert got == {(k, i + 1): p for k, v in brute.items() for i, p in enumerate(v)}
    asked = c.classes.select("class_key").crossJoin(spark.range(len(pool)).withColumnRenamed("id", "place"))
    ranks = {(r[0], r[1]): r[2] for r in tree.ranks_of(asked).collect()}
    assert ranks == {(k, p): i + 1 for k, v in brute.items() for i, p in enumerate(v)}
    top = {(r["class_key"], r["rank"]): r["place"] for r in C.top_ranked(c, 3).collect()}
    assert top == {k: p for k, p in got.items() if k[1] <= 3}


def test_ranks_over_several_digits(spark):
    """600 rows of one bucket need three digits."""
    pool = spark.range(600).select(F.col("id").alias("mentor_id"), F.col("id").alias("pool_order"), *[F.lit(1).cast("bigint").alias(k) for k in KEYS[:3]],
        *[F.lit(0).cast("bigint").alias(k) for k in KEYS[3:]], F.lit(False).alias("has_school_constraint"), (F.col("id") % 7).alias("remaining_capacity"), (F.col("id") % 2).alias("allocations_new"))
    students = spark.createDataFrame([(1, 1, 1, 1, 0, 0, 0)], STUDENT)
    c = C.candidates(students, C.placed_pool(pool))
    tree = C.PlaceTree(c)
    assert tree.depth == 3
    wanted = c.classes.select("class_key", F.explode(F.array(*[F.lit(k) for k in (1, 255, 256, 257, 600, 601)])).alias("rank"))
    assert sorted((r[1], r[2]) for r in tree.rows_at(wanted).collect()) == [(1, 0), (255, 254), (256, 255), (257, 256), (600, 599)]


def test_strict_candidates_match_nested_loop(spark):
    students, pool, sdf, pdf = small(spark, 6)
    ok = lambda s, m: s[1:4] == m[2:5] and s[5] == m[6] and m[5] is not None and m[5] in (0, s[4]) and m[7] is not None and m[7] in (0, s[6]) and None not in (s[4], s[6])
    c = C.strict_candidates(sdf.where("center_code is not null and school_code is not null"), pdf)
    got = {(r[0], r[1]) for r in sdf.withColumn("class_key", M.class_key()).join(expanded(c), "class_key").select("student_id", "pool_order").collect()}
    assert got == {(s[0], m[1]) for s in students for m in pool if ok(s, m)} and got


@pytest.mark.parametrize("flag", [True, False])
def test_variants_find_what_the_rules_find(spark, flag):
    """With every row restricted by flag the variants apply, with free rows the general buckets do."""
    students, pool, sdf, pdf = small(spark, 8)
    pdf = pdf.withColumn("has_school_constraint", F.lit(True)) if flag else pdf.drop("has_school_constraint")
    rows = {(r["class_key"], r["pool_order"]) for r in expanded(C.variant_candidates(sdf, pdf)).collect()}
    legal = "school_code > 0 and center_code > 0 and finance_code is not null"
    keys = {r[0] for r in M.student_classes(sdf).where(legal).select("class_key").collect()}
    loose = pdf.drop("has_school_constraint")
    want = {(r["class_key"], r["pool_order"]) for r in expanded(C.candidates(sdf, loose)).collect()}
    assert {x for x in rows if x[0] in keys} == {x for x in want if x[0] in keys} and keys
    plain = {(r["class_key"], r["pool_order"]) for r in expanded(C.candidates(sdf, pdf)).collect()}
    assert {x for x in rows if x[0] not in keys} == {x for x in plain if x[0] not in keys}


def test_jitter_stays_inside_ties_and_unknown_names_fail(spark):
    rows = [(i, i, i % 3, i % 2, c) for i, c in enumerate(["540000001", "", None, " 12x", "abc", "540000001", "۱۲", "7", "8", "9"])]
    df = spark.createDataFrame(rows, "mentor_id bigint, pool_order bigint, remaining_capacity bigint, allocations_new bigint, counter string")
    fair = C.changed_blocks(df, "deterministic_jitter").orderBy("place").collect()
    blocks = [(-r["initial"], r["allocations_new"]) for r in fair]
    assert blocks == sorted(blocks)
    plain = {r["pool_order"]: r["place"] for r in C.placed_pool(df).collect()}
    changed = {(-r["initial"], r["allocations_new"]) for r in fair if plain[r["pool_order"]] != r["place"]}
    assert {b for b, r in zip(blocks, fair, strict=True) if r["block_changed"]} == changed
    with pytest.raises(ValueError, match="nonsense"):
        C.placed_pool(df, "nonsense")


def test_numbering_survives_a_hot_group(spark):
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("g"))
    out = N.number_rows(df, [F.col("id")], [("__a", F.floor(F.col("id") / 5000)), ("__b", F.floor(F.col("id") / 100))], by=["g"], name="n")
    hot = [r[0] for r in out.where("g = 'hot'").orderBy("id").select("n").collect()]
    assert hot == list(range(1, len(hot) + 1))
    assert out.where("g <> 'hot'").where("n <> 1").count() == 0


def test_numbering_ignores_input_order_and_partitions(spark):
    df = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    make = lambda d: {r[0]: r[1] for r in N.number_rows(d, [F.col("h")], [("__p", F.substring("h", 1, 1))], name="n").select("id", "n").collect()}
    assert make(df) == make(df.orderBy(F.rand(3)).repartition(7))


def test_longest_manager_match(spark):
    df = spark.createDataFrame([(1, "مدیر ارشد الف"), (2, "مدیر"), (3, "کسی"), (4, "")], "i int, m string")
    table = spark.createDataFrame([("مدیر", 1), ("مدیر ارشد", 2)], "manager_key string, center_code int")
    got = {r["i"]: (r["manager_center"], r["manager_match"]) for r in R.center_from_manager(df, "m", table).collect()}
    assert got[1] == (2, "manager_substring") and got[2] == (1, "manager_exact") and got[3] == (0, "manager_wildcard")
    strict = R.center_from_manager(df, "m", table, Policy(unknown_manager_mode="error"))
    assert {r["i"]: r["manager_center"] for r in strict.collect()}[3] is None


def test_student_center_zero_is_rewritten(spark):
    df = spark.createDataFrame([(1, 0, "مدیر"), (2, 2, "مدیر"), (3, 0, None), (4, None, "مدیر")], "student_id int, center_code bigint, m string")
    table = spark.createDataFrame([("مدیر", 1)], "manager_key string, center_code int")
    got = {r["student_id"]: (r["center_code"], r["center_source"]) for r in R.effective_center(df, "m", table).collect()}
    assert got == {1: (1, "manager_exact"), 2: (2, "raw"), 3: (0, "raw"), 4: (None, "missing")}


def test_safe_join_rejects_repeated_keys(spark):
    left = spark.range(3).withColumnRenamed("id", "k")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k bigint, v string")
    with pytest.raises(ValueError):
        R.safe_join(left, right, ["k"])
    assert R.safe_join(left, right.limit(1), ["k"]).count() == 3
