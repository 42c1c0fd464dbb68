"""Near-duplicate embeddings, hard negatives and whitening against brute force, planted cases and odd rows."""

import math
import random

import numpy as np
import pytest

from matchloom.llm import hard_negatives, queries, vector_dup
from matchloom.llm.hard_negatives import Tree, Window, search, str_order
from matchloom.llm.hard_negatives import hard_negatives as mine
from matchloom.llm.vector_dup import collision, near_vectors, table_plan
from matchloom.llm.whitening import eigenvalues_above, leading_pairs, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [NAN, 1.0], 1), (6, [INF, 1.0], 1), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1),
    (100, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1.0, 2.0], 2), (200, [-1.0, -2.0], 1), (13, [1e300, 2e300], 3), (14, [1e-300, 2e-300], 3),
]


def clusters(seed, n=160, dims=16):
    """Tight and loose clusters around the threshold, copies and scaled copies, in three labels."""
    r = np.random.default_rng(seed)
    centre, rows = r.standard_normal((6, dims)), []
    for i in range(n):
        x = centre[i % 6] + r.standard_normal(dims) * (0.0, 0.05, 0.12, 0.2, 0.5, 3.0)[i % 6]
        if i % 10 == 7:
            x = np.array(rows[r.integers(len(rows))][1]) * (1.0 if i % 20 == 7 else 2.5)
        rows.append((i, x.tolist(), int(r.integers(3))))
    return rows


def brute_links(rows, least=0.98):
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows}
    label = {i: c for i, _, c in rows}
    near = {i: [j for j in unit if j != i and label[i] == label[j] and float(unit[i] @ unit[j]) >= least] for i in unit}
    out = {}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 6)])
def test_near_vectors_against_all_pairs(spark, monkeypatch, seed, block):
    """With blocks of six every slot of a cluster is dealt out."""
    monkeypatch.setattr(vector_dup, "BLOCK", block)
    rows = clusters(seed)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute_links(rows)
    assert got == want and sum(n for n, _, _ in want.values()) > 300


def test_one_dense_cluster_in_large_groups(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal(24)
    rows = [(i, (base + r.standard_normal(24) * 0.09).tolist(), 1) for i in range(150)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_links(rows)


def test_near_vectors_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "'x' AS node", "2 AS links", "3 AS e", "4 AS sig", "5 AS component_id")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    same = {100: 3, 9: 3, 10: 3}
    for v, n, c, k in got:
        if v in same:
            assert (n, c, k) == (3, 9, v == 9)
        elif v in (13, 14):
            assert (n, c, k) == (1, 13, v == 13)
        elif v:
            assert (n, c, k) == (0, v, True)
        else:
            assert (n, c, k) == (0, None, True)
    assert len(got) == len(ODD)
    assert near_vectors(df.where("false")).count() == 0
    assert near_vectors(df.where("vec_id = 3")).count() == 1


def test_table_plan_bounds_misses():
    assert collision(0.2, 1.6) == pytest.approx(0.9003, abs=1e-3)
    for n in (10, 10_000, 10**9):
        hashes, tables, width = table_plan(n, 0.98)
        assert (1 - collision(0.2, width) ** hashes) ** tables <= 1e-7
        assert n * collision(math.sqrt(2), width) ** hashes <= 0.05


# Hard negatives


def brute_negatives(rows, k=5):
    fit = [(i, c, [math.floor(256 * v) for v in x]) for i, x, c in rows]
    out = set()
    for a, label, x in fit:
        if a % 10:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, c) for i, c, y in fit if i != a)
        for s, p, c in [t for t in scored if t[2] == label][:k]:
            found = [(n, i) for n, i, d in scored if d != label and -80 * s <= -100 * n <= -100 * s][:k]
            out |= {(a, p, rank, i, -s, -n) for rank, (n, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("seed,values", [(1, 1 << 20), (2, 16 * 20)])
def test_hard_negatives_against_all_rows(spark, monkeypatch, seed, values):
    """With small tiles every label takes several, over several groups."""
    monkeypatch.setattr(hard_negatives, "TILE_VALUES", values)
    monkeypatch.setattr(hard_negatives, "GROUP_VALUES", 4 * values)
    rows = [(i, x, c) for i, x, c in clusters(seed, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in mine(df, df.vec_id % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(spark):
    odd = [r for r in ODD if r[0] not in (13,)]
    df = spark.createDataFrame(odd, SCHEMA).selectExpr("*", "'x' AS g", "2 AS kind", "3 AS scores", "4 AS no", "5 AS anchor")
    got = mine(df, df.vec_id % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    # The anchor 100: 10 first, then both rows of 9, whose window holds 12; the zero vectors 3 and 14 score 0 with any anchor.
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id) for r in got.collect()) == [(100, 3, 1, 14), (100, 9, 1, 12), (100, 9, 1, 12), (200, 3, 1, 14)]
    assert mine(df.where("false"), df.vec_id % 100 == 0).count() == 0
    assert mine(df, df.vec_id < 0).count() == 0
    big = spark.createDataFrame([(100, [1e300], 1), (1, [1e300], 1), (2, [1e300], 2)], SCHEMA)
    with pytest.raises(Exception):
        mine(big, big.vec_id % 100 == 0).collect()


def test_tree_search_prunes_and_loses_nothing():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-40, 40, (700, 4)), r.integers(200, 260, (50, 4)), np.zeros((9, 4), np.int64)])
    order = str_order(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    ids, x = order.astype(np.int64), x[order]
    tree = Tree(1, ids, x)
    for _ in range(40):
        q = r.integers(-60, 60, 4)
        score = x @ q
        low, high = sorted(r.integers(-20_000, 20_000, 2).tolist())
        for a, b in ((low, high), (-(1 << 63), (1 << 63) - 1)):
            window = Window(a, b, 5)
            search([tree], q.astype(np.float64), int(ids[3]), [window])
            want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if a <= s <= b and i != ids[3])[:5]
            assert [(-int(s), int(i)) for s, i in zip(window.score, window.id, strict=True)] == want
    seen, plain = [], tree.x
    tree.x = type("Counted", (), {"__getitem__": lambda self, rows: seen.append(len(rows)) or plain[rows], "dtype": plain.dtype, "shape": plain.shape})()
    search([tree], np.array([50.0, 50.0, 50.0, 50.0]), -1, [Window(-(1 << 63), (1 << 63) - 1, 5)])
    assert sum(seen) < len(x)  # the far boxes are not opened


def test_a_block_of_anchors_reads_a_row_once_and_finds_what_each_finds_alone():
    r = np.random.default_rng(6)
    x, label = r.integers(-40, 40, (900, 6)), r.integers(0, 3, 900)
    anchors, seen, trees = np.arange(0, 900, 15), [], []
    for c in range(3):
        ids = np.flatnonzero(label == c)
        ids = ids[str_order(x[ids])]
        trees.append(Tree(c, ids, x[ids]))
        plain = trees[-1].x
        trees[-1].x = type("Counted", (), {"__getitem__": lambda self, rows, x=plain: seen.append(len(rows)) or x[rows], "dtype": plain.dtype, "shape": plain.shape})()
    low, high = np.sort(r.integers(-9_000, 9_000, (2, len(anchors), 2)), axis=0)
    low[:20, 1], high[:20, 1] = (1 << 63) - 1, -(1 << 63)  # no second window
    windows = [Window(low[:, no], high[:, no], 5) for no in range(2)]
    search(trees, x[anchors].astype(np.float64), anchors, windows, [label[anchors] != c for c in range(3)])
    for no, w in enumerate(windows):
        for k, a in enumerate(anchors):
            score = x @ x[a]
            want = sorted((-int(score[i]), i) for i in np.flatnonzero(label != label[a]) if low[k, no] <= score[i] <= high[k, no])[:5]
            assert [(-int(s), int(i)) for s, i in zip(w.score[w.anchor == k], w.id[w.anchor == k], strict=True)] == want
    assert sum(seen) <= len(x)


def test_hard_negatives_of_rows_of_very_different_size_are_exact(spark):
    """The score of the negative is odd and above 2^53: doubles hold both rows, but not their product."""
    big, near, far = (1 << 29) + 1, (1 << 24) + 3, (1 << 24) + 1
    df = spark.createDataFrame([(100, [big / 256], 1), (1, [near / 256], 1), (2, [far / 256], 2)], SCHEMA)
    got = [tuple(r) for r in mine(df, df.vec_id == 100).collect()]
    assert got == [(100, 1, 1, 2, big * near, big * far)]


# Whitening


def test_whitening_against_a_dense_solver(spark):
    got = queries.op13_whitening(spark, SF).collect()
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x = {i: np.floor(256 * np.array(e, np.float64)).astype(np.int64) for i, e in rows.items()}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    value, vector = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        c = r.component - 1
        w = float((x[r.vec_id] - sums / n) @ vector[:, c]) / math.sqrt(value[c])
        s = sign.setdefault(c, 1 if w * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(s * w, abs=1e-9)
        assert r.n == n and r.deviation == int(((n * x[r.vec_id] - sums) ** 2).sum()) and r.deviation_digits == str(r.deviation)
        assert r.explained == pytest.approx(value[c] / value.sum(), rel=1e-9) and abs(r.identity_error) < 1e-9


def test_eigenpairs_of_hard_matrices():
    r = np.random.default_rng(2)
    for d in (1, 2, 3, 12, 40):
        full = r.standard_normal((d + 3, d))
        cases = [full.T @ full, np.diag(np.r_[np.full(min(d, 6), 2.0), np.ones(max(0, d - 6))]), np.outer(full[0], full[0]), np.zeros((d, d))]
        scaled = full * np.exp(3 * r.standard_normal(d))
        for v in [*cases, scaled.T @ scaled]:
            want = np.linalg.eigvalsh(v)[::-1]
            want = want[want > 1e-12 * max(want.sum(), 1e-300)][:4]
            value, vector = leading_pairs(v, 4)
            assert len(value) == len(want) and np.allclose(value, want, rtol=1e-9)
            assert np.allclose(vector.T @ vector, np.eye(len(value)), atol=1e-9)
            assert np.abs(v @ vector - vector * value).max(initial=0) <= 1e-10 * max(1, np.abs(v).max())
            for shift in (0.3, 1.5, 2.5):
                assert eigenvalues_above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()


def test_whitening_of_odd_rows(spark):
    r = random.Random(1)
    rows = [x for x in ODD if x[0] not in (13, 14)] + [(300 + i, [r.gauss(0, 2), r.gauss(0, 1)], 1) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS x", "2 AS component", "3 AS at", "4 AS part")
    got = whiten(df).collect()
    whole = [v for v in rows if v[1] is not None and len(v[1]) == 2 and all(c is not None and math.isfinite(c) for c in v[1])]
    assert len(got) == 2 * len(whole) and {g.component for g in got} == {1, 2}
    assert whiten(df.where("false")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], SCHEMA)
    assert whiten(one).count() == 0  # a single distinct vector has no variance
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(5)], SCHEMA)
    assert {g.component for g in whiten(line).collect()} == {1}
    wide = spark.createDataFrame([(1, [3e15], 1), (2, [-3e15], 1), (3, [0.0], 1)], SCHEMA)
    far = {g.vec_id: (g.deviation, g.deviation_digits) for g in whiten(wide).collect()}
    exact = [256 * 3 * 10**15, -256 * 3 * 10**15, 0]
    assert far[1] == (None, str((3 * exact[0] - sum(exact)) ** 2)) and far[3] == (0, "0")
