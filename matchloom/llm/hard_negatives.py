"""Hard negatives from an exact search in STR-packed R-trees.

Rows are packed into tiles by sort-tile-recursive order (Leutenegger et al. 1997): slabs of the first
coordinate by a range partition of the table, then slices by the widest coordinates inside each slab,
then leaves of ``LEAF`` rows under boxes of ``FAN`` children. A tile holds one label and a bounded
number of values. For a query, the bounding box of a node gives an interval for each product of
coordinates and, summed, one for the score. Anchors search in blocks: a best-first queue takes the nodes by
their upper ends, and one matrix product scores the rows of its leaves for the whole block; a node goes if, for
every anchor, it lies outside each score window still open, or strictly below the kth score found. Scores are
exact integers.

The first search finds the positives (tiles of the anchor's label), the second the negatives.
Anchors are sent in rows, each to every group of tiles; a task holds one group of tiles at a time and streams
the anchors through. What it returns is at most k rows a window, and a ranking merges the groups.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.shared import stored, work_folder
from matchloom.llm.vectors import is_finite, matrices, vector_column
from matchloom.operators.numbering import number_rows

SCALE = 256
POSITIVES = NEGATIVES = 5
#: A negative scores at least this many hundredths of the positive, and at most as much.
LEAST_PERCENT = 80
LEAF, FAN = 32, 16
#: Leaves that the queue hands over at once.
TAKE = 16
#: Anchors that search together, and the bounds (anchors x leaves) that their queue may hold.
BLOCK, QUEUE_BOUNDS = 1024, 1 << 22
#: Values (rows x length) of a tile, and of the tiles of a group, which a task holds together.
TILE_VALUES, GROUP_VALUES = 1 << 20, 1 << 24
NONE = -(1 << 63)


def str_order(x: np.ndarray) -> np.ndarray:
    """Rows in sort-tile-recursive order by their three widest coordinates; ties stay in the order given."""
    leaves = -(-len(x) // LEAF)
    if not x.shape[1] or leaves < 2:
        return np.arange(len(x))
    wide = np.argsort(-np.var(x.astype(np.float64), axis=0), kind="stable")[:3]

    def tiles(rows: np.ndarray, axes: np.ndarray) -> list[np.ndarray]:
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        if len(axes) == 1:
            return [rows]
        slices = max(1, round((-(-len(rows) // LEAF)) ** (1 / len(axes))))
        each = -(-len(rows) // (slices * LEAF)) * LEAF
        return [t for k in range(0, len(rows), each) for t in tiles(rows[k : k + each], axes[1:])]

    return np.concatenate(tiles(np.arange(len(x)), wide))


def exact_type(dims: int, one: int, other: int) -> type:
    """The fastest type that holds every sum of products of ``dims`` components up to ``one`` and ``other``."""
    most = dims * one * other
    if most >= 1 << 62:
        raise OverflowError("components too large: their integer products do not fit a long")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


class Tree:
    """One tile: rows in STR order, and the boxes of each level from the leaves up."""

    def __init__(self, label: int, ids: np.ndarray, x: np.ndarray):
        self.label, self.ids, self.most = label, ids, int(np.abs(x).max(initial=0))
        self.x = x.astype(exact_type(x.shape[1], self.most, self.most))
        low, high, self.levels = self.x, self.x, []
        for fan in (LEAF, *[FAN] * 64):
            at = np.arange(0, len(low), fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low, high))
            if len(low) == 1:
                break

    def of_type(self, kind: type) -> Tree:
        """The same tile with numbers of another type."""
        if self.x.dtype == kind:
            return self
        tree = copy.copy(self)
        tree.x, tree.levels = self.x.astype(kind), [(low.astype(kind), high.astype(kind)) for low, high in self.levels]
        return tree

    def bounds(self, level: int, nodes: slice, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor in each box: a coordinate contributes q * low to q * high, or the reverse."""
        low, high = (side[nodes] for side in self.levels[level])
        return low @ up + high @ down, high @ up + low @ down


class Window:
    """The best ``k`` (score, id) that each anchor of a block found in its score window; higher first, ties by the smaller id."""

    def __init__(self, low: np.ndarray | int, high: np.ndarray | int, k: int):
        #: Scores strictly below can't come in any more: the low end, or the kth score.
        self.floor = np.atleast_1d(np.array(low, np.int64))
        self.high, self.k = np.atleast_1d(np.array(high, np.int64)), k
        self.anchor = self.score = self.id = np.zeros(0, np.int64)

    def take(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((score >= self.floor[anchor]) & (score <= self.high[anchor]))
        if len(fits):
            changed = np.zeros(len(self.floor), bool)
            changed[anchor[fits]] = True
            old = changed[self.anchor]
            a, s, i = (np.concatenate([mine[old], new[fits]]) for mine, new in ((self.anchor, anchor), (self.score, score), (self.id, ids)))
            order = np.lexsort((i, -s, a))
            a, s, i = a[order], s[order], i[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            best, last = rank < self.k, rank == self.k - 1
            self.anchor, self.score, self.id = (np.concatenate([mine[~old], new[best]]) for mine, new in ((self.anchor, a), (self.score, s), (self.id, i)))
            self.floor[a[last]] = s[last]


def search(trees: list[Tree], query: np.ndarray, self_id: np.ndarray | int, windows: list[Window], part: list[np.ndarray] | None = None) -> None:
    """Fill ``windows`` for a block of anchors (rows of ``query``) from all rows of ``trees`` but those of the
    anchor's ``self_id``, best boxes first. ``part`` names the anchors that take part in each tree (None: all)."""
    q, self_id = np.ascontiguousarray(np.atleast_2d(query).T), np.atleast_1d(self_id)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    top = np.stack([w.high for w in windows])[:, None].astype(q.dtype)
    queue: list[tuple] = []
    heap_no = 0

    def floors() -> np.ndarray:
        return np.stack([w.floor for w in windows])[:, None].astype(q.dtype)

    def wanted(low: np.ndarray, high: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """Boxes (rows of ``low`` and ``high``) that meet a window still open of an anchor that takes part."""
        return ((high >= floor) & (low <= top) & fits).any(axis=(0, 2))

    def push(tree: Tree, fits: np.ndarray, level: int, nodes: slice) -> None:
        nonlocal heap_no
        low, high = tree.bounds(level, nodes, up, down)
        for k in np.flatnonzero(wanted(low, high, fits)).tolist():
            heap_no += 1
            heapq.heappush(queue, (-high[k].max(), heap_no, low[k], high[k], tree, fits, level, nodes.start + k))

    floor = floors()
    for tree, fits in zip(trees, part or [np.ones(len(self_id), bool)] * len(trees), strict=True):
        push(tree, fits, len(tree.levels) - 1, slice(0, 1))
    while queue:
        leaves: list[tuple] = []
        while queue and len(leaves) < TAKE:
            _, _, low, high, tree, fits, level, node = heapq.heappop(queue)
            if not wanted(low[None], high[None], fits)[0]:
                continue
            if level:
                push(tree, fits, level - 1, slice(node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][0]))))
            else:
                leaves.append((tree, fits, np.arange(node * LEAF, min((node + 1) * LEAF, len(tree.ids)))))
        if not leaves:
            break
        score = np.concatenate([tree.x[rows] for tree, _, rows in leaves]) @ q
        row, anchor = np.divmod(np.flatnonzero((score >= floor.min(axis=0)) & (score <= top.max(axis=0))), len(self_id))
        ids = np.concatenate([tree.ids[rows] for tree, _, rows in leaves])[row]
        leaf = np.repeat(np.arange(len(leaves)), [len(rows) for *_, rows in leaves])[row]
        other = (ids != self_id[anchor]) & np.stack([fits for _, fits, _ in leaves])[leaf, anchor]
        for w in windows:
            w.take(anchor[other], score[row, anchor][other].astype(np.int64), ids[other])
        floor = floors()


def _packed(batches):
    """Tiles of rows that come in order of (dims, label, ...): equal dims and label, TILE_VALUES at most."""

    def tile(dims: int, label: int, ids: list, parts: list):
        x, names = np.concatenate(parts), np.concatenate(ids)
        order = str_order(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), pa.array([label], pa.int64()), pa.array([x.size], pa.int64()), pa.array([names[order].tobytes()]), pa.array([x[order].astype(np.int64).tobytes()])],
            ["dims", "label", "size", "ids", "x"],
        )

    key, ids, parts, held = None, [], [], 0
    for batch in batches:
        for rows, x in sorted(matrices(batch.column("x")), key=lambda m: m[1].shape[1]):
            d, most = x.shape[1], max(1, TILE_VALUES // x.shape[1])
            label, vec_id = (batch.column(c).to_numpy()[rows] for c in ("label", "vec_id"))
            edges = np.r_[np.flatnonzero(np.r_[True, label[1:] != label[:-1]]), len(rows)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if key != (d, label[a]) and held:
                    yield tile(*key, ids, parts)
                    ids, parts, held = [], [], 0
                key = d, label[a]
                while a < b:
                    n = min(b - a, most - held)
                    ids.append(vec_id[a : a + n])
                    parts.append(x[a : a + n])
                    held, a = held + n, a + n
                    if held == most:
                        yield tile(*key, ids, parts)
                        ids, parts, held = [], [], 0
    if held:
        yield tile(*key, ids, parts)


def _block(trees: list[Tree], asked: list[tuple], same_label: bool, k: int, least_percent: int):
    """vec_id, no, score and found: the best of each window of a block of anchors (vec_id, label, x, scores)."""
    ids, labels, queries, scores = zip(*asked, strict=True)
    ids, labels, queries = np.array(ids, np.int64), np.array(labels, np.int64), np.stack(queries)
    part = [(labels == t.label) == same_label for t in trees]
    near = [(t, fits) for t, fits in zip(trees, part, strict=True) if t.x.shape[1] == queries.shape[1] and fits.any()]
    if not near:
        return None
    kind = exact_type(queries.shape[1], int(np.abs(queries).max()), max(t.most for t, _ in near))
    # Where a type holds a score exactly it holds these ends too, or the ends exceed every score.
    if scores[0] is None:
        windows = [Window(np.full(len(ids), NONE), np.full(len(ids), -NONE - 1), k)]
    else:
        ends = [[(min(max(-(-least_percent * s // 100), NONE), -NONE - 1), s) for s in row] for row in scores]
        none = (-NONE - 1, NONE)  # an anchor with fewer positives
        windows = [Window(*zip(*(row[no] if no < len(row) else none for row in ends), strict=True), k) for no in range(max(map(len, ends)))]
    search([t.of_type(kind) for t, _ in near], queries.astype(kind), ids, windows, [fits for _, fits in near])
    columns = (np.concatenate(c) for c in zip(*((ids[w.anchor], np.full(len(w.id), no, np.int32), w.score, w.id) for no, w in enumerate(windows, 1)), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "no", "score", "found"])


def _searched(same_label: bool, k: int, least_percent: int):
    """Rows of one group of tiles, then its anchors, group after group; yields the best of each window."""

    def run(batches):
        group, trees, asked, leaves = None, [], [], 0

        def answers():
            if asked and (found := _block(trees, asked, same_label, k, least_percent)) is not None:
                yield found
            asked.clear()

        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                g, dims, label, ids, x = (columns[c][i].as_py() for c in ("g", "dims", "label", "ids", "x"))
                values = np.frombuffer(x, np.int64).reshape(-1, dims)
                if g != group or (asked and len(asked[0][2]) != dims):
                    yield from answers()
                if g != group:
                    group, trees, leaves = g, [], 0
                if ids is not None:
                    trees.append(Tree(label, np.frombuffer(ids, np.int64), values))
                    leaves += len(trees[-1].levels[0][0])
                    continue
                asked.append((columns["vec_id"][i].as_py(), label, values[0], columns["scores"][i].as_py()))
                if len(asked) >= min(BLOCK, QUEUE_BOUNDS // max(1, leaves), TILE_VALUES // dims):
                    yield from answers()
        yield from answers()

    return run


def _as_bytes(batches):
    """Anchor rows with x as bytes."""
    for batch in batches:
        x = [None] * batch.num_rows
        for rows, m in matrices(batch.column("x")):
            for r, v in zip(rows, m.astype(np.int64), strict=True):
                x[r] = v.tobytes()
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "dims")), pa.array(x, pa.binary())], ["vec_id", "label", "dims", "x"])


def _best(tiles: DataFrame, anchors: DataFrame, groups: int, same_label: bool, k: int, least_percent: int) -> DataFrame:
    """vec_id, no, rank, score and found: the best ``k`` of each window over all groups of tiles."""
    held = tiles.select("g", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("vec_id"), "dims", "label", "ids", "x", F.lit(None).cast("array<bigint>").alias("scores"))
    asked = anchors.select("g", F.lit(1).alias("kind"), "vec_id", "dims", "label", F.lit(None).cast("binary").alias("ids"), "x", "scores")
    both = held.unionByName(asked).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "kind", "dims", "label")
    found = both.mapInArrow(_searched(same_label, k, least_percent), "vec_id long, no int, score long, found long")
    order = W.partitionBy("vec_id", "no").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among ``rows``.

    ``rows`` has vec_id, label and embedding; a component c becomes floor(``scale`` * c). A row's score is its
    integer inner product with the anchor; higher scores come first, ties by the smaller vec_id. The
    positives are the first ``positives`` rows of the anchor's label, the negatives of each the first
    ``negatives`` rows of another label between ``least_percent`` hundredths of its score and its score.

    Rows take no part without vec_id or label, with a null or empty vector, or with a null or
    non-finite component; vectors of another length than the anchor's are not compared. Rows that
    repeat a vec_id count each, but never for the anchor of their own id; an anchor id counts once (least
    label, then vector). Anchors without a positive, and positives without a negative, give no row. Scores
    beyond a long fail. Other columns are not read. An empty table gives an empty table.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "hard-negatives")
    e = vector_column(rows, "embedding")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(e)
    columns = F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.size(e).alias("dims"), F.transform(e, lambda v: F.floor(v.cast("double") * scale)).alias("x")
    order = ["dims", "label", "at", "vec_id"]
    whole = rows.where(fit).select(*columns).withColumn("at", F.get("x", F.lit(0)))
    packed = whole.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "x").mapInArrow(_packed, "dims int, label long, size long, ids binary, x binary")
    packed = stored(packed.withColumn("key", F.monotonically_increasing_id()), folder, "tiles")
    count, values = packed.agg(F.count("*"), F.sum("size")).first()
    groups = max(1, min(count, max(-(-int(values or 0) // GROUP_VALUES), spark.sparkContext.defaultParallelism)))
    numbered = number_rows(packed.select("key", "dims", "label"), [F.col("key")], [("__part", F.shiftright("key", 33))], name="no")
    homes = stored(numbered.select("key", "dims", "label", ((F.col("no") - 1) % groups).cast("int").alias("g")), folder, "homes")
    tiles = packed.join(homes.select("key", "g"), "key")
    # The cheap filter first: of other rows no component is looked at.
    anchors = rows.where(is_anchor).where(fit).select(*columns).groupBy("vec_id").agg(F.min(F.struct("label", "dims", "x")).alias("a")).select("vec_id", "a.*")
    anchors = stored(anchors.mapInArrow(_as_bytes, "vec_id long, label long, dims int, x binary"), folder, "anchors")
    # Positives: only groups that hold tiles of the anchor's label.
    own = anchors.join(homes.select("dims", "label", "g").distinct(), ["dims", "label"]).withColumn("scores", F.lit(None).cast("array<bigint>"))
    best = stored(_best(tiles, own, groups, True, positives, least_percent), folder, "positives")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "score", "found")))
    chosen = anchors.join(best.groupBy("vec_id").agg(ordered.alias("p")), "vec_id").withColumn("scores", F.col("p.score"))
    asked = chosen.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    worst = _best(tiles, asked, groups, False, negatives, least_percent)
    named = best.select(F.col("vec_id").alias("anchor_id"), F.col("rank").alias("no"), F.col("score").alias("positive_score"), F.col("found").alias("positive_id"))
    out = worst.withColumnRenamed("vec_id", "anchor_id").join(named, ["anchor_id", "no"])
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same rows by comparing every anchor with all rows.
SQL = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS own, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
pos AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
neg AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM pos JOIN scored USING (anchor_id) WHERE NOT own AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
