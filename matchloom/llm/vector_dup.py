"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Datar et al. 2004: a hash is floor((a.v + b) / width) for a Gaussian direction a; a slot of a table is
the hash of ``hashes`` of them. Vectors are normalised first, so that cosine is distance. The
number of hashes grows with the logarithm of the rows (few unlike vectors share a slot) and
the number of tables follows from it: a pair at the threshold shares no slot with probability
``MISS``. Candidates are then compared exactly, in double precision.

A pair counts in the first table whose slot both share, which the two signatures tell, so that no
pair is ever sent or made distinct. Tasks return sums of links and one root a vector, never pairs.
Equal vectors are one node with a number of copies. A slot of more than ``BLOCK`` vectors is dealt
into blocks, and every two blocks meet in a group of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.near_dup import components
from matchloom.llm.shared import stored, work_folder
from matchloom.llm.vectors import is_finite, list_array, matrices, vector_column

LEAST_COSINE = 0.98
#: Probability that a pair at the threshold meets in no table.
MISS = 1e-7
#: Slots in which a vector meets an unlike one, on average, over the rows of the largest label.
CHANCE = 0.05
#: Width of a hash, in distances of the threshold.
WIDTH = 8.0
BLOCK = 512
GROUP = ["label", "dims", "t", "h", "i", "j"]


def collision(distance: float, width: float) -> float:
    """Probability that one p-stable hash of ``width`` agrees on two points at ``distance``."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(rows: int, least: float) -> tuple[int, int, float]:
    """(hashes of a slot, tables, width) for labels of up to ``rows`` vectors."""
    near = math.sqrt(max(2 - 2 * least, 1e-6))
    width = WIDTH * near
    hashes = max(1, math.ceil(math.log(max(rows, 2) / CHANCE) / -math.log(collision(math.sqrt(2), width))))
    tables = math.ceil(math.log(MISS) / math.log1p(-(collision(near, width) ** hashes)))
    return hashes, tables, width


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _signatures(hashes: int, tables: int, width: float):
    """Adds dims and sig, a slot number a table, to (node, rep, label, copies, e)."""

    def run(batches):
        drawn: dict = {}
        for batch in batches:
            sig = np.zeros((batch.num_rows, tables), np.int32)
            dims = np.zeros(batch.num_rows, np.int32)
            for rows, x in matrices(batch.column("e")):
                d = x.shape[1]
                if d not in drawn:
                    r = np.random.Generator(np.random.PCG64([d, hashes, tables]))
                    drawn[d] = r.standard_normal((d, hashes * tables)), r.uniform(0, width, hashes * tables), r.integers(1, 1 << 62, hashes * tables, np.int64) | 1
                direction, offset, mixer = drawn[d]
                dims[rows] = d
                for k in range(0, len(rows), 1024):
                    cell = np.floor((unit(x[k : k + 1024]) @ direction + offset) / width).astype(np.int64)
                    mixed = (cell * mixer).reshape(-1, tables, hashes).sum(axis=2)
                    sig[rows[k : k + 1024]] = (mixed >> 31).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), list_array(sig)], [*batch.schema.names, "dims", "sig"])

    return run


def _propagated(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row number reachable from each of ``n`` rows over the links p - q."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, p, root[q])
        np.minimum.at(root, q, root[p])
        root = root[root]
        if (root == before).all():
            return root


def _compare(table: pa.Table, least: float) -> pa.RecordBatch | None:
    """node, links and root of the linked rows of whole groups."""
    n = table.num_rows
    keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in GROUP], axis=1)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, n])
    node, copies, salt = (table.column(c).to_numpy() for c in ("node", "copies", "s"))
    sig = np.concatenate([m for _, m in matrices(table.column("sig").combine_chunks())])
    x = {d: (rows, scaled(m)) for rows, m in matrices(table.column("e").combine_chunks()) for d in [m.shape[1]]}
    place = np.zeros(n, np.int64)
    norm = np.zeros(n)
    for rows, m in x.values():
        place[rows], norm[rows] = np.arange(len(rows)), np.sqrt((m * m).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(p: np.ndarray, q: np.ndarray) -> None:
        """Those of the linked pairs that share no slot of an earlier table."""
        for k in range(0, len(p), 65536):
            a, b = p[k : k + 65536], q[k : k + 65536]
            first = (sig[a] == sig[b]).argmax(axis=1) == keys[a, 2]
            found.append((a[first], b[first]))

    for size in np.unique(sizes):
        own = starts[sizes == size]
        if size < 2:
            continue
        if size <= 32:
            a, b = np.triu_indices(size, 1)
            step = max(1, 65536 // len(a))
            for k in range(0, len(own), step):
                p, q = ((own[k : k + step, None] + side).ravel() for side in (a, b))
                apart = (keys[p, 4] == keys[p, 5]) | (salt[p] != salt[q])
                p, q = p[apart], q[apart]
                for d in np.unique(keys[p, 1]):
                    m, at = x[d][1], keys[p, 1] == d
                    cosine = np.einsum("ij,ij->i", m[place[p[at]]], m[place[q[at]]]) / (norm[p[at]] * norm[q[at]])
                    keep(p[at][cosine >= least], q[at][cosine >= least])
            continue
        for start in own:
            m = x[keys[start, 1]][1]
            rows = np.arange(start, start + size)
            i, j = keys[start, 4:]
            left, right = (rows, rows) if i == j else (rows[salt[rows] == i], rows[salt[rows] == j])
            cosine = (m[place[left]] @ m[place[right]].T) / (norm[left][:, None] * norm[right])
            p, q = np.nonzero(np.triu(cosine >= least, 1) if i == j else cosine >= least)
            keep(left[p], right[q])
    p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if not len(p):
        return None
    links = np.zeros(n, np.int64)
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    root = _propagated(n, p, q)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], ["node", "links", "root"])


def _linked(least: float):
    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in GROUP], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:  # the last group may go on in the next batch
                if (done := _compare(rest.slice(0, whole), least)) is not None:
                    yield done
                rest = rest.slice(whole)
        if rest is not None and (done := _compare(rest, least)) is not None:
            yield done

    return run


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding, label).

    Two rows link when their labels are equal, not null, and the cosine of their vectors is at
    least ``least``. ``n_links`` counts the other rows linked directly, ``component_id`` is the least
    vec_id reachable, ``kept`` says whether it is the row's own.

    A row links with nothing if its label or vector is null, its vector is empty or zero, or a component is
    null or not finite; vectors of different lengths do not link. A row without vec_id links with
    nothing: its component_id is null and it is kept. Rows that repeat a vec_id are rows of their own.
    Other columns are not read. An empty table gives an empty table.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "vector-dup")
    e = vector_column(rows, "embedding")
    fit = is_finite(e) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.when(fit, e).alias("e"))
    linkable = rows.where("e is not null")
    same = linkable.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    nodes = stored(same.select(F.monotonically_increasing_id().alias("node"), "rep", "label", "copies", "e"), folder, "nodes")
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    kind = nodes.schema["e"].dataType.simpleString()
    signed = nodes.mapInArrow(_signatures(*table_plan(most, least)), f"node long, rep long, label long, copies long, e {kind}, dims int, sig array<int>")
    signed = stored(signed, folder, "signed")
    slots = signed.select("node", "label", "dims", F.posexplode("sig").alias("t", "h"))
    shared = slots.groupBy("label", "dims", "t", "h").agg(F.count("*").alias("c")).where("c > 1")
    taken = slots.join(shared, ["label", "dims", "t", "h"]).groupBy("node").agg(F.collect_list(F.struct("t", "h", "c")).alias("taken"))
    placed = signed.join(taken, "node").select("node", "label", "copies", "e", "dims", "sig", F.explode("taken").alias("x"))
    blocks = F.ceil(F.col("x.c") / BLOCK).cast("int")
    placed = placed.select("*", "x.t", "x.h", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("s"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("label", "dims", "t", "h", F.least("s", "other").alias("i"), F.greatest("s", "other").alias("j"), "s", "node", "copies", "e", "sig")
    linked = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_linked(least), "node long, links long, root long")
    linked = stored(linked, folder, "linked")
    found = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), folder, "components")
    reached = found.join(nodes.select("node", "rep"), "node")
    least_of = reached.groupBy("comp").agg(F.min("rep").alias("component_id"))
    home = reached.join(least_of, "comp").select("node", "component_id")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    judged = nodes.join(home, "node", "left").join(links, "node", "left").select(
        F.col("label").alias("l"), F.col("e").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "rep").alias("component")
    )
    out = rows.join(judged, (F.col("label") == F.col("l")) & (F.col("e") == F.col("v")), "left")
    component = F.when(F.col("e").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


#: The same rows by comparing all pairs of a label.
SQL = """
WITH RECURSIVE fit AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a
"""
