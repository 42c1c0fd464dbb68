"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round ``i`` every shingle is hashed to one of
``COORDINATES`` bins with value ``i + fraction``; from round ``COORDINATES`` on, round ``i``
goes to bin ``i - COORDINATES`` only, so that every bin is filled after at most twice as many
rounds, and an estimate from the bins is concentrated as that of independent hashes.

Links are decided on full shingle sets. What the bands decide is only which pairs are looked
at: at similarity 0.8 a pair shares none of the 45 bands of 6 coordinates with probability
1e-6. Documents of equal sets are one node from the start, and a bucket is never turned into
all its pairs: first every member meets the bucket's least node, and joined members are one
component. Nodes of buckets that still hold several components go to an exact prefix filter on
their rarest shingles, with bounds from sizes and positions, which compares across components only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.bytesops import BASE, STEP, U, mix, row_bytes, salt, shingles, slices, words
from matchloom.llm.shared import stored, work_folder

BANDS, ROWS = 45, 6
COORDINATES = BANDS * ROWS
#: Pairs whose sketches agree in fewer coordinates are not verified. At similarity 0.8 the
#: expected number is 216; falling to 166 has a probability under 1e-8 (Hoeffding).
LEAST_AGREEING = 166
#: Hash classes whose parities bound the difference of two sets from below.
PARITIES = 1024
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketch(value: np.ndarray, rows: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` filled coordinates for each row of shingles; rows without shingles stay EMPTY."""
    n = len(rows) - 1
    out = np.full(n * t, EMPTY, U)
    row = np.repeat(np.arange(n), np.diff(rows))
    live = value
    for i in range(2 * t):
        if not len(live):
            break
        x = mix((live ^ salt(i + 1, STEP)) * BASE)
        bin_ = ((x >> U(40)) % U(t)).astype(np.int64) if i < t else np.int64(i - t)
        np.minimum.at(out, row * t + bin_, (U(i) << U(40)) | (x & U((1 << 40) - 1)))
        open_ = (out.reshape(n, t) == EMPTY).any(axis=1)[row]
        live, row = live[open_], row[open_]
    return out.reshape(n, t)


def _profile(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = row_bytes(batch.column("text"))
            for a, b in slices(offsets):
                word, rows = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                value, ends = shingles(word, rows, size)
                s = sketch(value, ends)
                node = [xxhash.xxh3_128_digest(value[x:y].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                band = np.zeros((b - a, BANDS), U)
                for j in range(ROWS):
                    band = band * STEP + mix(s[:, j::ROWS])
                band = mix(band + np.arange(BANDS, dtype=U) * BASE).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("text_hash").slice(a, b - a),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(node, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.ravel())),
                        pa.array([x.tobytes() for x in (mix(s) >> U(56)).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "node", "bands", "sketch"],
                )

    return run


def _agreeing(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sketch_a", "sketch_b"))
        keep = pa.array((a == b).sum(axis=1) >= LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _linked(size: int, percent: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")])
            sets: list[np.ndarray] = []
            data, offsets = row_bytes(both)
            for a, b in slices(offsets):
                value, ends = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), size)
                sets += [value[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            keep = np.zeros(n, bool)
            for i in range(n):
                x, y = sets[i], sets[n + i]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _tokens(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = row_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 19):
                value, ends = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), size)
                count = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), count))),
                        pa.array(value.view(np.int64)),
                        pa.array(np.repeat(count, count), pa.int64()),
                    ],
                    ["node", "token", "n"],
                )

    return run


def _parities(size: int):
    """Of each node, whether an odd number of its shingles falls into each of PARITIES hash classes."""

    def run(batches):
        for batch in batches:
            data, offsets = row_bytes(batch.column("text"))
            for a, b in slices(offsets):
                value, ends = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), size)
                row = np.repeat(np.arange(b - a), np.diff(ends))
                count = np.bincount(row * PARITIES + (value % U(PARITIES)).astype(np.int64), minlength=(b - a) * PARITIES)
                packed = np.packbits((count & 1).astype(np.uint8)).view(np.int64)
                each = PARITIES // 64
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * each + 1, each, dtype=np.int32)), pa.array(packed))],
                    ["node", "parity"],
                )

    return run


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b); comp is the least node of the component.

    Large-star and small-star rounds (Kiveris et al. 2014): a logarithmic number, each a
    grouped minimum and a join, so that a node of many neighbours is never gathered.
    """
    spark = edges.sparkSession
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), folder, f"{name}_edges")
    turn, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        edges = stored(small, folder, f"{name}_round{turn}")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, ...).

    Words are runs without ASCII white space, A-Z lower-cased; a document is the set of its
    ``shingle``-word shingles (its whole sequence if it has fewer words). Documents link when
    100 * intersection >= ``percent`` * union. ``component_id`` is the least doc_id reachable.

    Null or wordless texts have no shingles and link with nothing. A row without doc_id links
    with nothing: its component_id is null and it is kept. Rows that repeat a doc_id each go
    by their own text. Other columns are not read. An empty table gives an empty table.
    ``with_hash`` adds text_hash, xxhash64 of the text, which tells such rows apart.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "near-dup")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_profile(shingle), "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>, sketch binary"), folder, "rows")
    linkable = rows.where("n_shingles > 0 and doc_id is not null")
    nodes = linkable.groupBy("node").agg(F.min("doc_id").alias("rep"))
    # Bands of one row a node; rows that share doc_id and node are the same row again.
    banded = linkable.join(nodes, "node").where("doc_id = rep").select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("bucket", "pivot")
    members = stored(banded.join(shared, "bucket").distinct(), folder, "members")
    if members.isEmpty():
        return _result(rows, nodes, None, with_hash)
    taken = members.select("node").distinct()
    sketches = stored(linkable.join(taken, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"), F.min("doc_id").alias("rep")), folder, "sketches")
    texts = stored(docs.join(sketches.select("node", F.col("rep").alias("doc_id")), "doc_id").select("node", "text").mapInArrow(_same_node(shingle), "node binary, text string"), folder, "texts")

    def likely(pairs: DataFrame) -> DataFrame:
        left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
        right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(_agreeing, "a binary, b binary")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return stored(pairs.join(left, "a").join(right, "b").mapInArrow(_linked(shingle, percent), "a binary, b binary"), folder, name)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
        return pairs.where("coalesce(comp_a, a) <> coalesce(comp_b, b)").select("a", "b")

    # Every member against its bucket's least node, one such pair a node first.
    stars = stored(likely(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()), folder, "stars")
    edges = verified(stars.groupBy("a").agg(F.min("b").alias("b")), "links1")
    labels = stored(components(edges, folder, "first"), folder, "labels1")
    rest = stored(apart(stars, labels), folder, "stars2")
    if not rest.isEmpty():
        edges = edges.unionByName(verified(rest, "links2"))
        labels = stored(components(edges, folder, "second"), folder, "labels2")
    # Buckets that still hold several components: what may link across them, nothing else.
    placed = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    loose = stored(placed.join(mixed, "bucket").select("node", "comp").distinct(), folder, "loose")
    if loose.isEmpty():
        return _result(rows, nodes, labels, with_hash)
    prefixes = stored(_prefixes(texts.join(loose, "node"), shingle, percent), folder, "prefixes")
    found = _across(prefixes, percent).join(stars, ["a", "b"], "left_anti")
    found = stored(likely(found), folder, "found")
    if not found.isEmpty():
        edges = edges.unionByName(verified(found, "links3"))
        labels = stored(components(edges, folder, "third"), folder, "labels3")
    return _result(rows, nodes, labels, with_hash)


def _same_node(size: int):
    """Keeps the rows whose text has the node they were joined with (a doc_id may come with several texts)."""

    def run(batches):
        for batch in batches:
            data, offsets = row_bytes(batch.column("text"))
            keep: list[bool] = []
            want = batch.column("node").to_pylist()
            for a, b in slices(offsets):
                value, ends = shingles(*words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), size)
                keep += [xxhash.xxh3_128_digest(value[x:y].tobytes()) == w for x, y, w in zip(ends[:-1], ends[1:], want[a:b], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _prefixes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(token, node, n, pos, comp, parity): the rarest shingles of each node, enough that linked nodes share one.

    With n shingles a partner has at least ``percent`` hundredths of them in common, so the
    first n - ceil(n * percent / 100) + 1 in any common order will do; the order is by frequency.
    ``pos`` is the place in that order, from 0.
    """
    tokens = texts.select("node", "text").mapInArrow(_tokens(shingle), "node binary, token long, n long")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one node only come first in the order; they are counted, not carried along.
    ordered = tokens.join(often, "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    alone = F.col("n") - F.size("t")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    cut = ordered.where(length > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), length.cast("int"))).alias("k", "x"))
    owner = texts.select("node", "comp").distinct().join(texts.select("node", "text").mapInArrow(_parities(shingle), "node binary, parity array<long>"), "node")
    return cut.select(F.col("x.token").alias("token"), "node", "n", (F.col("alone") + F.col("k")).alias("pos")).join(owner, "node")


def _across(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a the greater node, of different components that the bounds leave.

    A pair that first meets at places p and q has at most min(n - p, m - q) shingles in common,
    and each hash class with an odd number of one and an even number of the other holds a
    shingle that only one has. Pairs inside a token's most frequent component are never formed.
    """
    parts = prefixes.groupBy("token", "comp").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    several = parts.groupBy("token").agg(F.count("*").alias("k"), F.max_by("comp", F.struct("c", "comp")).alias("major"), F.min("least").alias("least")).where("k > 1")
    # The greatest size a partner may have, against the least size that comes with the token.
    partner = F.floor((F.col("n") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    rows = prefixes.join(several, "token").where(F.col("least") <= partner).select("token", "node", "n", "pos", "comp", "parity", "major")
    left = rows.where("comp <> major").select("token", *[F.col(c).alias(f"{c}_l") for c in ("node", "n", "pos", "comp", "parity")])
    right = rows.select("token", *[F.col(c).alias(f"{c}_r") for c in ("node", "n", "pos", "comp", "parity")])
    most = F.least(F.col("n_l") - F.col("pos_l"), F.col("n_r") - F.col("pos_r"))
    apart = sum((F.bit_count(F.get("parity_l", F.lit(k)).bitwiseXOR(F.get("parity_r", F.lit(k)))) for k in range(PARITIES // 64)), F.lit(0))
    both = F.col("n_l") + F.col("n_r")
    fits = (F.col("comp_l") != F.col("comp_r")) & (100 * most >= percent * (both - most)) & ((100 + percent) * apart <= (100 - percent) * both)
    pairs = left.withColumnRenamed("token", "token_l").join(right, (F.col("token_l") == F.col("token")) & fits)
    return pairs.select(F.greatest("node_l", "node_r").alias("a"), F.least("node_l", "node_r").alias("b")).distinct()


def _result(rows: DataFrame, nodes: DataFrame, labels: DataFrame | None, with_hash: bool) -> DataFrame:
    home = nodes
    if labels is not None:
        least = labels.join(nodes, "node").groupBy("comp").agg(F.min("rep").alias("least"))
        home = nodes.join(labels.join(least, "comp").select("node", "least"), "node", "left").select("node", F.coalesce("least", "rep").alias("rep"))
    joined = rows.select("doc_id", "text_hash", "n_shingles", "node").join(home.withColumnRenamed("rep", "component_id"), "node", "left")
    lone = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull() | F.col("component_id").isNull()
    component = F.when(lone, F.col("doc_id")).otherwise(F.col("component_id"))
    hashed = ["text_hash"] if with_hash else []
    return joined.select("doc_id", *hashed, "n_shingles", component.alias("component_id"), (component.isNull() | (F.col("doc_id") == component)).alias("kept"))
