"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Each paragraph (a line; a line of several sentences counts by sentence, and one of over ``LONG`` words
is cut further after words that their hashes choose, so that an edit leaves the pieces before it alone) is hashed to
three cells; a cell keeps a count, a sum of digests and a sum of check hashes. Sketches of two
versions are subtracted; cells left with one digest are peeled until the differing digests are
recovered. If cells stay, both sketches are built again four times as large.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.bytesops import BASE, STEP, U, mix, row_bytes, salt, slices, span_hashes, spans

CELLS, HASHES, GROWTH = 24, 3, 4
#: Sentences of more words are cut after each word whose hash is divisible by ``CUT``.
LONG, CUT = 12, 8
# Sentence ends of other scripts, which no space follows, in UTF-8.
SENTENCE_ENDS = tuple(c.encode() for c in "\u3002\uff01\uff1f\u0964\u0965")
#: Texts that are paired and sketched together.
PAIR_BYTES = 1 << 20


def digests(texts: list[str]) -> list[np.ndarray]:
    """Distinct 64-bit digests of each text's paragraphs; a paragraph's k-th occurrence is a digest of its own."""
    out: list[np.ndarray] = []
    data, offsets = row_bytes(pa.array(texts, pa.string()))
    for a, b in slices(offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        ends = (d == 46) | (d == 33) | (d == 63)  # . ! ?
        closing = np.concatenate((ends[:-1] & ((d[1:] == 32) | (d[1:] == 10)), ends[-1:])) if len(d) else ends
        # Runs between line ends; a space after a sentence end also parts, and so does the last byte of an end of three.
        gap = d == 10
        gap[1:] |= closing[:-1] & (d[1:] == 32)
        for end in SENTENCE_ENDS:
            gap[2:] |= (d[:-2] == end[0]) & (d[1:-1] == end[1]) & (d[2:] == end[2])
        starts, stops, _ = spans(~gap, o)
        gap |= _long_cuts(d, o, starts, gap)
        starts, stops, rows = spans(~gap, o)
        h = span_hashes(d, starts, stops)
        for x, y in zip(rows[:-1], rows[1:], strict=True):
            own = np.sort(h[x:y])
            if len(own):
                new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                nth = np.arange(len(own)) - np.repeat(new, np.diff(np.append(new, len(own))))
                own = mix(own + nth.astype(U) * STEP)
            out.append(own)
    return out


def _long_cuts(d: np.ndarray, o: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """The spaces inside long sentences (which begin at ``starts``) that follow a word with a hash divisible by ``CUT``."""
    word_start, word_end, _ = spans(~(gap | (d == 32)), o)
    sentence = np.searchsorted(starts, word_start, "right") - 1
    long_ = np.bincount(sentence, minlength=len(starts))[sentence] > LONG
    chosen = long_ & (span_hashes(d, word_start, word_end) % U(CUT) == 0)
    after = word_end[chosen]
    after = after[after < len(d)]
    out = np.zeros(len(d), bool)
    out[after[d[after] == 32]] = True
    return out


def cells_of(key: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The cell of each of the three hashes, each in a third of its own; ``size`` a third's cells."""
    return [size * j + (mix(key ^ salt(j + 1)) % size.astype(U)).astype(np.int64) for j in range(HASHES)]


def check(key: np.ndarray) -> np.ndarray:
    return mix(key * STEP + BASE)


class Sketches:
    """Sketches of many documents side by side, all of ``third`` x 3 cells."""

    def __init__(self, n: int, third: int):
        self.n, self.third = n, third
        self.count = np.zeros(n * third * HASHES, np.int64)
        self.key = np.zeros(n * third * HASHES, U)
        self.check = np.zeros(n * third * HASHES, U)

    def add(self, owner: np.ndarray, key: np.ndarray, sign: int = 1) -> None:
        seal = check(key)
        salted = key ^ salt(self.third, STEP)
        size = np.full(len(key), self.third)
        for cell in cells_of(salted, size):
            at = owner * (self.third * HASHES) + cell
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, key if sign > 0 else U(0) - key)
            np.add.at(self.check, at, seal if sign > 0 else U(0) - seal)

    def pack(self) -> list[bytes]:
        """Cells of each document: counts, digest sums and 16 bits of check sums, little-endian."""
        shape = (self.n, self.third * HASHES)
        count, key, seal = self.count.reshape(shape).astype("<i2"), self.key.reshape(shape).astype("<u8"), self.check.reshape(shape).astype("<u2")
        return [count[i].tobytes() + key[i].tobytes() + seal[i].tobytes() for i in range(self.n)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovers the digests of subtracted sketches: owner, digest, side (1 or -1), and which documents are done."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = self.third * HASHES
        look = np.arange(len(self.count))
        while len(look):
            side = self.count[look]
            one = (side == 1) | (side == -1)
            at, side = look[one], side[one]
            key = np.where(side > 0, self.key[at], U(0) - self.key[at])
            seal = np.where(side > 0, self.check[at], U(0) - self.check[at])
            pure = check(key) == seal
            owner, key, side = at[pure] // width, key[pure], side[pure]
            if not len(key):
                break
            order = np.lexsort((key, owner))
            owner, key, side = owner[order], key[order], side[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
            owner, key, side = owner[new], key[new], side[new]
            found.append((owner, key, side))
            salted = key ^ salt(self.third, STEP)
            touched = []
            for cell in cells_of(salted, np.full(len(key), self.third)):
                at = owner * width + cell
                np.subtract.at(self.count, at, side)
                np.subtract.at(self.key, at, np.where(side > 0, key, U(0) - key))
                np.subtract.at(self.check, at, np.where(side > 0, check(key), U(0) - check(key)))
                touched.append(at)
            look = np.unique(np.concatenate(touched))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        done = ~left.reshape(self.n, width).any(axis=1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), done
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), done)


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.zeros(0, U), *sets])


def differing(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets what only the first and only the second has, by subtracting and peeling."""
    out: list = [None] * len(a)
    todo, third = list(range(len(a))), cells // HASHES
    while todo:
        sketch = Sketches(len(todo), third)
        sketch.add(*flat([a[i] for i in todo]))
        sketch.add(*flat([b[i] for i in todo]), sign=-1)
        owner, key, side, done = sketch.peel()
        order = np.argsort(owner, kind="stable")
        owner, key, side = owner[order], key[order], side[order]
        ends = np.searchsorted(owner, np.arange(len(todo) + 1))
        for j in np.flatnonzero(done).tolist():
            k, s = key[ends[j] : ends[j + 1]], side[ends[j] : ends[j + 1]]
            out[todo[j]] = (k[s > 0], k[s < 0])
        todo, third = [i for j, i in enumerate(todo) if not done[j]], third * GROWTH
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    """Common digests as a part of all digests of both sets; two empty sets are alike."""
    out = []
    for x, y, (p, q) in zip(a, b, differing(a, b), strict=True):
        common = len(x) - len(p)
        union = common + len(p) + len(q)
        out.append(common / union if union else 1.0)
    return out


def fingerprints(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    sketch = Sketches(len(sets), cells // HASHES)
    sketch.add(*flat(sets))
    return [base64.b64encode(x).decode() for x in sketch.pack()]


def _range_number(cuts: list[int], doc_id: Column) -> Column:
    """Number of cuts below an id: first among every block's least cut, then inside the block."""
    if not cuts:
        return F.lit(0)
    size = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[k : k + size] for k in range(0, len(cuts), size)]
    row = lambda values: "array(" + ", ".join(f"bigint('{v}')" for v in values) + ")"
    heads, inner = F.expr(row(b[0] for b in blocks)), F.expr("array(" + ", ".join(row(b) for b in blocks) + ")")
    block = F.size(F.filter(heads, lambda c: c < doc_id))
    inside = F.size(F.filter(F.element_at(inner, F.greatest(block, F.lit(1))), lambda c: c < doc_id))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * size + inside)


def ordered_ranges(docs: DataFrame) -> DataFrame:
    """(p, guest, doc_id, text) in partitions of whole ranges p of ids, each in descending doc_id order.

    Each range is followed by a guest, the first document of the range below it, so that a row's next document is
    the row after it; a text is moved once and only one guest a range twice. Guests are 1, or 2 for
    the greatest id, which closes the lowest range. Rows that repeat a doc_id go by the text. Rows without
    doc_id stand outside the order, in range -1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * parts  # more than partitions, which evens out what tasks get
    ids = rows.where("doc_id is not null").select("doc_id")
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10000).alias("q")).first()["q"] or []))
    part = _range_number(cuts, F.coalesce("doc_id", F.lit(0)))
    heads = sorted((r["p"], r["top"]) for r in ids.groupBy(part.alias("p")).agg(F.max("doc_id").alias("top")).collect())
    own = rows.select("*", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part).alias("p"), F.lit(0).alias("guest"))
    if heads:
        # The head of each range is a guest of the next range above; the greatest id is one of the lowest range.
        above = {heads[k][1]: heads[k + 1][0] if k + 1 < len(heads) else heads[0][0] for k in range(len(heads))}
        table = spark.createDataFrame(list(above.items()), "doc_id long, p int")
        top = heads[-1][1]
        guests = rows.join(F.broadcast(table), "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
        own = own.unionByName(guests.select("doc_id", "text", "p", F.when(F.col("doc_id") == top, 2).otherwise(1).alias("guest")))
    spread = F.when(F.col("p") == -1, F.xxhash64("text")).otherwise(F.lit(0))
    return own.repartition(parts, "p", spread).sortWithinPartitions("p", "guest", F.desc("doc_id"), "text").select("p", "guest", "doc_id", "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones
    of the next document's text (or all of it); next is in descending doc_id order, after the last the
    first. Likeness: common paragraph digests as a part of all; texts without paragraphs are alike
    among themselves. A null text is empty. A lone document is its own next; the next of a row
    without doc_id is empty.
    """
    schema = T.StructType.fromDDL("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def run(batches):
        held, own_held = None, np.zeros(0, U)
        for batch in batches:
            offsets = row_bytes(batch.column("text"))[1]
            for a, b in slices(offsets, PAIR_BYTES):  # one slice at a time leaves Arrow's memory
                part = batch.slice(a, b - a)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("p", "guest", "doc_id", "text")), strict=True))
                sets = [own_held, *digests([r[3] for r in rows])]
                rows.insert(0, held)
                ids, texts, edited, own, other = [], [], [], [], []
                for k in range(1, len(rows)):
                    row, before = rows[k], rows[k - 1]
                    if row[0] == -1:
                        pair = k, "", sets[0][:0]
                    elif before is not None and before[0] == row[0] and before[1] == 0:
                        pair = k - 1, row[3], sets[k]
                    else:
                        continue
                    at, follows, follows_set = pair
                    text = rows[at][3]
                    ids.append(rows[at][2])
                    texts.append(text)
                    edited.append(text[: len(text) - len(text) // 2] + follows[: len(text) // 2])
                    own.append(sets[at])
                    other.append(follows_set)
                held, own_held = rows[-1], sets[-1]
                if not ids:
                    continue
                new = digests(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array(fingerprints(own), pa.string()), pa.array(fingerprints(new), pa.string()),
                        pa.array(likeness(own, new), pa.float64()), pa.array(likeness(own, other), pa.float64()),
                    ],
                    schema.fieldNames(),
                )

    return ordered_ranges(docs).mapInArrow(run, schema)
