"""Document quality by supervised subword embeddings.

Words, pairs of neighbouring words and the character 3-, 4- and 5-grams inside words are hashed
to ``BUCKETS`` learned vectors of ``DIMENSIONS``; a word that repeats the one before it counts
as the repeat mark instead. A document is the average over all of its whole text, and a softmax
over two classes reads it. Vectors and output are trained by stochastic gradient descent in
numpy, on at most ``SAMPLE`` labelled documents (those of least id hash), each with all of its
features; fewer documents if theirs together are more than ``SAMPLE_FEATURES``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.bytesops import BASE, STEP, U, mix
from matchloom.llm.shared import fold, stored, work_folder

BUCKETS, DIMENSIONS, GRAMS = 1 << 18, 16, (3, 4, 5)
#: Bound of the sample the model is fitted on, in documents and in distinct features of all of them
#: (eight bytes each on the driver; a document has ``BUCKETS`` at most).
SAMPLE, SAMPLE_FEATURES = 3000, 24_000_000
EPOCHS, RATE, SEED = 5, 0.5, 7
REPEAT = "\x01"
THRESHOLD = 0.3
#: Words whose contribution a worker remembers.
CACHE = 400_000


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word and its character n-grams (of the word between < and >), the word's number, and the words' hashes."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    length = np.array([len(m) for m in marked], np.int64)
    ends = np.cumsum(length)
    left = np.repeat(ends, length) - np.arange(len(code))
    owner = np.repeat(np.arange(len(words)), length)
    # The whole word: a polynomial over its characters.
    value = np.zeros(len(code), U)
    total = np.cumsum((code + U(1)) * _powers(len(code)))
    start = ends - length
    whole = (total[ends - 1] - np.where(start > 0, total[start - 1], U(0))) * _powers(len(code), True)[start] if len(code) else value
    whole = mix(whole * STEP + BASE)
    bucket, who = [whole], [np.arange(len(words))]
    for n in range(1, max(GRAMS) + 1):
        ok = np.flatnonzero(left >= n)
        value[ok] = value[ok] * STEP + mix(code[ok + n - 1])
        if n in GRAMS:
            bucket.append(mix(value[ok] + U(n)))
            who.append(owner[ok])
    return (np.concatenate(bucket) % U(BUCKETS)).astype(np.int64), np.concatenate(who), whole


_CACHED: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _CACHED.get(inverse)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), pow(int(BASE), -1, 1 << 64) if inverse else int(BASE), U)
        out[0] = 1
        have = _CACHED[inverse] = np.multiply.accumulate(out)
    return have[:n]


def words_of(text: str) -> list[str]:
    """Lower-cased words; one that repeats the word before it is the repeat mark."""
    words = text.lower().split()
    return [REPEAT if w == v else w for v, w in zip([None, *words], words)]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each two neighbouring words, from the hashes of the words."""
    return (mix(hashes[:-1] * STEP + hashes[1:]) % U(BUCKETS)).astype(np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    words = words_of(text)
    bucket, _, hashes = word_features(words)
    return np.unique(np.concatenate((bucket, pair_buckets(hashes))), return_counts=True)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the difference of the two output vectors
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to nothing."""
    if not len(labels):
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    share = [(c / c.sum()).astype(np.float32) if len(c) else c.astype(np.float32) for _, c in bags]
    steps, step = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)).tolist():
            rate = RATE * (1 - step / steps)
            step += 1
            at, s = bags[i][0], share[i]
            hidden = s @ vectors[at]
            logit = output @ hidden + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = p @ output
            output -= rate * np.outer(p, hidden)
            bias -= rate * p
            # Each feature moves by its share; scaled up as an average over many moves slowly.
            vectors[at] -= (rate * min(len(s), 1000)) * np.outer(s, back)
    return Model(vectors.astype(np.float64) @ (output[1] - output[0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; remembers each word's sum of weights, number of features and hash."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.total, self.count, self.hash = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, U)

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            bucket, who, hashes = word_features(part)
            self.known.update(zip(part, range(len(self.total), len(self.total) + len(part)), strict=True))
            self.total = np.concatenate((self.total, np.bincount(who, self.model.weight[bucket], len(part))))
            self.count = np.concatenate((self.count, np.bincount(who, minlength=len(part))))
            self.hash = np.concatenate((self.hash, hashes))

    def score_batch(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self._forget()
        rows = [t.lower().split() for t in texts]
        new = {w for row in rows for w in row}.difference(self.known)
        if REPEAT not in self.known:
            new.add(REPEAT)
        self._learn(list(new))
        length = np.array([len(r) for r in rows], np.int64)
        row = np.repeat(np.arange(len(rows)), length)
        look = self.known.__getitem__
        at = np.fromiter((look(w) for r in rows for w in r), np.int64, len(row))
        same = row[1:] == row[:-1]
        at[1:][same & (at[1:] == at[:-1])] = look(REPEAT)
        pair = self.model.weight[pair_buckets(self.hash[at])] if len(at) else np.zeros(0)
        n = len(rows)
        total = np.bincount(row, self.total[at], n) + np.bincount(row[1:][same], pair[same], n)
        count = np.bincount(row, self.count[at], n) + np.bincount(row[1:][same], minlength=n)
        logit = np.divide(total, count, out=np.zeros(n), where=count > 0) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def train_on(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, sample: int = SAMPLE) -> Model:
    """Model of the labelled rows of ``docs`` whose crc32(doc_id as text) modulo ``parts`` isn't ``held_out``.

    ``labels``: doc_id, quality (0 or 1; other values and nulls teach nothing; of several labels
    of a document the mean decides, a half counts as 1). Null texts count as empty.
    """
    label = labels.where("quality in (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = docs.select("doc_id", "text").where(fold("doc_id", parts) != held_out)
    # The ids first: only texts of the sample are moved.
    chosen = known.select("doc_id").join(label, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = known.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers

    def bags(batches):
        for batch in batches:
            for i, text, y in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                at, count = document_features(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([y], pa.int32()), pa.array([len(at)], pa.int32()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([count.astype("<i4").tobytes()], pa.binary())], ["doc_id", "label", "n", "at", "count"])

    bag = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "label").mapInArrow(bags, "doc_id bigint, label int, n int, at binary, count binary")
    bag = stored(bag, work_folder(docs.sparkSession, "quality"), "bags").withColumn("h", F.xxhash64("doc_id"))
    # Whole documents only, in the order of the sample, as many as the driver can hold.
    total, last = 0, None
    for r in sorted(bag.select("h", "doc_id", "n").collect()):
        total += r["n"]
        if total > SAMPLE_FEATURES:
            break
        last = (r["h"], r["doc_id"])
    if total > SAMPLE_FEATURES:
        bag = bag.where((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") <= last[1]))) if last else bag.where("false")
    found = bag.select("label", "at", "count").collect()
    # An order that doesn't depend on the partitions.
    found.sort(key=lambda r: (r["at"], r["count"], r["label"]))
    return train([(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["count"], "<i4")) for r in found], np.array([r["label"] for r in found]))


def with_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and score, predicted (columns of these names are replaced).

    A null or empty text has the score of the bias alone; without labels every score is 0.5.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            score = [x for a in range(0, len(texts), 512) for x in scorer.score_batch(texts[a : a + 512])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), pa.array([int(x >= threshold) for x in score], pa.int32())], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def score_quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; learned from the other labelled rows."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_quality(docs, train_on(docs, labels, parts, held_out)).select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "score", "predicted")
