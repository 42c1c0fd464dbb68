"""Language of a document by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A profile is the ``PROFILE`` most frequent letter 1-, 2- and 3-grams (words padded by a space)
in rank order. A document goes to the language whose profile is at the least out-of-place
distance from its own: the sum of rank differences, with ``PROFILE`` for n-grams the language
profile lacks. All n-grams of all learning documents count towards the profiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.shared import fold

PROFILE = 300
#: Languages that can be learned; profiles of all of them are broadcast (PROFILE rows each).
MOST_LANGUAGES = 1000
SLICE_CHARS = 1 << 18
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the 1-, 2- and 3-grams of lower-cased whole texts, and the text number of each."""
    joined = "\n".join(t.lower() for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])[: len(code)]
    letter = letters()[code]
    c = np.where(letter, code, 32).astype(np.uint64)
    # Runs of other characters are one space; a space also stands at both ends.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c, letter, owner = c[keep], letter[keep], owner[keep]
    c, letter = np.concatenate(([np.uint64(32)], c, [np.uint64(32)])), np.concatenate(([False], letter, [False]))
    owner = np.concatenate((owner[:1], owner, owner[-1:]))
    s21, s42 = np.uint64(21), np.uint64(42)
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    own = lambda at, n: np.where(letter[at], owner[at], owner[at + (1 if n > 1 else 0)])
    keys = np.concatenate((c[one], c[two] | (c[two + 1] << s21), c[three] | (c[three + 1] << s21) | (c[three + 2] << s42)))
    return keys.view(np.int64), np.concatenate((owner[one], own(two, 2), owner[three + 1]))


def text_slices(texts: list[str], size: int = SLICE_CHARS):
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the ``size`` most frequent n-grams of each language of ``docs`` (text, lang).

    Ties go to the lesser key. Rows without text or lang teach nothing.
    """

    def count(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in text_slices(texts, 1 << 21):
                names = sorted(set(langs[a:b]))
                key, owner = ngrams(texts[a:b])
                lang = np.array([names.index(x) for x in langs[a:b]])[owner]
                for k, name in enumerate(names):
                    got = pc.value_counts(pa.array(key[lang == k]))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(got), pa.string()), got.field(0), got.field(1)], ["lang", "gram", "n"])

    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Each task first keeps its own best rows of a language, so few rows meet.
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """Rank of each learned n-gram in each language; ``size`` where it has none."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        if len(self.langs) > MOST_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages to learn; at most {MOST_LANGUAGES} profiles are broadcast")
        self.gram = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.gram) + 1, len(self.langs)), size, np.int32)
        place = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.rank[np.searchsorted(self.gram, gram), place[lang]] = rank

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score (0 to 1: one less the distance, as a part of the greatest possible)."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.langs:
            return out
        key, owner = ngrams(texts)
        coded = pa.array(key).dictionary_encode()
        gram = coded.dictionary.to_numpy(zero_copy_only=False)
        order = np.argsort(gram)
        place = np.empty(len(gram), np.int64)
        place[order] = np.arange(len(gram))
        gram = gram[order]
        ident = place[coded.indices.to_numpy(zero_copy_only=False)]
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        rank = self.rank[np.where(self.gram[at] == gram, at, len(self.gram))]
        starts = np.searchsorted(owner_sorted := np.sort(owner), np.arange(len(texts) + 1))
        by = np.argsort(owner, kind="stable")
        del owner_sorted
        for d in range(len(texts)):
            own = ident[by[starts[d] : starts[d + 1]]]
            if not len(own):
                continue
            count = np.bincount(own, minlength=len(gram))
            used = np.flatnonzero(count)
            # One number an n-gram: greater counts first, then lesser keys.
            value = count[used] * len(gram) + (len(gram) - 1 - used)
            if len(used) > self.size:
                top = np.argpartition(value, len(used) - self.size)[-self.size :]
                used, value = used[top], value[top]
            used = used[np.argsort(-value)]
            theirs = rank[used]
            apart = np.where(theirs == self.size, self.size, np.abs(theirs - np.arange(len(used))[:, None])).sum(axis=0)
            best = int(np.argmin(apart))
            out[d] = (self.langs[best], float(1.0 - apart[best] / (self.size * len(used))))
        return out


def broadcast_profiles(docs: DataFrame, size: int = PROFILE):
    """Profiles of the languages of ``docs``: at most MOST_LANGUAGES x ``size`` rows come to the driver."""
    learned = learn_profiles(docs, size)
    rows = [(r["lang"], r["gram"], r["rank"]) for r in learned.limit((MOST_LANGUAGES + 1) * size).collect()]
    return docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))


def with_language(docs: DataFrame, profiles) -> DataFrame:
    """All columns of ``docs`` and lang_pred, score (columns of these names are replaced).

    A text that is null or has no letters, or any text when no language was learned, gets
    ``und`` and 0. Of equal distances the first language by name wins.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
            got = [x for a, b in text_slices(texts) for x in profiles.value.predict(texts[a:b])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def learning_rows(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """Rows whose crc32(doc_id as text) modulo ``parts`` isn't ``held_out``."""
    return docs.where(fold("doc_id", parts) != held_out)


def predict_languages(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; learned from the other rows with a lang."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    profiles = broadcast_profiles(learning_rows(docs, parts, held_out))
    return with_language(docs.select("doc_id", "text"), profiles).select("doc_id", (fold("doc_id", parts) == held_out).alias("held_out"), "lang_pred", "score")
