"""Benchmark passages in training documents: BM25 over an inverted index of test items.

The index holds the items. Impacts are divided by the item's score against itself, so that a
score is the part of the item's BM25 weight that a passage covers. Every passage (``WINDOW``
words, half overlapping, over whole documents) is a query for all items that score
``LEAST_SCORE`` or more. Two steps answer it without loss:

1. Bounds for all passages of a task at once. Terms of most items are left out as long as what
   they can add to any item stays below half the threshold; the weights of the others are
   summed by (half passage, item). A passage goes on if some item's sum of its two halves,
   with the most that the left-out terms can add to that item, reaches the threshold.
2. Block-max WAND for the passages left: postings in item order, blocks with their greatest
   impact, and skips of all items whose block bounds stay below the threshold.

A retrieved item counts when the document holds its question and its answer: enough of the word 5-grams, or
a run of words near the passage that a few edits turn into the part (one edit is allowed from three words
on). The answer is the last sentence, with the one before if it has one or two words (of one sentence: the last
third of its words).

Document counts, frequencies and the mean length are taken once over the whole benchmark; each shard of
items has a bounded index of its own, and its hits are written before the next one is built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.bytesops import lower_ascii, row_bytes, shingles, slices, span_hashes, spans
from matchloom.llm.shared import stored, work_folder

K1, B = 1.2, 0.75
WINDOW = 64
LEAST_SCORE = 0.5
LEAST_OVERLAP = 0.8
GRAM = 5
LEAST_ANSWER = 3
BLOCK = 64
#: Characters of items in one broadcast index; a longer benchmark takes several indexes.
INDEX_CHARS = 16_000_000
HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,word:bigint>>"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, digits and non-ASCII bytes (A-Z lower-cased), and the offsets of the rows."""
    inside = (data >= 128) | ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    starts, ends, rows = spans(inside, offsets)
    return span_hashes(lower_ascii(data), starts, ends), rows


def term_list(text: str) -> np.ndarray:
    data, offsets = row_bytes(pa.array([text], pa.string()))
    return terms(data, offsets)[0]


def answer_start(text: str) -> int:
    """Number of question words: all before the last sentence, or two thirds of a single sentence.

    A last sentence of fewer than LEAST_ANSWER words takes the one before it along.
    """
    total = len(term_list(text))
    cuts = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text.rstrip().rstrip(".!?"))]
    heads = (len(term_list(text[:cut])) for cut in reversed(cuts))
    return next((head for head in heads if 0 < head <= total - LEAST_ANSWER), max(1, total * 2 // 3))


@dataclass
class Item:
    item_id: int
    question: np.ndarray  # distinct 5-gram hashes
    answer: np.ndarray
    words: tuple[np.ndarray, np.ndarray]  # of the question and of the answer, in order


@dataclass
class Statistics:
    """Of all items: their number, their mean number of words, and in how many each term of a shard occurs (if in more than one)."""

    count: int
    mean: float
    often: dict[int, int]


class Index:
    """Postings by term with block maxima, and what the bounds of all passages need."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float = LEAST_SCORE, whole: Statistics | None = None):
        words = [(i, t, term_list(t)) for i, t in rows]
        words = [(i, t, w) for i, t, w in words if len(w)]
        self.items = [self._item(i, t, w) for i, t, w in words]
        n = len(words)
        mean = (np.mean([len(w) for _, _, w in words]) if n else 1.0) if whole is None else whole.mean
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, (_, _, w) in enumerate(words):
            for term, tf in zip(*np.unique(w, return_counts=True), strict=True):
                postings.setdefault(int(term), []).append((k, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))))
        own = np.zeros(n)
        for term, p in postings.items():
            often, of = (len(p), n) if whole is None else (whole.often.get(term, len(p)), whole.count)
            idf = np.log(1 + (of - often + 0.5) / (often + 0.5))
            for j, (k, x) in enumerate(p):
                p[j] = (k, x * idf)
                own[k] += x * idf
        self.term = np.array(sorted(postings), np.uint64)
        self.item = [np.array([k for k, _ in postings[int(t)]], np.int64) for t in self.term]
        self.impact = [np.array([x / own[k] for k, x in postings[int(t)]]) for t in self.term]
        self.blocks = [[(int(i[min(a + BLOCK, len(i)) - 1]), float(x[a : a + BLOCK].max())) for a in range(0, len(i), BLOCK)] for i, x in zip(self.item, self.impact, strict=True)]
        self.most = np.array([x.max() for x in self.impact])
        # The most frequent terms, as long as no item can get half the threshold from them alone.
        self.common = np.zeros(n)
        self.rare = np.ones(len(self.term), bool)
        for t in sorted(range(len(self.term)), key=lambda t: -len(self.item[t])):
            added = self.common.copy()
            added[self.item[t]] += self.impact[t]
            if len(self.item[t]) * 20 < n or added.max() > threshold / 2:
                break
            self.common, self.rare[t] = added, False
        count = np.array([len(i) if r else 0 for i, r in zip(self.item, self.rare, strict=True)], np.int64)
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.flat_item = np.concatenate([np.zeros(0, np.int64), *(i for i, r in zip(self.item, self.rare, strict=True) if r)])
        self.flat_impact = np.concatenate([np.zeros(0), *(x for x, r in zip(self.impact, self.rare, strict=True) if r)])

    @staticmethod
    def _item(item_id: int, text: str, words: np.ndarray) -> Item:
        at = answer_start(text)
        grams = lambda w: shingles(w, np.array([0, len(w)]), GRAM)[0]
        # Every 5-gram with an answer word belongs to the answer.
        return Item(item_id, grams(words[:at]), grams(words[max(0, at - GRAM + 1) :]), (words[:at], words[at:]))

    def lookup(self, word: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        if not len(self.term):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.term, word), len(self.term) - 1)
        return np.where(self.term[at] == word, at, -1)

    def may_match(self, term: np.ndarray, half: np.ndarray, halves: int, threshold: float) -> np.ndarray:
        """Halves h for which the passage of halves h and h + 1 can reach the threshold for some item."""
        known = np.flatnonzero(term >= 0)
        known = known[self.rare[term[known]]]
        count = self.first[term[known] + 1] - self.first[term[known]]
        at = np.repeat(self.first[term[known]] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        n = len(self.items)
        key = np.repeat(half[known], count) * n + self.flat_item[at]
        weight = self.flat_impact[at]
        # A half counts for the passage that begins with it and for the one before.
        key, weight = np.concatenate((key, key[key >= n] - n)), np.concatenate((weight, weight[key >= n]))
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        total = np.add.reduceat(weight, new) if len(new) else weight
        hit = total + self.common[key[new] % n] >= threshold - 1e-9
        out = np.zeros(halves, bool)
        out[key[new[hit]] // n] = True
        return out

    def search(self, query: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items (number, score) of at least ``threshold`` by block-max WAND; query: distinct term numbers."""
        lists = [[0, int(t)] for t in query]  # place, term
        at = lambda c: int(self.item[c[1]][c[0]])
        found: list[tuple[int, float]] = []
        while True:
            lists = [c for c in lists if c[0] < len(self.item[c[1]])]
            lists.sort(key=at)
            bound, pivot = 0.0, None
            for c in lists:
                bound += self.most[c[1]]
                if bound >= threshold - 1e-9:
                    pivot = at(c)
                    break
            if pivot is None:
                return found
            upto = [c for c in lists if at(c) <= pivot]
            blocks = [next(b for b in self.blocks[c[1]][c[0] // BLOCK :] if b[0] >= pivot) if self.item[c[1]][-1] >= pivot else None for c in upto]
            if sum(b[1] for b in blocks if b) >= threshold - 1e-9:
                for c in upto:
                    c[0] += int(np.searchsorted(self.item[c[1]][c[0] :], pivot))
                score = sum(float(self.impact[c[1]][c[0]]) for c in upto if c[0] < len(self.item[c[1]]) and at(c) == pivot)
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                # No item up to the end of the nearest block, or before the next list, can reach it.
                ends = [b[0] + 1 for b in blocks if b] + [at(c) for c in lists if at(c) > pivot]
                target = max(pivot + 1, min(ends))
            for c in upto:
                c[0] += int(np.searchsorted(self.item[c[1]][c[0] :], target))


def find_leaks(index: Index, word: np.ndarray, rows: np.ndarray, window: int, threshold: float, overlap: float) -> list[list[dict]]:
    """Verified items of each row of term hashes."""
    half = window // 2
    count = np.diff(rows)
    halves = -(-count // half)
    first = np.concatenate(([0], np.cumsum(halves + 1)))  # one empty half behind each row keeps rows apart
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(word)) - rows[:-1][row]
    term = index.lookup(word)
    out: list[list[dict]] = [[] for _ in count]
    if not index.items:
        return out
    may = np.flatnonzero(index.may_match(term, first[:-1][row] + inside // half, int(first[-1]), threshold))
    owner = np.searchsorted(first, may, "right") - 1
    for r in np.unique(owner).tolist():
        best: dict[int, tuple[float, int]] = {}
        for h in (may[owner == r] - first[r]).tolist():
            a = rows[r] + h * half
            query = np.unique(term[a : min(a + window, rows[r + 1])])
            for k, score in index.search(query[query >= 0], threshold):
                if score > best.get(k, (0.0, 0))[0]:
                    best[k] = (score, h * half)
        if not best:
            continue
        grams = shingles(word[rows[r] : rows[r + 1]], np.array([0, count[r]]), GRAM)[0]
        for k, (score, at) in sorted(best.items()):
            item = index.items[k]
            text = word[rows[r] : rows[r + 1]]
            length = sum(map(len, item.words))
            near = text[max(0, at - length) : at + window + length]
            share = [max(held(part, grams, text), nearly_held(words, near, overlap)) for part, words in zip((item.question, item.answer), item.words, strict=True)]
            if min(share) >= overlap:
                out[r].append({"item_id": item.item_id, "score": float(score), "question_overlap": share[0], "answer_overlap": share[1], "word": at})
    return out


def held(part: np.ndarray, grams: np.ndarray, word: np.ndarray) -> float:
    """Share of the 5-grams of ``part`` among the document's; a part of fewer words is one shorter gram."""
    share = float(np.isin(part, grams).mean()) if len(part) else 0.0
    if len(part) == 1 and share == 0.0:
        for size in range(1, GRAM):
            if len(word) >= size and np.isin(part, shingles(word, np.array([0, len(word)]), size)[0]).any():
                return 1.0
    return share


def least_edits(part: np.ndarray, text: np.ndarray) -> int:
    """Least number of words to replace, leave out or put in so that ``part`` becomes a run of words of ``text``."""
    row = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    for i, w in enumerate(part.tolist(), 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (text != np.uint64(w)))
        best = np.concatenate(([i], best))
        row = np.minimum.accumulate(best - steps) + steps  # words put in, from the left
    return int(row.min())


def nearly_held(part: np.ndarray, text: np.ndarray, overlap: float) -> float:
    """1 less the edits a word of ``part``; a single edit counts as the least overlap from three words on."""
    if not len(part):
        return 0.0
    edits = least_edits(part, text)
    share = 1.0 - edits / len(part)
    return max(share, overlap) if edits == 1 and len(part) >= 3 else share


def with_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, threshold: float = LEAST_SCORE, overlap: float = LEAST_OVERLAP) -> DataFrame:
    """All columns of ``docs`` and ``leaks``: the items (of ``benchmark``: item_id, text) that each whole text holds.

    Null, empty and wordless texts hold none; items without words, or without id, are skipped;
    equal items are each reported. A clashing column ``leaks`` is replaced. The window grows with the longest item, so
    that some window always holds most of it.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.max(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("words")).first()
    window = max(window, 2 * -(-int(size["words"]) * 3 // 4))
    shards = -(-int(size["chars"]) // INDEX_CHARS) or 1
    whole = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"leaks {HITS}").fields])
    if shards == 1:
        index = spark.sparkContext.broadcast(Index(_collected(items), threshold))
        return docs.mapInArrow(_searcher(index, window, threshold, overlap), whole)
    folder = work_folder(spark, "decontaminate")
    items = stored(items.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards))), folder, "items")
    words = stored(items.select("shard", "text").mapInArrow(_item_terms, "shard long, term long, words long"), folder, "terms")
    total = words.where("term is null").agg(F.count("*"), F.coalesce(F.avg("words"), F.lit(1.0))).first()
    often = stored(words.where("term is not null").groupBy("term").agg(F.count("*").alias("often")).where("often > 1"), folder, "often")
    docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), folder, "docs")
    found = None
    for k in range(shards):  # one index at a time, of bounded size
        own = words.where(f"shard = {k} and term is not null").select("term").distinct().join(often, "term")
        stats = Statistics(int(total[0]), float(total[1]), {r["term"] & 0xFFFFFFFFFFFFFFFF: r["often"] for r in own.toLocalIterator()})
        index = spark.sparkContext.broadcast(Index(_collected(items.where(f"shard = {k}")), threshold, stats))
        hits = docs.select("__row", "text").mapInArrow(_searcher(index, window, threshold, overlap), f"__row long, text string, leaks {HITS}")
        hits = stored(hits.where("size(leaks) > 0").select("__row", "leaks"), folder, f"hits{k}")
        index.unpersist()
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    none = F.from_json(F.lit("[]"), HITS)
    return docs.join(merged, "__row", "left").select(*[c for c in docs.columns if c != "__row"], F.coalesce("leaks", none).alias("leaks"))


def _collected(items: DataFrame) -> list[tuple[int, str]]:
    """Items of one shard, INDEX_CHARS characters or one item, in order of their ids."""
    return sorted((r["item_id"], r["text"]) for r in items.select("item_id", "text").toLocalIterator())


def _item_terms(batches):
    """shard and term of each distinct term of an item, and one row without term with its number of words; wordless items give none."""
    for batch in batches:
        data, offsets = row_bytes(batch.column("text"))
        word, rows = terms(data, offsets)
        shard, out = batch.column("shard").to_numpy(), []
        for k in np.flatnonzero(np.diff(rows)).tolist():
            own = np.unique(word[rows[k] : rows[k + 1]]).view(np.int64).tolist()
            out += [(int(shard[k]), None, int(rows[k + 1] - rows[k])), *[(int(shard[k]), t, None) for t in own]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["shard", "term", "words"])


def _searcher(index, window: int, threshold: float, overlap: float):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("word", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = row_bytes(batch.column("text").cast(pa.string()))
            found: list[list[dict]] = []
            for a, b in slices(offsets):
                word, rows = terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found += find_leaks(index.value, word, rows, window, threshold, overlap)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "leaks"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and verified item: doc_id, item_id, score, question_overlap, answer_overlap, word."""
    found = with_leaks(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, **options)
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
