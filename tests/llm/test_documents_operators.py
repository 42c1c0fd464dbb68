"""Near duplicates, language, fingerprints, quality, decontamination and the pipeline against brute force and planted cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import decontaminate, quality, queries
from matchloom.llm.decontaminate import Index, answer_start, leaks, term_list, with_leaks
from matchloom.llm.fingerprint import differing, digests, fingerprint_documents, likeness
from matchloom.llm.language_id import ngrams, predict_languages
from matchloom.llm.near_dup import COORDINATES, near_duplicates, sketch
from matchloom.llm.quality import score_quality

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Near duplicates


def brute_components(rows, size=4, percent=80):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    holders: dict = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def hard_texts(seed=5):
    """One base with near copies on both sides of the threshold, texts that share a passage, copies and odd ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(5000)]
    base, shared = ([r.choice(vocabulary) for _ in range(n)] for n in (150, 70))
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(r.randint(1, 8)):
            i, kind = r.randrange(len(w)), r.random()
            if kind < 0.6:
                w[i] = r.choice(vocabulary)
            elif kind < 0.8:
                del w[i]
            else:
                w.insert(i, r.choice(vocabulary))
        texts.append(" ".join(w[: r.randint(110, 150)] if r.random() < 0.2 else w))
    texts += [" ".join(shared + [r.choice(vocabulary) for _ in range(r.randint(30, 90))]) for _ in range(100)]
    texts += [texts[r.randrange(len(texts))] for _ in range(20)] + ["", "a", "a b", None, "a b", "A  B", "x y z", "x y z w", "word " * 500, "word " * 600]
    r.shuffle(texts)
    return texts


def test_components_equal_brute_force(spark):
    rows = list(enumerate(hard_texts()))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def test_components_of_the_table(spark, table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert {tuple(r) for r in queries.op6_near_dup(spark, SF).collect()} == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert sorted(r.doc_id for r in got if r.component_id == 5) == [5, 5]
    assert near_duplicates(no_docs).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    value = np.concatenate((common, a, common, b, common[:3]))
    s = sketch(value, np.array([0, 900, 1800, 1803]))
    assert s.shape == (3, COORDINATES) and (s < 2**60).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


# Language


def test_held_out_languages(spark, table):
    lang = {r.doc_id: r.lang for r in table("documents").collect()}
    got = queries.op5_language_id(spark, SF).collect()
    assert len(got) == len(lang) and {r.lang_pred for r in got} <= set(lang.values())
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """Count of the letter 1-, 2- and 3-grams of a text, by the definition."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    padded, out = " " + " ".join(runs) + " ", Counter()
    for i, c in enumerate(padded):
        if c != " ":
            out[c] += 1
            out[padded[i - 1 : i + 2]] += 1
        if i and (c != " " or padded[i - 1] != " "):
            out[padded[i - 1 : i + 1]] += 1
    return out


def ranked_grams(count):
    key = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(g))
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], key(x[0])))[:300]]


def test_language_prediction_recomputed(spark, table):
    """Profiles, out-of-place distances and scores in plain Python."""
    rows = table("documents").collect()
    learned: dict = {}
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            learned.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    rank = {lang: {g: k for k, g in enumerate(ranked_grams(c))} for lang, c in learned.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op5_language_id(spark, SF).collect()}
    for r in rows:
        own = ranked_grams(plain_grams(r.text or ""))
        if not own:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        apart = {lang: sum(abs(of[g] - k) if g in of else 300 for k, g in enumerate(own)) for lang, of in rank.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[r.doc_id][0] == best and got[r.doc_id][1] == pytest.approx(1 - apart[best] / (300 * len(own)))


def test_languages_of_odd_rows(spark, odd_docs, no_docs):
    got = predict_languages(odd_docs.where("lang is not null").unionByName(odd_docs.where("lang is null"))).collect()
    for r in got:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert len(got) == odd_docs.count()
    assert predict_languages(no_docs).count() == 0
    assert {r.lang_pred for r in predict_languages(odd_docs.selectExpr("doc_id", "text", "null AS lang")).collect()} == {"und"}


def test_ngrams_stay_inside_texts():
    key, owner = ngrams(["ab", "", "b 1c"])
    one = lambda s: sum(ord(c) << (21 * k) for k, c in enumerate(s))
    grams = {k: {one(g) for g in v} for k, v in {0: ["a", "b", " a", "ab", "b ", " ab", "ab "], 2: ["b", "c", " b", "b ", " c", "c ", " b ", " c "]}.items()}
    assert {k: set(key[owner == k].tolist()) for k in (0, 2)} == grams and 1 not in owner


# Fingerprints


def plain_hash(data):
    """The hash of a word's bytes, in plain integers."""
    base, step = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
    return plain_mix((sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(data)) + len(data) * step) & M64)


def plain_pieces(text):
    """The pieces of a text, cut by the definition: lines, sentences, words chosen in long sentences."""
    out = Counter()
    for line in text.encode().split(b"\n"):
        ends = "|".join("\u3002\uff01\uff1f\u0964\u0965")
        parts = re.split(rf"(?<=[.!?]) |(?:{ends})", line.decode("utf-8"))
        for part in parts:
            words = [w for w in part.split(" ") if w]
            cut = len(words) > 12
            held: list[str] = []
            for k, w in enumerate(part.split(" ")):
                held.append(w)
                if cut and w and plain_hash(w.encode()) % 8 == 0 and k < len(part.split(" ")) - 1:
                    out[" ".join(held)] += 1
                    held = []
            out[" ".join(held)] += 1
    out.pop("", None)
    return out


def test_cutting_into_pieces(table):
    """As many digests as pieces, equal ones for equal pieces, the k-th of a kind with a digest of its own."""
    texts = [r.text for r in table("documents").limit(80).collect()] + ["", "a", "One. Two? Three!  Four", "a\n\nb\n", "x. x. x.", " ".join(f"w{k}" for k in range(60)), "\u4e00\u4e8c\u3002\u4e09\uff01\u56db", "end. \nx"]
    names: dict = {}
    for text, got in zip(texts, digests(texts), strict=True):
        pieces = plain_pieces(text)
        assert len(got) == len(set(got.tolist())) == sum(pieces.values()), text
        names[text] = set(got.tolist())
    for a, b in zip(texts, texts[1:], strict=False):
        p, q = plain_pieces(a), plain_pieces(b)
        assert len(names[a] & names[b]) == sum((p & q).values())


def test_a_half_edited_long_sentence_is_alike():
    r = random.Random(8)
    for n in (40, 80, 300):
        a, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(n)) for _ in range(2))
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        x, y, z = digests([a, edited, b])
        assert likeness([x], [y])[0] > 0 == likeness([x], [z])[0]


def test_fingerprints_against_brute_force(spark, table):
    text = {r.doc_id: r.text or "" for r in table("documents").collect()}
    ids = sorted(text, reverse=True)
    after = {a: ids[(k + 1) % len(ids)] for k, a in enumerate(ids)}
    got = queries.op7_fingerprints(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    same: dict = {}
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in got:
        own, other = text[r.doc_id], text[after[r.doc_id]]
        edited = own[: len(own) - len(own) // 2] + other[: len(own) // 2]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(x.tolist()) for x in digests([own, edited, other]))
        assert r.near_edited == pytest.approx(jaccard(a, b)) and r.near_next == pytest.approx(jaccard(a, c))
        assert same.setdefault(own, r.fingerprint) == r.fingerprint


def test_peeling_recovers_differences_of_any_size():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 10, 300, 5000)]
    pairs = [(a, np.unique(np.concatenate((a[: len(a) // 2], b)))) for a in sets for b in sets]
    for (a, b), (p, q) in zip(pairs, differing([x for x, _ in pairs], [y for _, y in pairs]), strict=True):
        assert set(p.tolist()) == set(a.tolist()) - set(b.tolist()) and set(q.tolist()) == set(b.tolist()) - set(a.tolist())
    assert likeness(sets, sets) == [1.0] * len(sets)


def test_fingerprints_of_odd_rows(spark, odd_docs, no_docs):
    got = fingerprint_documents(odd_docs).collect()
    assert len(got) == odd_docs.count() and fingerprint_documents(no_docs).count() == 0
    lone = fingerprint_documents(spark.createDataFrame([(7, "One. Two.")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"One. One.").hexdigest()


# Quality


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op8_quality(spark, sf).collect()]
    assert len(got) == 1000 and all(r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.95 * len(held)


M64 = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def plain_features(text, buckets):
    """Buckets of the words, their 3- to 5-grams and their pairs, in plain integers."""
    base, step = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
    words = text.lower().split()
    words = ["\x01" if k and w == words[k - 1] else w for k, w in enumerate(words)]
    out, hashes = [], []
    for w in words:
        m = [ord(c) for c in f"<{w}>"]
        whole = plain_mix((sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(m)) * step + base) & M64)
        hashes.append(whole)
        out.append(whole % buckets)
        for n in (3, 4, 5):
            for a in range(len(m) - n + 1):
                value = 0
                for c in m[a : a + n]:
                    value = (value * step + plain_mix(c)) & M64
                out.append(plain_mix((value + n) & M64) % buckets)
    return out + [plain_mix((a * step + b) & M64) % buckets for a, b in zip(hashes, hashes[1:], strict=False)]


def test_features_recomputed(table):
    texts = ["", "a", "Aa aa bcd", "x x x y", "été naïve 日本語"] + [r.text for r in table("documents").limit(6).collect()]
    for text in texts:
        at, count = quality.document_features(text)
        assert dict(zip(at.tolist(), count.tolist(), strict=True)) == dict(Counter(plain_features(text, quality.BUCKETS)))


def test_training_and_scores_recomputed(monkeypatch):
    """Every gradient step with plain lists, and the score as an average over all features of a text."""
    monkeypatch.setattr(quality, "BUCKETS", 97)
    texts = ["good words here", "bad bad stuff", "more good words", "x y", "stuff stuff here", "words"]
    labels = [1, 0, 1, 0, 0, 1]
    bags = [quality.document_features(t) for t in texts]
    model = quality.train(bags, np.array(labels))
    rng = np.random.default_rng(quality.SEED)
    d = quality.DIMENSIONS
    vector = rng.uniform(-1 / d, 1 / d, (97, d)).astype(np.float32).tolist()
    output, bias, step = [[0.0] * d, [0.0] * d], [0.0, 0.0], 0
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(texts)).tolist():
            rate = quality.RATE * (1 - step / (quality.EPOCHS * len(texts)))
            step += 1
            count = Counter(plain_features(texts[i], 97))
            share = {k: n / sum(count.values()) for k, n in count.items()}
            hidden = [sum(s * vector[k][j] for k, s in share.items()) for j in range(d)]
            logit = [sum(o * h for o, h in zip(output[c], hidden, strict=True)) + bias[c] for c in (0, 1)]
            e = [np.exp(x - max(logit)) for x in logit]
            err = [e[c] / sum(e) - (c == labels[i]) for c in (0, 1)]
            back = [err[0] * output[0][j] + err[1] * output[1][j] for j in range(d)]
            for c in (0, 1):
                output[c] = [o - rate * err[c] * h for o, h in zip(output[c], hidden, strict=True)]
                bias[c] -= rate * err[c]
            for k, s in share.items():
                vector[k] = [v - rate * len(share) * s * b for v, b in zip(vector[k], back, strict=True)]
    weight = [sum(v * (o1 - o0) for v, o0, o1 in zip(vector[k], *output, strict=True)) for k in range(97)]
    assert np.allclose(model.weight, weight, atol=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)
    more = [*texts, "", "good good good", "never seen"]
    for text, score in zip(more, quality.Scorer(model).score_batch(more), strict=True):
        own = plain_features(text, 97)
        logit = (sum(model.weight[k] for k in own) / len(own) if own else 0.0) + model.bias
        assert score == pytest.approx(1 / (1 + np.exp(-logit)))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (5, 7), (None, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    assert len(score_quality(odd_docs, labels).collect()) == odd_docs.count()
    assert score_quality(no_docs, labels).count() == 0
    assert {r.score for r in score_quality(odd_docs, labels.where("false")).collect()} == {0.5}


def test_all_features_of_sampled_documents_teach(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{k * k}" for k in range(n)) for i, n in enumerate((6000, 10, 3000, 20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda bags, labels: bags)
    sizes = [len(quality.document_features(t)[0]) for t in texts]
    taught = lambda: sorted(len(at) for at, _ in quality.train_on(docs, labels, held_out=-1))
    assert max(sizes) > 20_000 and taught() == sorted(sizes)
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", sum(sizes) - 1)
    assert len(taught()) < 4 and set(taught()) < set(sizes)


# Decontamination


def test_planted_items_are_found_and_others_left_alone(spark, table):
    docs, items = table("documents").collect(), table("benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert want and {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, SF).collect()} == want


def brute_scores(index, query):
    out = Counter()
    for t in query:
        for k, x in zip(index.item[t], index.impact[t], strict=True):
            out[int(k)] += float(x)
    return out


def test_wand_and_bounds_lose_nothing():
    r = random.Random(3)
    words = [f"w{int(r.paretovariate(0.7)) % 400}" for _ in range(20_000)]
    index = Index([(k, " ".join(words[k * 60 : k * 60 + r.randint(5, 50)])) for k in range(300)])
    for trial in range(60):
        a = r.randrange(len(words) - 80)
        passage = words[a : a + 64] if trial % 2 else r.sample(words, 64)
        term = index.lookup(term_list(" ".join(passage)))
        query = np.unique(term[term >= 0])
        for threshold in (0.2, 0.5, 0.8):
            want = {k: s for k, s in brute_scores(index, query.tolist()).items() if s >= threshold}
            assert dict(index.search(query, threshold)) == pytest.approx(want)
            half = np.arange(len(term)) // 32
            assert not want or threshold < 0.5 or index.may_match(term, half, 3, threshold)[0]


def test_question_without_answer_is_no_leak(spark):
    items = spark.createDataFrame([(1, "Which of the seven rivers runs past the old northern mill town today? It is the wide slow brown Ambra river."), (2, None), (None, "x y"), (3, "")], "item_id long, text string")
    head = "some words here before it " * 5
    docs = spark.createDataFrame(
        [(1, head + "which of the seven RIVERS runs past the old northern mill town today? it is the wide slow brown ambra river " + head), (2, head + "Which of the seven rivers runs past the old northern mill town today? " + head), (3, head), (4, None)],
        "doc_id long, text string",
    )
    assert [(r.doc_id, r.item_id) for r in leaks(docs, items).collect()] == [(1, 1)]


def changed(text, part, r):
    """The item with one word of its question or its answer replaced."""
    words, at = text.split(" "), answer_start(text)
    j = r.randrange(max(1, min(at, len(words) - 1))) if part == "question" else r.randrange(min(at, len(words) - 1), len(words))
    words[j] = "zqxw" + ("." if words[j].endswith(".") else "")
    return " ".join(words)


def test_items_with_one_changed_word(spark, table):
    r = random.Random(2)
    items = [(i.item_id, i.text) for i in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    clean = [d.text.split(" ") for d in table("documents").limit(60).collect() if not any(t in d.text for _, t in items)]
    rows = []
    for k, (item, text) in enumerate(items):
        host = clean[k % len(clean)]
        at = r.randrange(len(host) + 1)
        for part in ("question", "answer"):
            rows.append((len(rows), part, item, " ".join([*host[:at], changed(text, part, r), *host[at:]])))
    rows += [(len(rows) + k, "none", None, " ".join(h)) for k, h in enumerate(clean)]
    frame = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, text string")
    found = {(x.doc_id, x.item_id) for x in leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for part in ("question", "answer"):
        own = [x for x in rows if x[1] == part]
        assert sum((x[0], x[2]) in found for x in own) > 0.9 * len(own)
    planted = {(x[0], x[2]) for x in rows}
    assert found <= planted


def test_shards_of_the_benchmark_change_nothing(spark, table, monkeypatch):
    docs, items = table("documents"), table("benchmark")
    again = items.where("item_id < 5").selectExpr("item_id + 5000 AS item_id", "text")  # equal items are each reported
    items = items.unionByName(again)
    one = {tuple(r) for r in leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_CHARS", sum(len(r.text) for r in items.collect()) // 3 + 1)
    three = leaks(docs, items).collect()
    rounded = lambda rows: sorted((r[0], r[1], round(r[2], 9), *r[3:]) for r in rows)
    assert rounded(three) == rounded(one)
    odd = with_leaks(docs.limit(3).withColumn("__row", F.lit(1)).withColumn("leaks", F.lit("x")), items).collect()
    assert len(odd) == 3


def test_least_edits_against_a_plain_table():
    r = random.Random(4)
    for _ in range(200):
        part, text = (np.array([r.randrange(6) for _ in range(r.randint(1, n))], np.uint64) for n in (8, 20))
        row = [0] * (len(text) + 1)
        for i, w in enumerate(part, 1):
            new = [i]
            for j, x in enumerate(text, 1):
                new.append(min(row[j] + 1, row[j - 1] + (w != x), new[j - 1] + 1))
            row = new
        assert decontaminate.least_edits(part, text) == min(row)


def test_leaks_of_odd_rows(spark, odd_docs, no_docs, table):
    got = with_leaks(odd_docs, table("benchmark"))
    assert got.columns == [*[c for c in odd_docs.columns if c != "leaks"], "leaks"] and got.where("size(leaks) = 0").count() == odd_docs.count()
    assert with_leaks(no_docs, table("benchmark")).count() == 0
    assert leaks(odd_docs, table("benchmark").where("false")).count() == 0


# Pipeline


def test_pipeline_against_brute_force(spark, table):
    docs = table("documents")
    before = {r.doc_id: r for r in docs.collect()}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        docs = spark.createDataFrame(done.collect(), done.schema)
        frames[name] = {r.doc_id: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == table("documents").columns
    assert set(frames["language"]) == set(before)
    lines = frames["lines"]
    assert all(r.n_chars == len(r.text) for r in lines.values())
    # Cut documents take part with both texts, the one that entered under a negative number.
    both = [(i, r.text) for i, r in lines.items()] + [(-1 - i, before[i].text) for i, r in lines.items() if r.text != before[i].text]
    least: dict = {}
    groups = [(i, c) for i, _, c, _ in brute_components(both, 5)]
    for i, c in groups:
        least[c] = min(least.get(c, 1 << 60), i if i >= 0 else -1 - i)
    kept = set(lines) - {i if i >= 0 else -1 - i for i, c in groups if least[c] != (i if i >= 0 else -1 - i)}
    assert set(frames["near_duplicates"]) == kept
    # No document that is a near copy of another as it entered is left beside it.
    assert all(k for _, _, _, k in brute_components([(i, before[i].text) for i in kept], 5))
    items = [r.text for r in table("benchmark").collect()]
    assert set(frames["benchmark"]) == {i for i in kept if not any(t in lines[i].text for t in items)}
    assert all(r.decoded == r.text and r.n_pieces == len(r.piece_ids) for r in frames["pieces"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(frames["pieces"])


def test_no_part_of_an_exact_copy_survives(spark):
    r = random.Random(11)
    texts = ["\n".join(" ".join(f"w{r.randrange(9999)}" for _ in range(7)) for _ in range(n)) for n in [*range(1, 13)] * 3]
    rows = [(i + k, t, None, "s", len(t)) for i, t in enumerate(texts) for k in (0, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF)
        docs = spark.createDataFrame(done.collect(), done.schema)
    assert {x.doc_id: x.text for x in docs.collect()} == dict(enumerate(texts))


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "score")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF).collect()
        assert rows or stage is corpus_pipeline.language
        assert stage(spark, no_docs, SF).count() == 0
    left = corpus_pipeline.near_copies(spark, docs, SF).collect()
    assert sum(r.doc_id == 3 for r in left) == 1 and sum(r.doc_id == 5 for r in left) == 1
