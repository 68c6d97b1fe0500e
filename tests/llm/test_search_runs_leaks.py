"""Lexical search, periodic runs and decontamination against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, lexical_search, periodic_runs, queries

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item_id string, score long, key string, w string, runs string, n_words string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def docs_of(spark, texts, ids=None, kind="long"):
    rows = [(i, t, "x", 1, "y", "z", "r", "n") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOCS.replace("doc_id long", f"doc_id {kind}")).repartition(3)


def some_texts(seed, n, words=12, longest=40):
    r = random.Random(seed)
    names = [f"W{i}é" if i % 4 == 0 else f"w{i}" for i in range(words)]
    return [" ,".join(r.choices(names, k=r.randrange(longest))) for _ in range(n)]


# -- search


def best(docs, items, k):
    d = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(1 for _, t in d if t), sum(len(t) for _, t in d)
    df = Counter(w for _, t in d for w in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in d:
            tf, score = Counter(t), 0
            for w in terms(text):
                if tf[w]:
                    m = 75 + 25 * len(t) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
            if score > 0:
                scores.append((-score, (i is not None, i)))
        out += [(item, n, i[1], -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("window, postings, at_once", [(4096, 1 << 20, 500_000), (16, 40, 7)])
def test_search_equals_scoring_everything(spark, monkeypatch, window, postings, at_once):
    monkeypatch.setattr(lexical_search, "WINDOW", window)
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "TERMS", at_once)
    texts = [*some_texts(1, 120), None, "", "...", "w1 w1 w2", "w1 w1 w2", "W1\tW1\x00w2"]
    docs = list(enumerate(texts))
    items = [*enumerate(["w1 w2 w1", "W3 w8é", "", None, "absent", " ".join(f"w{i}" for i in range(12))])]
    got = lexical_search.search_items(docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string"), k=9).collect()
    assert sorted(map(tuple, got)) == sorted(best(docs, items, 9))


def test_search_on_odd_input(spark):
    items = spark.createDataFrame([(1, "w1 w2"), (1, "w3"), (2, None)], "item_id long, text string")
    # repeated rows and ids, a null id, ids that are strings
    ids, texts = ["b", "a", "a", None, "c"], ["w1 w2", "w1 w2", "w1 w2", "w1 w2", "w3 x"]
    got = lexical_search.search_items(docs_of(spark, texts, ids, "string"), items, k=3)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((r["rank"], str(r["doc_id"])) for r in got.collect()) == [(1, "None"), (1, "c"), (2, "a"), (3, "a")]
    for docs, asked in ((docs_of(spark, ["w1"]).limit(0), items), (docs_of(spark, ["w1"]), items.limit(0)), (docs_of(spark, [None, "", "q"]), items)):
        none = lexical_search.search_items(docs, asked)
        assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


# -- runs


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and all(any(w[k] != w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r):
    words = []
    for _ in range(r.randrange(6)):
        unit = [r.choice("abcdefgh"[: r.choice([1, 2, 3, 8])]) for _ in range(r.randrange(1, 7))]
        words += (unit * r.randrange(1, 9))[: r.randrange(1, 40)]
    return words


@pytest.mark.parametrize("cost", [4, 0.01, 1e9])
def test_lags_and_runs_equal_trying_all(monkeypatch, cost):
    monkeypatch.setattr(periodic_runs, "FFT_COST", cost)  # all words heavy, or none
    r = random.Random(3)
    for _ in range(40):
        texts = [np.array([ord(c) - 97 for c in repetitive(r)], np.int32) for _ in range(5)]
        for w, m in zip(texts, periodic_runs.lag_matches(texts), strict=True):
            assert m.tolist() == [0, *(int((w[q:] == w[:-q]).sum()) for q in range(1, len(w) // 4 + 1))]
            assert periodic_runs.runs_of(w, m) == plain_runs(w.tolist())


def plain_op12(ident, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(ident).encode()) if ident is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (ident, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_equals_a_plain_version(spark, tmp_path):
    r = random.Random(8)
    texts = [" ".join(repetitive(r)) + r.choice(["", "\x0b\t ", " é é"]) for _ in range(150)] + [None, "", " \n", "a " * 5, "a " * 6, "a b " * 4, "x y z " * 5000, "na " * 20000]
    ids = [*range(len(texts) - 2), None, 3]
    docs_of(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_op12(i, t) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(x[1] > 0 for x in want) > 50


def test_runs_on_odd_input(spark):
    docs = docs_of(spark, ["a a a a a a b", "a a a a a a b"], ["k", "k"], "string")
    got = periodic_runs.find_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got.collect()] == [("k", 7, [(0, 6, 1)], "a b")] * 2
    assert periodic_runs.find_runs(docs.limit(0)).collect() == []


def test_a_long_text_is_cut_in_pieces(monkeypatch):
    text = " ".join(repetitive(random.Random(1)) * 50).encode()
    whole = periodic_runs.numbered(text)
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    assert periodic_runs.numbered(text)[0].tolist() == whole[0].tolist() and periodic_runs.numbered(text)[1] == whole[1]


# -- decontamination


def plain_leaks(docs, items, window):
    cut = [(i, terms(t)) for i, t in items]
    windows = [(i, tuple(w[k : k + window])) for i, w in cut if w for k in range(max(1, len(w) - window + 1))]
    out = []
    for ident, text in docs:
        w, hit, named = terms(text), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    named |= {i} - {None}
        out.append((ident, len(w), sorted(hit), sorted(named)))
    return out


def shown(rows):
    return sorted(repr((r["doc_id"], r["n_words"], [i for x in r["spans"] for i in range(x["start"], x["end"])], r["items"])) for r in rows)


@pytest.mark.parametrize("at_once, window, shingle", [(200_000, 10, 5), (5, 4, 2), (3, 6, 5)])
def test_leaks_equal_trying_all(spark, monkeypatch, at_once, window, shingle):
    monkeypatch.setattr(decontaminate, "SLICE", at_once)
    r = random.Random(window)
    items = [(i % 9 if i else None, t) for i, t in enumerate(some_texts(4, 14, words=3, longest=16))] + [(20, None), (21, "..."), (22, "w1"), (23, "w2 w2 w1")]
    texts = some_texts(5, 25, words=3) + [f"{r.choice(items)[1]}, X {r.choice(items)[1]}." for _ in range(10)] + [None, "", "W1", "w1 w2 " * 40]
    docs = [*enumerate(texts), (3, "w1 w2"), (3, "w1 w2"), (None, "w2 w2 w1")]
    got = decontaminate.decontaminate(docs_of(spark, [t for _, t in docs], [i for i, _ in docs]), spark.createDataFrame(items, "item_id long, text string"), window, shingle).collect()
    assert shown(got) == sorted(map(repr, plain_leaks(docs, items, window))) and any(x["items"] for x in got)


def test_leaks_on_odd_input(spark):
    items = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    docs = docs_of(spark, ["A b, C d", None], ["k", None], "string")
    got = decontaminate.decontaminate(docs, items)
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    assert sorted(repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["spans"]], r["items"])) for r in got.collect()) == sorted([repr(("k", 4, [(0, 3)], ["i"])), repr((None, 0, [], []))])
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
    assert [(r["spans"], r["items"]) for r in decontaminate.decontaminate(docs, items.limit(0)).collect()] == [([], [])] * 2
    none = decontaminate.decontaminate(docs.withColumn("text", F.lit(None).cast("string")), items).collect()
    assert len(none) == 2 and not any(r["n_words"] for r in none)
