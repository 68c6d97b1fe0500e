"""Expansion over the table of terms, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex, search, search_batch
from lodestone.operators import search as searching
from lodestone.operators.neighbours import neighbour_table, text_deletions
from lodestone.operators.score import term_filter
from lodestone.operators.search import expand_batch, near_terms
from lodestone.operators.segments import SegmentedIndex


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def altered(rng, word, n):
    w = list(word)
    for _ in range(n):
        at = rng.randrange(len(w) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            w.insert(at, rng.choice("abc"))
        elif w and at < len(w):
            w[at : at + 1] = [] if kind == 1 else [rng.choice("abc")]
    return "".join(w) or "a"


def words(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 30, 40]))) for _ in range(40)]
    return base, sorted({altered(rng, w, rng.randint(0, 5)) for w in base for _ in range(6)} | set(base))


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_near_terms_against_all_pairs(spark, k):
    asked, terms = words(k)
    wanted = spark.createDataFrame([(w, k) for w in set(asked)], "asked string, k int")
    got = sorted((r["asked"], r["term"], r["d"]) for r in near_terms(wanted, spark.createDataFrame([(t,) for t in terms], "term string")).collect())
    assert got == sorted((a, t, d) for a in set(asked) for t in terms if 0 < (d := edits(a, t)) <= k) and got


def test_long_terms_are_not_spelled_out(spark):
    """A term of 20,000 characters meets its neighbour by segments; nothing of it is exploded by deletions."""
    long = "ab" * 10_000
    wanted = spark.createDataFrame([(long, 2), ("abab", 2)], "asked string, k int")
    lexicon = spark.createDataFrame([(long + "c",), ("ababa",), ("x" * 20_000,)], "term string")
    got = sorted((len(r["asked"]), len(r["term"]), r["d"]) for r in near_terms(wanted, lexicon).collect())
    assert got == [(4, 5, 1), (20_000, 20_001, 1)]


def test_batch_expansion_of_prefixes(spark):
    asked, terms = words(9)
    got = expand_batch(spark.createDataFrame([(w,) for w in set(asked)], "asked string"), spark.createDataFrame([(t,) for t in terms], "term string"), True, 0, {"prefix": 0.375, "fuzzy": 0.45})
    assert sorted((r["asked"], r["term"]) for r in got.collect()) == sorted((a, t) for a in set(asked) for t in terms if t.startswith(a))


def test_many_terms_meet_the_postings_by_a_join(spark, monkeypatch):
    from lodestone.operators import search as module

    docs = spark.createDataFrame([(i, f"alpha{i} alpha beta") for i in range(30)], "id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text"]))
    few = sorted(map(str, search(index, "alpha", prefix=True).collect()))
    monkeypatch.setattr(module, "LITERALS", 3)
    joined = sorted(map(str, search(index, "alpha", prefix=True).collect()))
    monkeypatch.setattr(module, "BROADCAST_TERMS", 2)
    assert joined == few == sorted(map(str, search(index, "alpha", prefix=True).collect())) and len(few) == 30


def test_terms_follow_the_life_cycle(spark, tmp_path):
    counted = lambda index: {(r["term"], r["field_id"]): r["df"] for r in index.terms.collect()}
    stored = lambda index: {(r["term"], r["field_id"]): r["n"] for r in index.postings.groupBy("term", "field_id").agg(F.count("*").alias("n")).collect()}
    index = TextIndex.build(spark.createDataFrame([(i, f"a b{i % 3}") for i in range(9)], "id long, text string"), IndexConfig(["text"])).cache()
    index.add({"id": 50, "text": "a new"})
    assert counted(index) == stored(index)
    index.discard(3)
    index.remove({"id": 4, "text": "a b1"})
    index.vacuum()
    assert counted(index) == stored(index) and ("new", 0) in counted(index)


@pytest.mark.parametrize("k", [1, 2, 4])
def test_stored_neighbours_against_all_pairs(spark, k):
    asked, terms = words(k)
    wanted = spark.createDataFrame([(w, k) for w in set(asked)], "asked string, k int")
    lexicon = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r["asked"], r["term"], r["d"]) for r in near_terms(wanted, lexicon, neighbour_table(lexicon)).collect())
    assert got == sorted((a, t, d) for a in set(asked) for t in terms if 0 < (d := edits(a, t)) <= k) and got


def test_deletions_of_queries_and_of_terms_agree(spark):
    for term in ("", "a", "aab", "naïve", "abcabc"):
        rows = {(r["cut"], r["times"]) for r in neighbour_table(spark.createDataFrame([(term,)], "term string")).collect()}
        assert {c for c, _ in rows} == text_deletions(term, 2) and len(rows) == len({c for c, _ in rows})
        assert {c for c, n in rows if n <= 1} == text_deletions(term, 1)


def test_searches_read_stored_neighbours(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha{i % 7} albha bet{i % 3}a gamma") for i in range(30)], "id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text"])).cache()
    kept = SegmentedIndex.open(spark, str(tmp_path), IndexConfig(["text"]), neighbours=True)
    kept.add_all(docs.where("id < 20"), order=[F.col("id")])
    kept.add_all(docs.where("id >= 20"))
    found = lambda i, q, **o: sorted((r["id"], round(r["score"], 9), r["terms"]) for r in search(i, q, **o).collect())
    queries = spark.createDataFrame([(1, "alpha bata"), (2, "gama alpha3")], "query_id long, text string")
    batch = lambda i: sorted((r["query_id"], r["id"], round(r["score"], 9)) for r in search_batch(i, queries, k=None, fuzzy=2).collect())
    plain, stored = found(index, "alpha bta", fuzzy=2), kept.index()
    assert stored._neighbours is not None and found(stored, "alpha bta", fuzzy=2) == plain and len(plain) == 30
    assert batch(stored) == batch(index)
    # the lexicon is not compared, term by term, in a band of lengths
    compared = []
    monkeypatch.setattr(searching, "term_filter", lambda leaf, term, edits=True: compared.append(edits) or term_filter(leaf, term, edits))
    assert search(stored, "bta", fuzzy=2).count() == 30 and compared == [False]
