"""Postings that are counted within each document's row."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex
from lodestone.operators import index as indexing
from lodestone.operators.topk import block_bounds, local_bounds

TEXTS = ["b a b", "", None, "a", ",,", "c c c a b c", "é e é"]


def built(spark, ids, **options):
    docs = spark.createDataFrame([(i, TEXTS[i % 7], TEXTS[i % 3]) for i in ids], "id long, text string, title string").repartition(3, "id")
    return TextIndex.build(docs, IndexConfig(["text", "title"]), **options)


def postings(index):
    rows = index.postings.join(index.docs, "doc_ord").select("id", "field_id", "term", "tf", "len").collect()
    return sorted(tuple(r) for r in rows)


def test_postings_are_counted_without_an_exchange(spark):
    index = built(spark, range(14))
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    want = []
    for i in range(14):
        for f, text in enumerate((TEXTS[i % 7], TEXTS[i % 3])):
            tokens = None if text is None else text.replace(",,", " ").split(" ")
            want += [(i, f, t, n, len(set(tokens))) for t, n in Counter(tokens or []).items() if t]
    assert postings(index) == sorted(want)


def test_many_documents_are_numbered_where_they_lie(spark, monkeypatch, tmp_path):
    few = built(spark, range(30))
    numbers = sorted(tuple(r) for r in few.docs.select("id", "doc_ord").collect())
    monkeypatch.setattr(indexing, "BROADCAST_IDS", 5)
    mixed = built(spark, range(30))
    docs = spark.createDataFrame([(i, TEXTS[i % 7], TEXTS[i % 3]) for i in range(30)], "id long, text string, title string").coalesce(2)
    sorted_ones = TextIndex.build(docs, IndexConfig(["text", "title"]))
    assert len(mixed._scratch) == 2 and len(sorted_ones._scratch) == 1  # only what lies in another order moves, once
    for index in (mixed, sorted_ones):
        assert sorted(tuple(r) for r in index.docs.select("id", "doc_ord").collect()) == numbers
        assert postings(index) == postings(few)


def test_local_bounds_put_together_are_the_bounds(spark):
    rows = built(spark, range(600)).postings
    local = local_bounds(rows)
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString()
    together = local.groupBy("term", "field_id", "window").agg(F.max("max_tf"), F.min("min_len"))
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, block_bounds(rows).collect()))
