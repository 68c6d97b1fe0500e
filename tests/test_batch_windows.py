"""Batches that are ranked window by window of documents."""

from __future__ import annotations

import pytest

from lodestone import IndexConfig, TextIndex, search_batch
from lodestone.operators import batch, search as searches, topk


@pytest.mark.parametrize(("how", "fuzzy"), [("OR", 0), ("AND", 0), ("OR", 1)])
def test_windows_give_the_best_of_all(spark, monkeypatch, how, fuzzy):
    monkeypatch.setattr(batch, "WINDOW_BITS", 3)
    docs = spark.createDataFrame([(i, "common " * (1 + i % 2) + f"w{i % 3} v{i % 5} v{i % 4}", f"v{i % 2}") for i in range(60)], "id long, text string, title string")
    queries = spark.createDataFrame([(1, "common w1"), (2, "v1 v1 common"), (3, "w2 absent")], "query_id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text", "title"]))
    best = search_batch(index, queries, k=5, combine_with=how, fuzzy=fuzzy)
    plan = best._jdf.queryExecution().executedPlan().toString()
    every = search_batch(index, queries, k=None, combine_with=how, fuzzy=fuzzy).where("rank <= 5")
    shown = lambda rows: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rows.collect())
    got = shown(best)
    assert "FlatMapGroupsInArrow" in plan and got == shown(every) and len(got) >= 10
    monkeypatch.setattr(batch, "BATCH_TERMS", 2)  # more terms than are sent: by joins
    assert shown(search_batch(index, queries, k=5, combine_with=how, fuzzy=fuzzy)) == got


@pytest.mark.parametrize(("how", "fuzzy", "sent"), [("OR", 0, 1_000_000), ("AND", 0, 1_000_000), ("OR", 1, 1_000_000), ("OR", 0, 31), ("OR", 1, 31)])
def test_blocks_give_the_best_of_all_without_pairs(spark, monkeypatch, how, fuzzy, sent):
    monkeypatch.setattr(batch, "WINDOW_BITS", 4)
    monkeypatch.setattr(topk, "WINDOW", 4)
    monkeypatch.setattr(topk, "FIRST", 2)
    monkeypatch.setattr(searches, "BROADCAST_WINDOWS", sent)
    text = lambda i: "common " * (1 + (i % 7 == 0) * 3) + f"w{i % 3} v{i % 5} v{i % 4}" + " rare" * (i > 70)
    docs = spark.createDataFrame([(i, text(i), f"v{i % 2}") for i in range(90)], "id long, text string, title string")
    queries = spark.createDataFrame([(1, "common w1"), (2, "v1 v1 common"), (3, "w2 absent"), (4, "rare w0"), (5, "gone")], "query_id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text", "title"])).cache()
    every = search_batch(index, queries, k=None, combine_with=how, fuzzy=fuzzy).where("rank <= 5")
    shown = lambda rows: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in rows.collect())
    want = shown(every)
    best = search_batch(index.with_blocks(), queries, k=5, combine_with=how, fuzzy=fuzzy)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and shown(best) == want and len(want) >= 10
    monkeypatch.setattr(batch, "BATCH_TERMS", 2)  # more terms than are sent: by joins
    assert shown(search_batch(index, queries, k=5, combine_with=how, fuzzy=fuzzy)) == want
