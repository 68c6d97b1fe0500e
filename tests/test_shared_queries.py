"""Batches in which many queries have the same terms."""

from __future__ import annotations

from lodestone import IndexConfig, TextIndex, search_batch
from lodestone.operators import search as searching


def test_queries_of_the_same_terms_are_ranked_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 3} v{i % 5} common") for i in range(30)], "id long, text string")
    texts = {1: "w1 v2", 2: "v2 w1", 3: "w1 v2 v2", 4: "w1 v2", 5: "absent"}
    index = TextIndex.build(docs, IndexConfig(["text"]))
    ranked, shared = [], searching._shared
    monkeypatch.setattr(searching, "_shared", lambda *x: (lambda found: (ranked.append(found[0].select("query_id").distinct().count()), found)[1])(shared(*x)))

    def answers(ids):
        queries = spark.createDataFrame([(i, texts[i]) for i in ids], "query_id long, text string")
        out: dict = {}
        for r in search_batch(index, queries, k=4).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["id"], round(r["score"], 9)))
        return {i: sorted(rows) for i, rows in out.items()}

    together = answers(texts)
    assert ranked == [3]  # 1, 2 and 4 are one, 3 repeats a term, 5 meets nothing
    assert sorted(together) == [1, 2, 3, 4] and together[1] == together[2] == together[4] != together[3]
    assert all(together[i] == answers([i])[i] for i in (1, 3))
