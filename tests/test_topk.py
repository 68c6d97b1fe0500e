"""Searches that leave windows out, against the full ranking."""

import copy

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex, search, search_batch, tree
from lodestone.operators import topk
from lodestone.operators.search import Matched, contributions, prunable, surviving_windows
from lodestone.plans.query import Resolver, leaves


@pytest.fixture(scope="module")
def index(spark):
    part = lambda i: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000
    words = F.array(*[F.concat(F.lit("w"), F.floor(40 * part(i) * part(i) * part(i)).cast("string")) for i in range(12)])
    text = F.array_join(F.slice(words, F.lit(1), (F.col("id") % 11 + 2).cast("int")), " ")
    rare = F.when(F.col("id") % 97 == 0, "rare").when(F.col("id") % 131 == 0, "rarer rare")
    docs = spark.range(0, 1500, 1, 2).select("id", text.alias("text"), rare.alias("title"))
    return TextIndex.build(docs, IndexConfig(["title", "text"])).cache()


@pytest.fixture
def blocked(index, monkeypatch):
    monkeypatch.setattr(topk, "WINDOW", 8)
    monkeypatch.setattr(topk, "FIRST", 2)
    return copy.copy(index).with_blocks()


CASES = [
    ("w0 w3", {}),
    ("rare w0 w1", {}),
    ("w1 rare", {"combine_with": "AND"}),
    ("w0 w5 w17", {"combine_with": "AND"}),
    (tree("w2", "w0", "rare", combine_with="AND_NOT"), {}),
    (tree(tree("w2", "w9", combine_with="AND"), "rarer", combine_with="OR"), {}),
    ("w1 rar", {"prefix": True}),
    ("rarre w12", {"fuzzy": 1, "boost": {"title": 3}}),
    ("w3 w3 w4", {"fields": ["text"], "bm25": {"k": 2.0, "b": 1.0, "d": 0.0}}),
    ("absent", {}),
]


@pytest.mark.parametrize("query, options", CASES)
def test_the_best_are_those_of_the_full_ranking(index, blocked, query, options):
    limit = 1 if "rare" in str(query) else 12
    full = search(index, query, limit=limit, **options).collect()
    best = search(blocked, query, limit=limit, **options).collect()
    assert [(r["id"], r["terms"], r["match"]) for r in best] == [(r["id"], r["terms"], r["match"]) for r in full]
    assert [r["score"] for r in best] == pytest.approx([r["score"] for r in full])


def planned(index, query, **options):
    plan = Resolver(index.config.fields, index.config.analyzer, index.config.search_options).resolve(query, options)
    return plan, leaves(plan)


def test_most_postings_are_not_ranked(index, monkeypatch):
    monkeypatch.setattr(topk, "WINDOW", 8)
    monkeypatch.setattr(topk, "FIRST", 4)
    blocked = copy.copy(index).with_blocks()
    for query, options, share in (("rare w0 w1", {}, 0.5), ("rarer w0", {"combine_with": "AND"}, 0.2)):
        plan, found = planned(blocked, query, **options)
        matched = Matched(blocked, found)
        windows = surviving_windows(blocked, plan, found, matched, 5)
        read, whole = contributions(blocked, found, matched=matched, windows=windows).count(), contributions(blocked, found, matched=matched).count()
        assert 0 < read < share * whole


def test_few_windows_are_ranges_in_the_scan(spark, index, tmp_path, monkeypatch):
    index.postings.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    windows = spark.createDataFrame([(1,), (2,), (5,)], "window long")
    rows = topk.within(stored, windows)
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_ord,256)" in plan and "LessThanOrEqual(doc_ord,767)" in plan and "Join" not in plan
    monkeypatch.setattr(topk, "RANGES", 1)
    assert sorted(map(tuple, topk.within(stored, windows).collect())) == sorted(map(tuple, rows.collect())) and rows.count()


def test_where_bounds_do_not_hold_all_is_ranked(index):
    blocked = copy.copy(index).with_blocks()
    able = lambda limit=5, keep=None, **o: prunable(blocked, planned(blocked, "w0 w1", **o)[1], limit, keep)
    assert able() and not able(None) and not able(keep=F.col("score") > 1)
    assert not able(boost={"title": -1}) and not able(boost_term=lambda t, i, ts: -2) and not able(bm25={"k": 1.2, "b": 1.5, "d": 0.5})
    assert not able(boost_document=lambda i, t, s: F.lit(2.0))
    blocked.dirt_count = 1
    assert not able()


@pytest.mark.parametrize("options", [{}, {"combine_with": "AND"}, {"prefix": True}, {"fuzzy": 1}, {"prefix": True, "fuzzy": 0.2}])
def test_batches(spark, index, blocked, options):
    queries = spark.createDataFrame([(1, "rare w0"), (2, "w3 w3 w7 w0"), (3, "rarer"), (4, "absent w1"), (5, ""), (6, "w")], "query_id long, text string")
    shown = lambda i: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in search_batch(i, queries, k=6, **options).collect())
    assert shown(blocked) == shown(index)
