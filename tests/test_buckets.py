"""Bucketed postings: the same results, without exchanges before documents are added up."""

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex, search, search_batch
from lodestone.sources import buckets

QUERIES = [(1, "rare w0"), (2, "w3 w3 w7 w0"), (3, "absent w1"), (4, ""), (5, "w")]


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(14)).cast("string"))), " ")
    docs = spark.range(0, 300, 1, 2).select("id", words.alias("text"), F.when(F.col("id") % 50 == 0, "rare w0").alias("title"))
    index = TextIndex.build(docs, IndexConfig(["title", "text"])).cache()
    path = str(tmp_path_factory.mktemp("buckets"))
    buckets.save(index, path, buckets=4, part=60)
    return index, buckets.load(spark, path, index.config)


@pytest.mark.parametrize("options", [{}, {"combine_with": "AND"}, {"prefix": True, "fuzzy": 1}])
def test_same_results(spark, pair, options):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    shown = lambda i: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in search_batch(i, queries, k=7, **options).collect())
    assert shown(pair[1]) == shown(pair[0])


def test_other_searches(pair):
    shown = lambda i: sorted((r["id"], round(r["score"], 8)) for r in search(i, "rare w3", prefix=True, details=False).collect())
    assert shown(pair[1]) == shown(pair[0]) and pair[1].term_count == pair[0].term_count


def test_frequent_terms_are_split(pair):
    parts = {r["term"]: r["n"] for r in pair[1].buckets[1].groupBy("term").agg(F.count("*").alias("n")).collect()}
    held = {(r["term"], r["part"]): r["n"] for r in pair[1].buckets[0].groupBy("term", "part").agg(F.count("*").alias("n")).collect()}
    assert parts["rare"] == 1 and parts["w0"] >= 3 and max(held.values()) < 120


def test_no_exchange_below_the_document_aggregation(spark, pair):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = search_batch(pair[1], queries, k=None)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    scans = [i for i, line in enumerate(plan) if "Bucketed: true" in line]
    assert len(scans) == 2
    for i in scans:
        above, level = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < level:
                level = depth(line)
                above.append(line)
        exchanges = [line for line in above if " Exchange " in line]
        first = next(line for line in above if "Exchange " in line)
        assert "query_id" in first and "doc_ord" in first, first
        assert exchanges


def test_discarded_documents_are_refused(spark, tmp_path):
    index = TextIndex.build(spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string"), IndexConfig(["text"], auto_vacuum=False))
    index.discard(1)
    with pytest.raises(ValueError):
        buckets.save(index, str(tmp_path))
