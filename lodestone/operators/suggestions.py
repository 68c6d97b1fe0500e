"""Suggestions made beforehand: the best phrases for every beginning of a term, as a table that a lookup reads by its prefix.

``suggestion_table`` evaluates, for each beginning of up to ``longest`` characters, what ``auto_suggest`` would for a query of
that one word: every document's score over its terms that begin so, its phrase, and each phrase's mean score.  That is two
aggregations over the postings, exploded by the lengths of beginnings, and the best ``k`` of each are kept.  A query of one
word within ``longest`` is answered from the table's scan; longer ones, and queries of several words, by ``auto_suggest``.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.analysis import Analyzer, query_terms
from lodestone.operators.index import TextIndex
from lodestone.operators.score import PREFIX_DECAY, bm25
from lodestone.operators.search import auto_suggest
from lodestone.plans.query import Resolver, SearchError, leaves

#: Options under which a word's suggestions depend on more than its beginning.
UNSUITED = ("filter", "boost_document", "boost_term", "fuzzy", "tokenize", "process_term")


def suggestion_table(index: TextIndex, longest: int = 8, k: int = 10, **options: Any) -> DataFrame:
    """(prefix, suggestion, terms, score, place): the best ``k`` phrases for each beginning, ``place`` from 1."""
    c = index.config
    settled = {**c.search_options, **c.auto_suggest_options, **options}
    unsuited = [name for name in UNSUITED if settled.get(name)]
    if unsuited:
        raise SearchError(f"suggestions cannot be made beforehand with {', '.join(unsuited)}")
    own = {name: value for name, value in {**c.auto_suggest_options, **options}.items() if name != "prefix"}
    leaf = leaves(Resolver(c.fields, Analyzer(), c.search_options).resolve("x", own))[0]
    boosts = {c.fields.index(name): boost for name, boost in leaf.fields}
    boost = F.element_at(F.create_map(*[F.lit(x) for pair in boosts.items() for x in pair]), F.col("field_id"))
    postings = index.postings.where(F.col("field_id").isin(list(boosts)))
    if index.dirt_count:
        postings = postings.join(index.docs.select("doc_ord"), "doc_ord", "left_semi")
        counts = postings.groupBy("term", "field_id").agg(F.count("*").cast("double").alias("m"))
    else:
        counts = index.terms.select("term", "field_id", F.col("df").cast("double").alias("m"))
    means = F.create_map(*[F.lit(y) for f, mean in index.means.items() for y in (f, float(mean))])
    of = leaf.bm25
    rank = bm25(F.col("tf").cast("double"), index.document_count, F.col("m"), F.col("len").cast("double"), F.element_at(means, F.col("field_id")), *[F.lit(of[x]) for x in ("k", "b", "d")])
    weights = postings.join(counts, ["term", "field_id"]).groupBy("term", "doc_ord").agg(F.sum(boost * rank).alias("w"))
    size = F.length("term")
    rows = weights.select("*", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(longest)))).alias("n")).withColumn("prefix", F.expr("substring(term, 1, n)"))
    share = F.when(size == F.col("n"), F.lit(1.0)).otherwise(F.lit(leaf.weights["prefix"]) * size / (size + F.lit(PREFIX_DECAY) * (size - F.col("n"))))
    met = F.array_sort(F.collect_list(F.struct((size > F.col("n")).alias("longer"), "term")))
    docs = rows.groupBy("prefix", "doc_ord").agg(F.sum(F.col("w") * share).alias("score"), F.transform(met, lambda x: x["term"]).alias("terms"))
    phrases = docs.groupBy("prefix", F.array_join("terms", " ").alias("suggestion")).agg(F.first("terms").alias("terms"), F.avg("score").alias("score"))
    best = Window.partitionBy("prefix").orderBy(F.round("score", 9).desc(), "suggestion")
    return phrases.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def save(table: DataFrame, path: str) -> None:
    """Write a table of suggestions by prefix, so that a lookup reads one row group."""
    table.repartitionByRange("prefix", "place").sortWithinPartitions("prefix", "place").write.mode("overwrite").parquet(path)


def suggest(index: TextIndex, table: DataFrame, query: str, *, longest: int = 8, limit: int | None = None, **options: Any) -> DataFrame:
    """(suggestion, terms, score) by score: from ``table``, made with the same options, where the query is one short word.

    A ``limit`` beyond the table's ``k`` gives what the table has.
    """
    analyzer = index.config.analyzer
    terms = query_terms(query, analyzer.tokenize_text, analyzer.process_text)
    if len(terms) != 1 or len(terms[0]) > longest:
        return auto_suggest(index, query, limit=limit, **options)
    rows = table.where(F.col("prefix") == terms[0])
    rows = rows.where(F.col("place") <= limit) if limit is not None else rows
    return rows.orderBy("place").select("suggestion", "terms", "score")
