"""The driver's queries over the search operators, and their SQL."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.analysis import Analyzer, PythonAnalyzer
from lodestone.functions.scratch import new_path
from lodestone.operators.index import IndexConfig, TextIndex
from lodestone.operators.prefix_map import PrefixMap
from lodestone.operators.segments import SegmentedIndex
from lodestone.operators.search import auto_suggest, search, search_batch
from lodestone.operators.suggestions import suggestion_table
from lodestone.plans.query import WILDCARD, SearchError, tree
from lodestone.sources import buckets, tables
from lodestone.sources.interchange import read_json, write_json
from lodestone.streaming.ingest import ingest

_built: dict[tuple, TextIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], TextIndex]) -> TextIndex:
    """An index that several queries of a session share."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = make().cache()
    return _built[key]


def documents_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    config = lambda: IndexConfig(["text"], id_field="doc_id", store_fields=["lang", "source"])
    return _once(spark, sf_dir, "documents", lambda: TextIndex.build(table(spark, sf_dir, "documents"), config()))


def parts_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    config = lambda: IndexConfig(["p_name", "p_brand", "p_type"], id_field="p_partkey", store_fields=["p_brand"])
    return _once(spark, sf_dir, "parts", lambda: TextIndex.build(table(spark, sf_dir, "part"), config()))


def blocked_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The documents' index with bounds of blocks."""
    return _once(spark, sf_dir, "documents by blocks", lambda: copy.copy(documents_index(spark, sf_dir)).with_blocks())


def scored(rows: DataFrame, ident: str = "doc_id", *more) -> DataFrame:
    return rows.select(F.col("id").alias(ident), F.round("score", 6).alias("score"), *more)


def found(**options):
    """A query on the documents' index by call options."""
    text = options.pop("q")
    return lambda spark, sf_dir: scored(search(documents_index(spark, sf_dir), text, details=False, sort=False, **options))


def found_parts(**options):
    text = options.pop("q")
    return lambda spark, sf_dir: scored(search(parts_index(spark, sf_dir), text, details=False, sort=False, **options), "p_partkey")


# -- analysis


def tokenize_default(spark, sf_dir):
    a = Analyzer()
    tokens = a.tokenize_column(F.col("text"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, "\x1f")).alias("tokens_md5"))


def token_counts(spark, sf_dir):
    return documents_index(spark, sf_dir).postings.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("documents"))


def field_lengths(spark, sf_dir):
    index = parts_index(spark, sf_dir)
    return index.with_docs(index.lengths, "id").select(F.col("id").alias("p_partkey"), "field_id", "len")


def postings_build(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return index.with_docs(index.postings, "id").select("term", F.col("id").alias("doc_id"), "tf", "len")


def lexicon(spark, sf_dir):
    return documents_index(spark, sf_dir).lexicon()


def term_df(spark, sf_dir):
    return parts_index(spark, sf_dir).postings.groupBy("term", "field_id").agg(F.count("*").alias("documents"))


def avg_field_length(spark, sf_dir):
    index = parts_index(spark, sf_dir)
    return spark.createDataFrame([(f, round(m, 9)) for f, m in index.means.items()], "field_id int, avg_len double")


def counters(spark, sf_dir):
    index = documents_index(spark, sf_dir)
    return spark.createDataFrame([(index.document_count, index.term_count, index.dirt_count, index.dirt_factor)], "document_count long, term_count long, dirt_count long, dirt_factor double")


# -- search


def search_tree(spark, sf_dir):
    rows = search(documents_index(spark, sf_dir), tree(tree("the", "of", combine_with="AND"), tree("der", "und", combine_with="AND"), "erst", combine_with="OR"), details=False, sort=False)
    return scored(rows)


def search_filter(spark, sf_dir):
    rows = search(documents_index(spark, sf_dir), "the nation", details=False, sort=False, filter=(F.col("lang") == "en") & (F.col("score") > 1))
    return scored(rows, "doc_id", "lang")


def search_boost_document(spark, sf_dir):
    boost = lambda i, term, stored: F.when(stored["lang"] == "en", 2.0).when(stored["lang"] == "fr", 0.5)
    return scored(search(documents_index(spark, sf_dir), "de the", details=False, sort=False, boost_document=boost))


def search_wildcard(spark, sf_dir):
    return scored(search(documents_index(spark, sf_dir), WILDCARD, details=False, sort=False), "doc_id", "lang")


def wildcard_and_not(spark, sf_dir):
    return scored(search(documents_index(spark, sf_dir), tree(WILDCARD, "the", combine_with="AND_NOT"), details=False, sort=False))


def search_topk(spark, sf_dir):
    rows = search(documents_index(spark, sf_dir), "the of and", details=False, limit=20)
    return scored(rows)


def search_batch_top(spark, sf_dir):
    rows = search_batch(documents_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", k=5)
    return rows.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def best_by_blocks(query, limit, **options):
    return lambda spark, sf_dir: _in_order(search(blocked_index(spark, sf_dir), query, details=False, limit=limit, **options))


def batch_by_blocks(spark, sf_dir):
    rows = search_batch(blocked_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), "item_id", "text", k=5)
    return rows.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def batch_by_buckets(spark, sf_dir):
    path = new_path(spark, "buckets")
    index = documents_index(spark, sf_dir)
    buckets.save(index, path, buckets=8, part=500)
    rows = search_batch(buckets.load(spark, path, index.config), table(spark, sf_dir, "benchmark"), "item_id", "text", k=5)
    return rows.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def batch_by_neighbours(spark, sf_dir):
    """Names without their first letter as queries, whose terms meet the lexicon by its stored deletions."""
    parts = table(spark, sf_dir, "part")
    index = TextIndex.build(parts, IndexConfig(["p_name"], id_field="p_partkey")).cache().with_neighbours()
    queries = parts.select(F.col("p_partkey").alias("query_id"), F.expr("substring(p_name, 2)").alias("text"))
    rows = search_batch(index, queries, k=3, fuzzy=0.3)
    return rows.select("query_id", F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def match_terms(spark, sf_dir):
    rows = search(parts_index(spark, sf_dir), "re go economy", prefix=True, fuzzy=1, sort=False)
    pairs = F.flatten(F.transform(F.map_entries("match"), lambda e: F.transform(e["value"], lambda f: F.concat(e["key"], F.lit(":"), f))))
    return rows.select(F.col("id").alias("p_partkey"), F.round("score", 6).alias("score"), F.array_join(F.array_sort("terms"), ",").alias("terms"), F.array_join(F.array_sort("query_terms"), ",").alias("query_terms"), F.array_join(F.array_sort(pairs), ",").alias("matches"))


def suggest_prefix(spark, sf_dir):
    rows = auto_suggest(parts_index(spark, sf_dir), "red w", fields=["p_name"])
    return rows.select("suggestion", F.round("score", 6).alias("score"))


def stopwords(spark, sf_dir):
    stop = ["red", "blue", "old"]
    analyzer = Analyzer(process_column=lambda t, f: F.when(~F.lower(t).isin(stop), F.lower(t)), process_text=lambda t: None if t.lower() in stop else t.lower())
    index = TextIndex.build(table(spark, sf_dir, "part"), IndexConfig(["p_name"], id_field="p_partkey", analyzer=analyzer))
    return scored(search(index, "red ring", details=False, sort=False), "p_partkey")


def synonyms(spark, sf_dir):
    analyzer = Analyzer(process_column=lambda t, f: F.when(t == "ring", F.array(F.lit("ring"), F.lit("circle"))).otherwise(F.array(F.lower(t))), expands=True)
    index = TextIndex.build(table(spark, sf_dir, "part"), IndexConfig(["p_name"], id_field="p_partkey", analyzer=analyzer))
    return scored(search(index, "circle", details=False, sort=False), "p_partkey")


def hash_tokenizer(spark, sf_dir):
    analyzer = Analyzer(tokenize_column=lambda v, f: F.split(v, "#"), tokenize_text=lambda s: s.split("#"))
    index = TextIndex.build(table(spark, sf_dir, "part"), IndexConfig(["p_brand"], id_field="p_partkey", analyzer=analyzer))
    return scored(search(index, "Brand#7", details=False, sort=False), "p_partkey")


def fuzzy_by_neighbours(spark, sf_dir):
    index = _once(spark, sf_dir, "parts with neighbours", lambda: copy.copy(parts_index(spark, sf_dir)).with_neighbours())
    return scored(search(index, "rde ecanomy", fuzzy=2, prefix=True, details=False, sort=False), "p_partkey")


def suggestions_beforehand(spark, sf_dir):
    rows = suggestion_table(parts_index(spark, sf_dir), longest=4, k=5, boost={"p_name": 2})
    return rows.select("prefix", "suggestion", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


def python_analyzer(spark, sf_dir):
    """A tokenizer and a term processor in Python: halves of words, spelled backwards, short ones dropped."""
    halves = lambda text: [h for w in text.split() for h in (w[: len(w) // 2], w[len(w) // 2 :])]
    analyzer = PythonAnalyzer(halves, lambda token: token[::-1].lower() if len(token) > 1 else None)
    index = TextIndex.build(table(spark, sf_dir, "part"), IndexConfig(["p_name"], id_field="p_partkey", analyzer=analyzer))
    return scored(search(index, "ring anvil", details=False, sort=False), "p_partkey")


def extract_hook(spark, sf_dir):
    config = IndexConfig(["label"], id_field="key", extract={"key": F.col("p_partkey"), "label": F.concat_ws(" - ", "p_brand", "p_name")}, store_fields=["label"])
    return scored(search(TextIndex.build(table(spark, sf_dir, "part"), config), "7 ring", details=False, sort=False, boost={"label": 2}), "p_partkey", "label")


def search_time_analysis(spark, sf_dir):
    rows = search(parts_index(spark, sf_dir), "GNIR|der", details=False, sort=False, tokenize=lambda text: text.split("|"), process_term=lambda term: term[::-1].lower())
    return scored(rows, "p_partkey")


def default_options(spark, sf_dir):
    """The default functions, asked for by name, give what no options give."""
    named = {name: IndexConfig.default(name) for name in ("tokenize", "process_term")}
    return scored(search(parts_index(spark, sf_dir), "Red RING", details=False, sort=False, **named), "p_partkey")


def changed_documents(spark, sf_dir):
    """What the logger is told when documents are removed that have changed since they were indexed."""
    told: dict[tuple[str, str], int] = {}

    def count(level: str, message: str, code: str) -> None:
        told[level, code] = told.get((level, code), 0) + 1

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    index = TextIndex.build(parts, IndexConfig(["p_name"], id_field="p_partkey", logger=count))
    index.remove_all(parts.where("p_partkey % 10 = 3").withColumn("p_name", F.concat("p_name", F.lit(" altered since"))))
    rows = [(level, code, n, index.document_count) for (level, code), n in told.items()]
    return spark.createDataFrame(rows, "level string, code string, times long, document_count long")


def refusals(spark, sf_dir):
    """Requests on the parts that cannot be answered; none of them changes the index."""
    parts, index = table(spark, sf_dir, "part").select("p_partkey", "p_name"), _fresh(spark, sf_dir)
    cases = {
        "id is there": lambda: index.add_all(parts.limit(1)),
        "id twice": lambda: index.add_all(parts.selectExpr("0L - 1 AS p_partkey", "p_name").limit(2)),
        "no id": lambda: index.add_all(parts.selectExpr("CAST(NULL AS BIGINT) AS p_partkey", "p_name").limit(1)),
        "absent": lambda: index.discard(-5),
        "nothing to remove": lambda: index.remove_all(None),
        "unknown option": lambda: search(index, "red", fuzziness=1),
        "unknown combination": lambda: search(index, "red ring", combine_with="XOR"),
        "no fields": lambda: IndexConfig([]),
        "unknown default": lambda: IndexConfig.default("colour"),
    }
    rows = []
    for name, request in cases.items():
        try:
            request()
            rows.append((name, False))
        except SearchError:
            rows.append((name, True))
    left = _fresh(spark, sf_dir).docs.join(index.docs, "doc_ord").count()
    return spark.createDataFrame([(*r, left) for r in rows], "request string, refused boolean, documents long")


def nullable_field_mean(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("p_name"), "p_type")
    index = TextIndex.build(docs, IndexConfig(["p_name", "p_type"], id_field="p_partkey"))
    return spark.createDataFrame([(f, round(m, 9)) for f, m in index.means.items()], "field_id int, avg_len double")


# -- life cycle


def _fresh(spark, sf_dir) -> TextIndex:
    return TextIndex.build(table(spark, sf_dir, "part"), IndexConfig(["p_name"], id_field="p_partkey", auto_vacuum=False))


def discard_search(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.discard_all(range(0, 50))
    return scored(search(index, "red ring", details=False, sort=False), "p_partkey")


def vacuum_stats(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.discard_all(range(0, 50))
    before, dirt, factor = index.postings.count(), index.dirt_count, index.dirt_factor
    index.vacuum()
    return spark.createDataFrame([(before, dirt, round(factor, 9), index.postings.count(), index.dirt_count, index.document_count)], "postings_before long, dirt_count long, dirt_factor double, postings_after long, dirt_after long, document_count long")


def replace_search(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.replace({"p_partkey": 3, "p_name": "red unicorn"})
    return scored(search(index, "unicorn red", details=False, sort=False), "p_partkey")


def remove_search(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.remove_all(table(spark, sf_dir, "part").where("p_partkey < 30"))
    return scored(search(index, "hot anvil", combine_with="AND", details=False, sort=False), "p_partkey")


def json_roundtrip(spark, sf_dir):
    config = IndexConfig(["p_name"], id_field="p_partkey", store_fields=["p_brand"])
    path = new_path(spark, "portable")
    write_json(TextIndex.build(table(spark, sf_dir, "part"), config), path)
    index = read_json(spark, path, config, stored="p_brand string")
    return scored(search(index, "small gear", details=False, sort=False), "p_partkey", "p_brand")


def saved_search(spark, sf_dir):
    path = new_path(spark, "saved-index")
    index = parts_index(spark, sf_dir)
    tables.save(index, path)
    return scored(search(tables.load(spark, path, index.config), "cold plate", details=False, sort=False), "p_partkey")


def json_version_1(spark, sf_dir):
    """Version 1 wraps each posting map; the rest is as in version 2."""
    config = IndexConfig(["p_name"], id_field="p_partkey")
    path = new_path(spark, "portable")
    write_json(TextIndex.build(table(spark, sf_dir, "part"), config), path, version=1)
    return scored(search(read_json(spark, path, config), "small gear", details=False, sort=False), "p_partkey")


def emptied_and_filled(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.remove_all()
    empty = (index.document_count, index.term_count, index.dirt_count)
    index.add_all(table(spark, sf_dir, "part"))
    rows = scored(search(index, "red ring", details=False, sort=False), "p_partkey")
    return rows.withColumns({name: F.lit(n).cast("long") for name, n in zip(("documents_before", "terms_before", "dirt_before"), empty, strict=True)})


def has_and_stored_fields(spark, sf_dir):
    index, asked = parts_index(spark, sf_dir), [0, 1, 17, 19, -1, 10**12]
    rows = [(i, index.has(i), (index.get_stored_fields(i) or {}).get("p_brand")) for i in asked]
    return spark.createDataFrame(rows, "p_partkey long, present boolean, p_brand string")


def snapshot_search(spark, sf_dir):
    index = _fresh(spark, sf_dir)
    index.discard_all(range(3, 150, 7))
    return scored(search(index, "red ring", details=False, sort=False, df_mode="snapshot"), "p_partkey")


def snapshot_overlap(spark, sf_dir):
    """The first search after discards where two query terms reach the same terms, some of which stand twice in a name."""
    twice = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    index = TextIndex.build(table(spark, sf_dir, "part").select("p_partkey", twice.alias("p_name")), IndexConfig(["p_name"], id_field="p_partkey", auto_vacuum=False))
    index.discard_all(table(spark, sf_dir, "part").where("p_partkey % 6 = 1").select(F.col("p_partkey").alias("id")))
    return scored(search(index, "red re rid", prefix=True, fuzzy=1, details=False, sort=False, df_mode="snapshot"), "p_partkey")


def auto_vacuum(spark, sf_dir):
    config = IndexConfig(["p_name"], id_field="p_partkey", auto_vacuum={"min_dirt_count": 12, "min_dirt_factor": 0.0})
    index = TextIndex.build(table(spark, sf_dir, "part"), config)
    index.discard_all(range(0, 11))
    before, dirt = index.postings.count(), index.dirt_count
    index.discard(11)
    return spark.createDataFrame([(before, dirt, index.postings.count(), index.dirt_count, index.document_count)], "postings_before long, dirt_before long, postings_after long, dirt_after long, document_count long")


def stringify_hook(spark, sf_dir):
    config = IndexConfig(["p_name", "p_size"], id_field="p_partkey", stringify=lambda value, name: F.concat(F.lit("size "), value.cast("string")) if name == "p_size" else value)
    return scored(search(TextIndex.build(table(spark, sf_dir, "part"), config), "size 7 ring", details=False, sort=False), "p_partkey")


def discards_with_missing_fields(spark, sf_dir):
    """Means after discards where not every document has every field."""
    docs = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("p_name"), "p_type")
    index = TextIndex.build(docs, IndexConfig(["p_name", "p_type"], id_field="p_partkey", auto_vacuum=False))
    index.discard_all(docs.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("id")))
    return spark.createDataFrame([(f, round(m, 9)) for f, m in index.means.items()], "field_id int, avg_len double")


def removals_in_order(spark, sf_dir):
    """Means after documents left in an order that is not by id, where not every document has every field."""
    docs = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("p_name"), "p_type", "p_size")
    index = TextIndex.build(docs, IndexConfig(["p_name", "p_type"], id_field="p_partkey", logger=None))
    index.remove_all(docs.where("p_partkey % 2 = 1"), order=[F.col("p_size").desc(), F.col("p_partkey").desc()])
    return spark.createDataFrame([(f, round(m, 9)) for f, m in index.means.items()], "field_id int, avg_len double")


# -- segments


def _segmented(spark, sf_dir, fanout=None) -> SegmentedIndex:
    """Three batches of parts, the last of which replaces one in five."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    index = SegmentedIndex.open(spark, new_path(spark, "segments"), IndexConfig(["p_name"], id_field="p_partkey", auto_vacuum=False), fanout=fanout)
    index.add_all(parts.where("p_partkey % 2 = 0"))
    index.add_all(parts.where("p_partkey % 2 = 1"))
    index.replace_all(parts.where("p_partkey % 5 = 0").withColumn("p_name", F.concat("p_name", F.lit(" renewed ring"))))
    return index


def segmented_search(spark, sf_dir):
    index = _segmented(spark, sf_dir)
    return scored(search(index.index(), "red ring renewed", details=False, sort=False), "p_partkey")


def segmented_topk(spark, sf_dir):
    """Merged segments have no tombstones, so the best are found by blocks."""
    index = _segmented(spark, sf_dir, fanout=2)
    index.vacuum()
    rows = search(index.index(), "red ring renewed", details=False, limit=25)
    return rows.select(F.round("score", 6).alias("score"), F.monotonically_increasing_id().alias("place"))


def segment_stats(spark, sf_dir):
    """Counters of segments before and after the vacuum of those that are worn by a fifth."""
    index = _segmented(spark, sf_dir)
    index.discard_all(table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("id")))
    shown = lambda: (len(index.segments), index.dirt_count, sum(s.postings for s in index.segments))
    before, worn = shown(), index.vacuum(min_share=0.3)
    return spark.createDataFrame([(*before, worn, *shown(), index.document_count)], "segments long, dirt long, postings long, rewritten long, segments_after long, dirt_after long, postings_after long, document_count long")


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows that a limit has brought into one partition, with their places."""
    return scored(rows, "doc_id", F.monotonically_increasing_id().alias("place"))


def result_order(spark, sf_dir):
    return _in_order(search(documents_index(spark, sf_dir), "the of and", details=False, limit=40))


def wildcard_order(spark, sf_dir):
    return _in_order(search(documents_index(spark, sf_dir), WILDCARD, details=False, limit=40))


def stream_ingest(spark, sf_dir):
    """The parts as a stream into a saved index, then a search on its last version."""
    base, config = new_path(spark, "stream"), IndexConfig(["p_name", "p_brand", "p_type"], id_field="p_partkey")
    schema = table(spark, sf_dir, "part").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/part.parquet*")
    ingest(stream, f"{base}/index", config, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    index = SegmentedIndex.open(spark, f"{base}/index", config).index()
    return scored(search(index, "cold plate", details=False, sort=False), "p_partkey")


def map_changes(spark, sf_dir):
    names = _names(spark, sf_dir)
    names.set("zebra", 5)
    names.update("zebra", lambda v: v + 1)
    names.fetch("newcomer", lambda: 9)
    names.delete("red ring")
    return names.rows


def map_lookups(spark, sf_dir):
    names = _names(spark, sf_dir)
    near = names.fuzzy_get("cold ring", 2)
    first, total = names.sorted_rows().agg(F.min("key"), F.sum("value")).first()
    visited = spark.sparkContext.accumulator(0)
    names.each(lambda key, value: visited.add(value))
    if visited.value != total:
        raise ValueError("entries were not visited once each")
    again = PrefixMap.from_rows(names.sorted_rows())
    again.clear()
    rows = [(names.size, names.has("red ring"), names.has("no such"), names.get("red ring"), names.get("no such"), first, total, len(near), again.size)]
    return spark.createDataFrame(rows, "size long, has_one boolean, has_none boolean, value_of long, value_of_none long, first_key string, total long, near long, cleared long")


def _names(spark, sf_dir) -> PrefixMap:
    return PrefixMap(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("value")))


def prefix_map(spark, sf_dir):
    return _names(spark, sf_dir).at_prefix("re").at_prefix("red ").rows


def fuzzy_map(spark, sf_dir):
    return _names(spark, sf_dir).fuzzy("cold ring", 3).select("key", "value", F.col("distance").cast("long").alias("distance"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize_default": tokenize_default,
    "token_counts": token_counts,
    "field_lengths": field_lengths,
    "postings_build": postings_build,
    "lexicon": lexicon,
    "term_df": term_df,
    "avg_field_length": avg_field_length,
    "index_counters": counters,
    "search_exact_or": found(q="the nation erst"),
    "search_duplicate_terms": found(q="erst the erst"),
    "search_and": found(q="the of and", combine_with="AND"),
    "search_and_not": found(q="the nation erst", combine_with="AND_NOT"),
    "search_tree": search_tree,
    "search_multifield": found_parts(q="red ring economy brand"),
    "search_boost": found_parts(q="red economy", boost={"p_name": 3, "p_type": 0.5}),
    "search_fields": found_parts(q="red economy small", fields=["p_type"], boost={"p_name": 2}),
    "search_prefix": found(q="thati erst", prefix=True),
    "search_fuzzy": found(q="nation thand", fuzzy=0.2),
    "search_prefix_fuzzy": found(q="erst thand whouther", prefix=True, fuzzy=0.2),
    "search_fuzzy_two": found(q="erstha", fuzzy=2),
    "search_bm25_params": found(q="the nation erst", bm25={"k": 2.0, "b": 0.3, "d": 0.1}),
    "search_weights": found(q="erst thand", prefix=True, fuzzy=1, weights={"prefix": 0.9, "fuzzy": 0.1}),
    "search_filter": search_filter,
    "search_boost_document": search_boost_document,
    "search_boost_term": found(q="the erst", boost_term=lambda term, i, terms: 1 + 2 * i),
    "search_wildcard": search_wildcard,
    "wildcard_and_not": wildcard_and_not,
    "search_topk": search_topk,
    "search_batch": search_batch_top,
    "match_terms": match_terms,
    "suggest_prefix": suggest_prefix,
    "suggestions_beforehand": suggestions_beforehand,
    "stopwords": stopwords,
    "synonyms": synonyms,
    "hash_tokenizer": hash_tokenizer,
    "python_analyzer": python_analyzer,
    "extract_hook": extract_hook,
    "search_time_analysis": search_time_analysis,
    "default_options": default_options,
    "changed_documents": changed_documents,
    "refusals": refusals,
    "nullable_field_mean": nullable_field_mean,
    "discard_search": discard_search,
    "vacuum_stats": vacuum_stats,
    "replace_search": replace_search,
    "remove_search": remove_search,
    "json_roundtrip": json_roundtrip,
    "saved_search": saved_search,
    "json_version_1": json_version_1,
    "emptied_and_filled": emptied_and_filled,
    "has_and_stored_fields": has_and_stored_fields,
    "snapshot_search": snapshot_search,
    "snapshot_overlap": snapshot_overlap,
    "auto_vacuum": auto_vacuum,
    "stringify_hook": stringify_hook,
    "discards_with_missing_fields": discards_with_missing_fields,
    "search_fuzzy_callable": found(q="nation erst thand", fuzzy=lambda term, i, terms: 0.2 if i % 2 == 0 else False),
    "search_fuzzy_three": found(q="ertheation", fuzzy=3),
    "search_max_fuzzy": found(q="whoutherthand nation", fuzzy=0.5, max_fuzzy=1),
    "search_no_fuzzy": found(q="erst nation the", fuzzy=0.5, max_fuzzy=0),
    "result_order": result_order,
    "wildcard_order": wildcard_order,
    "stream_ingest": stream_ingest,
    "map_changes": map_changes,
    "map_lookups": map_lookups,
    "prefix_map": prefix_map,
    "fuzzy_map": fuzzy_map,
    "removals_in_order": removals_in_order,
    "segmented_search": segmented_search,
    "segmented_topk": segmented_topk,
    "segment_stats": segment_stats,
    "topk_by_blocks": best_by_blocks("the of and", 40),
    "topk_rare_by_blocks": best_by_blocks("the erst nation", 10),
    "topk_and_by_blocks": best_by_blocks("the of and", 15, combine_with="AND"),
    "topk_tree_by_blocks": best_by_blocks(tree(tree("the", "of", combine_with="AND"), "nation", combine_with="AND_NOT"), 15),
    "batch_by_blocks": batch_by_blocks,
    "batch_by_buckets": batch_by_buckets,
    "batch_by_neighbours": batch_by_neighbours,
    "fuzzy_by_neighbours": fuzzy_by_neighbours,
}
