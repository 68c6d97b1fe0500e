"""A bulk-built index in buckets by term, so that batches of queries meet postings without moving them.

Postings and counts lie in the same number of buckets by (term, part).  A term's postings are one part, or, where they are
more than ``PART``, as many as keep parts about that size, dealt by document; its counts stand beside each of its parts.
Query terms, counts and postings then join bucket by bucket, and nothing is exchanged before documents are added up.

The files are plain parquet; ``load`` tells the session's catalog how they are bucketed.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import IndexConfig, TextIndex

#: Postings of a part at most, about.
PART = 4_000_000
BUCKETS = 64
POSTINGS = "term string, part int, field_id int, doc_ord long, tf long, len long"
COUNTS = "term string, part int, counts map<int,bigint>"


def save(index: TextIndex, path: str, buckets: int = BUCKETS, part: int = PART) -> None:
    """Write an index without discarded documents below ``path``."""
    if index.dirt_count:
        raise ValueError("only an index without discarded documents is bucketed; vacuum it first")
    by_term = index.terms.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "df")))).alias("counts"), F.sum("df").alias("n"))
    by_term = by_term.withColumn("parts", F.expr(f"CAST(1 + (n - 1) div {part} AS INT)"))
    # frequent terms have more than a part's postings each, so there are few
    frequent = F.broadcast(by_term.where("parts > 1").select("term", "parts"))
    deal = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_ord"), F.col("parts"))).cast("int")
    postings = index.postings.join(frequent, "term", "left").select("term", deal.alias("part"), "field_id", "doc_ord", "tf", "len")
    counts = by_term.select("term", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "counts")
    for name, rows in (("postings", postings), ("counts", counts)):
        table = f"lodestone_{uuid.uuid4().hex}"
        rows.repartition(buckets, "term", "part").write.bucketBy(buckets, "term", "part").sortBy("term", "part").option("path", f"{path}/{name}").format("parquet").saveAsTable(table)
        index.spark.sql(f"DROP TABLE {table}")  # the files stay
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    meta = {"buckets": buckets, "fields": list(index.config.fields), "means": {str(k): v for k, v in index.means.items()}, "document_count": index.document_count, "next_ord": index.next_ord}
    index.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _table(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    name = f"lodestone_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (term, part) SORTED BY (term, part) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def load(spark: SparkSession, path: str, config: IndexConfig) -> TextIndex:
    """The index below ``path``; ``search_batch`` uses its buckets."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    index = TextIndex(spark, dataclasses.replace(config, fields=meta["fields"]))
    index.buckets = _table(spark, f"{path}/postings", POSTINGS, meta["buckets"]), _table(spark, f"{path}/counts", COUNTS, meta["buckets"])
    postings, counts = index.buckets
    index.postings = postings.select("term", "field_id", "doc_ord", "tf", "len")
    index._terms = counts.where("part = 0").select("term", F.explode("counts").alias("field_id", "df"))
    index.docs, index.lengths = spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/lengths")
    index.means = {int(k): v for k, v in meta["means"].items()}
    index.document_count, index.next_ord = meta["document_count"], meta["next_ord"]
    return index
