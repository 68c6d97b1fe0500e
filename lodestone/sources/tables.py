"""Indexes as parquet tables: postings and terms sorted by term within files, so that term conditions skip row groups."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators.index import IndexConfig, TextIndex


def save(index: TextIndex, path: str, files: int | None = None) -> None:
    """Write docs, lengths, postings and counters below ``path``; ranges of (term, document) split frequent terms."""
    postings = index.postings.repartitionByRange(*([files] if files else []), "term", "doc_ord").sortWithinPartitions("term", "field_id", "doc_ord")
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    index.terms.repartitionByRange(*([files] if files else []), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    if index.docs is not None:
        index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    meta = {"fields": list(index.config.fields), "means": {str(k): v for k, v in index.means.items()}, "document_count": index.document_count, "next_ord": index.next_ord, "dirt_count": index.dirt_count, "docs": index.docs is not None}
    index.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, config: IndexConfig) -> TextIndex:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    index = TextIndex(spark, dataclasses.replace(config, fields=meta["fields"]))
    index.postings, index.lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    index._terms = spark.read.parquet(f"{path}/terms")
    index.docs = spark.read.parquet(f"{path}/docs") if meta["docs"] else None
    index.means = {int(k): v for k, v in meta["means"].items()}
    index.document_count, index.next_ord, index.dirt_count = meta["document_count"], meta["next_ord"], meta["dirt_count"]
    return index


def lexicon_like(path: str, spark: SparkSession, prefix: str):
    """Terms of a saved index that start with ``prefix``, by a filter that reaches the scan."""
    return spark.read.parquet(f"{path}/terms").where(F.col("term").startswith(prefix)).select("term").distinct()
