"""From raw documents to token ids: five stages, each on what its predecessor kept.

Quality classifier and toxicity drop the documents they reject; of each group of near-duplicates the document with the
smallest id stays; sources are mixed to equal weights by replication; the last stage encodes the texts and decodes them.

Defined results: null and empty texts are good, clean and near-duplicates of nothing, so they stay and give no tokens; of
rows that repeat a document id the one with the longest text stays (of equally long ones the first in text order), rows
with a null id stay each; texts of any length are read whole; an empty table gives an empty result; further columns of
the documents are carried through all stages but the last, which has the columns of ``TOKENS``.  Columns that an operator
would make itself (``mix_...``) are refused before the first stage; all other names are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, jaccard_join, mixing, quality, toxicity
from lodestone.llm.queries import tokenizer_ranks
from lodestone.llm.shared import discard, materialize, narrow_join, table

#: Columns of the last stage's rows.
TOKENS = ("doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    kept = narrow_join(docs, gone, "doc_id", "left_anti")
    # Rows that repeat a document id are few, so only they are ordered.
    repeated = materialize(kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*[kept[c] for c in kept.columns]).alias("row")
    first = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text")
    several = narrow_join(kept, repeated, "doc_id", "left_semi").select(row, F.row_number().over(first).alias("place")).where("place = 1")
    return narrow_join(kept, repeated, "doc_id", "left_anti").unionByName(several.select("row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = byte_bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_ranks(), public_tokenizers.PATTERN, output="ids")
    return rows.withColumn("decoded_sha256", F.sha2("decoded", 256)).select(*TOKENS)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: Perplexities, lattices and tokens are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result on ``documents``; each stage's rows are written and reread, and deleted after the next one's."""
    docs = table(spark, sf_dir, "documents")
    clash = [c for c in docs.columns if c.lower().startswith("mix_")]
    if clash:
        raise ValueError(f"columns {clash} clash with an operator's own")
    written = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return docs
