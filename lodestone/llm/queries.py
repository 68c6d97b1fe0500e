"""The driver's queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import materialize, narrow_join, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.embedding_dedup import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.sharding import shard_rows

    rows = shard_rows(table(spark, sf_dir, "documents"), n_shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def tokenizer_ranks() -> bytes:
    """The rank file of op3, as bytes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        return file.read()


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.byte_bpe import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_ranks(), public_tokenizers.PATTERN)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).withColumnsRenamed({"mix_copy": "copy", "mix_order": "order_key"}).drop("mix_rate")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.simhash import fingerprint_edits, near_fingerprints

    rows = materialize(fingerprint_edits(table(spark, sf_dir, "documents")), "edits")
    near = materialize(near_fingerprints(rows, radius=3), "near")
    return narrow_join(rows, near, "fingerprint", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long"))).select(*rows.columns, "n_near")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("terms")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lexical_search import search_items

    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.periodic_runs import find_runs, repeat_tail

    rows = find_runs(table(spark, sf_dir, "documents"), edit=repeat_tail)
    # a reduction from the left: of runs of equal length the first stays, and they stand by start and period
    longest = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] > best["length"], r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = rows.withColumn("r", longest)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import decontaminate

    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.sql import SQL

    return dict(SQL)
