"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from lodestone import IndexConfig, TextIndex, catalog, search_batch
from lodestone.sources import tables

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["search_exact_or", "search_and", "search_tree", "search_prefix", "search_fuzzy", "search_prefix_fuzzy", "search_multifield", "search_topk", "search_batch", "match_terms", "suggest_prefix"]


#: The published benchmark's generator.
SEED, MULTIPLIER, INCREMENT, MASK = 424_242, 1_103_515_245, 12_345, 0x7FFFFFFF
ONSETS = "b c d f g h j k l m n p r s t v w z br cr dr fr gr pl st tr ch sh th".split()
VOWELS = "a e i o u ai ea ou ie".split()
CODAS = "b d g k l m n p r s t x ck ng nt st rd".split()
WORDS, QUERIES = 8_000, 2_000


class Draws:
    """A linear congruential stream of numbers in 0..1."""

    def __init__(self, state: int = SEED):
        self.state = state

    def number(self) -> float:
        self.state = (self.state * MULTIPLIER + INCREMENT) & MASK
        return self.state / MASK

    def upto(self, n: int, power: int = 1) -> int:
        return min(n - 1, int(n * self.number() ** power))

    def syllable(self) -> str:
        head = ONSETS[self.upto(len(ONSETS))] + VOWELS[self.upto(len(VOWELS))]
        return head + (CODAS[self.upto(len(CODAS))] if self.number() < 0.5 else "")

    def word(self) -> str:
        return "".join(self.syllable() for _ in range(1 + self.upto(2)))


def synthetic(spark: SparkSession, n: int):
    """The published benchmark's documents and queries: syllable words, cubed-uniform ranks, titles of 2 to 5 words, bodies
    of 20 to 99, queries of 1 or 2."""
    draws = Draws()
    words = list(dict.fromkeys(draws.word() for _ in range(WORDS)))
    text = lambda low, spread: " ".join(words[draws.upto(len(words), 3)] for _ in range(low + draws.upto(spread)))
    rows = [(i, text(2, 4), text(20, 80)) for i in range(n)]
    queries = [(i, text(1, 2)) for i in range(QUERIES)]
    return spark.createDataFrame(rows, "id long, title string, body string").cache(), spark.createDataFrame(queries, "query_id long, text string").cache()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    try:
        run(spark.range(1000).groupBy("id").count())  # the session's start is not a query
        seconds["build_documents_index"] = timed(lambda: catalog.documents_index(spark, SF_DIR).postings.count())
        catalog.parts_index(spark, SF_DIR).postings.count()
        seconds["save_documents_index"] = timed(lambda: tables.save(catalog.documents_index(spark, SF_DIR), f"{folder}/index"))
        for name in HEADLINE:
            seconds[name] = timed(lambda name=name: run(catalog.QUERIES[name](spark, SF_DIR)))
        docs, queries = synthetic(spark, 5000)
        docs.count(), queries.count()
        made: list[TextIndex] = []
        seconds["synthetic_build_5000"] = timed(lambda: (made.append(TextIndex.build(docs, IndexConfig(["title", "body"])).cache()), made[0].postings.count()))
        for name, options in (("exact", {}), ("prefix", {"prefix": True}), ("fuzzy", {"fuzzy": 0.2})):
            seconds[f"synthetic_batch_{name}_2000"] = timed(lambda options=options: run(search_batch(made[0], queries, k=None, **options)))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    rates = {"build_docs_per_s": round(5000 / seconds["synthetic_build_5000"]), **{f"{x}_queries_per_s": round(QUERIES / seconds[f"synthetic_batch_{x}_2000"]) for x in ("exact", "prefix", "fuzzy")}}
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rates": rates, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
