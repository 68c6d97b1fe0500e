"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated K times, K drawn from a Poisson distribution whose mean is the target repetition rate
``rate(s) = total * weight(s) / (sum of weights * rows(s))``.  K is the inverse of the distribution at a uniform number
seeded by the hash of (seed, key), so it is the same in every run and on any layout.  Copies are exploded and dealt to
partitions and ordered by a hash of (seed, key, copy): a global shuffle.

Defined results: a null source is a source of its own; rows with equal keys draw equal counts; a null key hashes as the
text ``null``; sources without a weight take ``default_weight``; weight 0 removes a source; an empty table gives an empty
result; text is carried untouched, null or not.  Columns of the input may have any names (the operator's own start with
``mix_``; clashing ones are refused).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import materialize, narrow_join, partitions

#: Means over this are drawn as a sum of independent parts, so that exp(-mean) stays a normal number.
PART = 50.0
#: Copies of a document that are made in one go.
CHUNK = 4096


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the parts' MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """Smallest k with P(X <= k) >= u, for means up to ``PART``.  Beyond the last term no double is left below 1."""
    last = F.ceil(mean + 9 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))
    step = lambda s, i: F.when(s["cdf"] >= u, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / i).alias("p"), (s["cdf"] + s["p"] * mean / i).alias("cdf")))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def draw(mean: Column, seed: int, key: Column) -> Column:
    """A Poisson count: the sum of as many equal parts as the mean needs, each from a uniform number of its own.

    The plan does not grow with the mean, and the work for a document is in proportion to the copies that come of it.
    """
    parts = F.greatest(F.lit(1), F.ceil(mean / PART).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0).cast("long"), lambda n, i: n + poisson_inverse(uniform(F.lit(seed), key, i), mean / parts))


def rates(df: DataFrame, source: str, weights: dict | None, total: int | None, default_weight: float = 1.0) -> DataFrame:
    """(mix_source, mix_rows, mix_rate) of each source; ``total`` defaults to the input's rows."""
    counts = df.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("mix_rows"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = materialize(counts.withColumn("mix_weight", weight), "sources")
    n, w = counts.agg(F.sum("mix_rows"), F.sum("mix_weight")).first()
    if not w:
        return counts.select("mix_source", "mix_rows", F.lit(0.0).alias("mix_rate"))
    target = float(n if total is None else total)
    return counts.select("mix_source", "mix_rows", (F.lit(target) * F.col("mix_weight") / F.lit(float(w)) / F.col("mix_rows")).alias("mix_rate"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: dict | None = None, total: int | None = None, seed: int = 11) -> DataFrame:
    """``df``'s columns and mix_rate, mix_copy (from 0) and mix_order, globally shuffled.

    The rates are one row for each source, counted and broadcast up to a bound, so rows are exchanged once: by the shuffle
    itself, which is of the copies.
    """
    clash = [c for c in df.columns if c.lower().startswith("mix_")]
    if clash:
        raise ValueError(f"columns {clash} clash with the operator's own")
    spark = df.sparkSession
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  a null source is one of its own
    per_source = rates(df, source, weights, total).select(named(F.col("mix_source")).alias("mix_key"), "mix_rate")
    joined = narrow_join(df.withColumn("mix_key", named(F.col(source))), per_source, "mix_key").drop("mix_key")
    drawn = joined.withColumn("mix_n", draw(F.col("mix_rate"), seed, F.col(key))).where("mix_n > 0")
    chunks = drawn.withColumn("mix_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(mix_n - 1) div {CHUNK}"))))
    of_chunk = F.sequence(F.col("mix_chunk") * CHUNK, F.least(F.col("mix_n"), (F.col("mix_chunk") + 1) * CHUNK) - 1)
    copies = chunks.withColumn("mix_copy", F.explode(F.transform(of_chunk, lambda i: i.cast("int")))).drop("mix_n", "mix_chunk")
    shuffled = copies.withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("mix_copy").cast("string"))))
    return shuffled.repartition(partitions(spark), "mix_order").sortWithinPartitions("mix_order")
