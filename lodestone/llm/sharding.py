"""Reproducible shuffle and sharding by a keyed permutation of global row numbers (DataFrame functions only).

Rows get global numbers 0..N-1 in the order (key, size, checksum).  A balanced Feistel network over a x b >= N with
cycle walking permutes 0..N-1; ``position = perm(number)``, ``shard = position mod n_shards`` and
``slot = position div n_shards``.  Law ``rows``: shard sizes differ by one at most, slots are gapless, and shard and slot
of a row number can be computed without the data.

Defined results: a null text has no bytes (size 16) and checksum 0; a null key sorts first; rows that tie in
(key, size, checksum) are interchangeable, so that the multiset of result rows is the same in every run; an empty table
gives an empty result; other input columns, whatever their names, are ignored by ``shard_rows``.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import materialize, partitions

ROUNDS = 6
COLUMNS = ("size", "text_crc32", "row_number", "position", "shard", "slot")


def _python_round(seed: int, r: int, half: int) -> int:
    first = xxhash.xxh64_intdigest(struct.pack("<q", seed * 1000 + r), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<q", half), seed=first)


def permute_number(x: int, n: int, seed: int) -> int:
    """The position of row number ``x`` among ``n``: the same law as the DataFrame form, for one number."""
    a, b = _sides(n)
    while True:
        x = _once(x, a, b, seed)
        if x < n:
            return x


def _sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _once(x: int, a: int, b: int, seed: int) -> int:
    left, right = divmod(x, b)
    for r in range(0, ROUNDS, 2):
        left = (left + _python_round(seed, r, right) % (1 << 62)) % a
        right = (right + _python_round(seed, r + 1, left) % (1 << 62)) % b
    return left * b + right


def walk_length(n: int, seed: int) -> int:
    """Most steps outside 0..n-1 that any walk takes; there are fewer than sqrt(n) + 1 numbers outside."""
    a, b = _sides(n)
    outside, steps = set(range(n, a * b)), 0
    while outside:
        after = {y for y in (_once(x, a, b, seed) for x in outside) if y >= n}
        steps += 1
        if len(after) == len(outside):  # only closed cycles are left, which no walk enters
            break
        outside = after
    return steps


def _permuted(df: DataFrame, number: str, n: int, seed: int) -> DataFrame:
    a, b = _sides(n)
    df = df.withColumn("_x", F.col(number))
    for step in range(1 + walk_length(n, seed)):
        df = df.withColumn("_l", F.expr(f"_x div {b}L")).withColumn("_r", F.expr(f"_x % {b}L"))
        for r in range(0, ROUNDS, 2):
            mix = lambda k, half: F.expr(f"pmod(xxhash64({seed * 1000 + k}L, {half}) & {(1 << 62) - 1}L, {a if half == '_r' else b}L)")
            df = df.withColumn("_l", (F.col("_l") + mix(r, "_r")) % F.lit(a)).withColumn("_r", (F.col("_r") + mix(r + 1, "_l")) % F.lit(b))
        y = F.col("_l") * F.lit(b) + F.col("_r")
        df = df.withColumn("_x", y if step == 0 else F.when(F.col("_x") < n, F.col("_x")).otherwise(y))
    return df.withColumn("position", F.col("_x")).drop("_x", "_l", "_r")


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 40, seed: int = 7) -> DataFrame:
    """Columns: key, size, text_crc32, row_number, position, shard, slot; one row for each row of ``df``.

    A key column that has the name of another of these comes out with an underscore behind its name.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    named = key + "_" * (key.lower() in COLUMNS)
    narrow = df.select(
        F.col(key).alias("_key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = [F.col("_key").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    # The order is by value, so numbers do not depend on where the sampled range bounds fall.
    ranged = narrow.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = materialize(ranged.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).drop("_id"), "rows")
    # One row for each partition of the shuffle: their count does not grow with the rows of a partition.
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    n = kept.count()
    numbered = kept.join(offsets, "_part").withColumn("row_number", F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")
    out = _permuted(numbered, "row_number", n, seed)
    out = out.withColumn("shard", (F.col("position") % n_shards).cast("int")).withColumn("slot", F.expr(f"position div {n_shards}L"))
    return out.select(F.col("_key").alias(named), *COLUMNS)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", n_shards: int = 40, seed: int = 7, shard: str = "shard_number") -> None:
    """Write ``df`` as one folder ``<shard>=i`` for each shard, rows in slot order; ``shard`` must be a new name.

    Rows meet their slot by (key, size, checksum) and an ordinal within equal ones, so repeated rows keep their count.
    """
    if shard.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {shard} is there already")
    made = shard_rows(df.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t", n_shards, seed)
    same = Window.partitionBy("k", "s", "c")
    slots = made.select("k", F.col("size").alias("s"), F.col("text_crc32").alias("c"), F.col("shard").alias("to"), "slot").withColumn("i", F.row_number().over(same.orderBy("slot")))
    # the rows travel as one struct, so their columns may have any names
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(key).alias("k"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("s"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("c"))
    rows = rows.withColumn("i", F.row_number().over(same.orderBy("s")))
    on = rows["k"].eqNullSafe(slots["k"]) & (rows["s"] == slots["s"]) & (rows["c"] == slots["c"]) & (rows["i"] == slots["i"])
    placed = rows.join(slots, on).select("row", "to", "slot").repartition(partitions(df.sparkSession), "to").sortWithinPartitions("to", "slot")
    placed.select(*[F.col("row")[c].alias(c) for c in df.columns], F.col("to").alias(shard)).write.partitionBy(shard).parquet(path)
