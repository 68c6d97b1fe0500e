"""Dense row numbers and order-dependent means without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scratch import kept


def number_rows(df: DataFrame, order: list, name: str, start: int = 0, columns: list | None = None) -> DataFrame:
    """``df`` (or its narrow ``columns``) with gapless numbers from ``start`` in the given total order.

    Rows are range-partitioned and sorted; a row's number is its place in its partition after the rows of the partitions
    before.  The placed rows are written, because range bounds are sampled anew by each evaluation.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(columns or df.columns), F.monotonically_increasing_id().alias("_at"))
    return gapless(kept(placed, "placed"), "_at", name, start)


def gapless(rows: DataFrame, at: str, name: str, start: int = 0) -> DataFrame:
    """``rows`` with gapless numbers from ``start`` in place of ``at``, which held ``monotonically_increasing_id()`` of the plan
    that wrote them: a row's place in its partition, after the rows of the partitions before."""
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))  # a row for each partition
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before + start).alias("_offset"))
    return rows.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + place).drop("_part", "_offset", at)


def in_order(rows: DataFrame, key: str, at: str) -> bool:
    """Whether ``key`` rises strictly in the order of ``at``, which holds ``monotonically_increasing_id()`` of the plan that wrote
    the rows: within each partition, and from one to the next."""
    rows = rows.select(F.shiftright(at, 33).alias("part"), F.col(at).alias("at"), F.col(key).alias("key"))
    falls = lambda low, high: F.coalesce(low >= high, F.lit(False)).cast("int")
    before = F.lag("key").over(Window.partitionBy("part").orderBy("at"))
    parts = rows.select("part", "key", falls(before, F.col("key")).alias("fall")).groupBy("part").agg(F.max("fall").alias("fall"), F.min("key").alias("low"), F.max("key").alias("high"))
    before = F.lag("high").over(Window.orderBy("part"))  # a row for each partition
    return not parts.select(F.greatest("fall", falls(before, F.col("low"))).alias("fall")).agg(F.max("fall")).first()[0]


def telescoped(rows: DataFrame, field: str, position: str, factor: Column, term: Column) -> dict[int, tuple[float, float]]:
    """For each field: the sum over its rows of ``term`` times the factors of all later rows, and the product of all factors.

    Products are sums of logarithms; a factor of 0 is told apart.  They are added up within blocks of positions first, so
    no task sees more than a block.  Windows run backwards from the last row: a frame that ends at the last row would be added
    up anew for each row.
    """
    block = 1 << 16
    rows = rows.select(F.col(field).alias("f"), F.col(position).alias("j"), factor.cast("double").alias("a"), term.cast("double").alias("s")).withColumn("g", F.expr(f"j div {block}"))
    rows = rows.withColumns({"w": F.when(F.col("a") > 0, F.log("a")).otherwise(F.lit(0.0)), "z": (F.col("a") <= 0).cast("int")})
    tail = Window.partitionBy("f", "g").orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumns({"after": F.coalesce(F.sum("w").over(tail), F.lit(0.0)), "ends": F.coalesce(F.sum("z").over(tail), F.lit(0))})
    alive = lambda x: F.when(F.col("ends") == 0, x).otherwise(F.lit(0.0))
    parts = inner.groupBy("f", "g").agg(F.sum(alive(F.col("s") * F.exp("after"))).alias("s"), F.sum("w").alias("w"), F.sum("z").alias("z"))
    later = Window.partitionBy("f").orderBy(F.col("g").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    parts = parts.withColumns({"after": F.coalesce(F.sum("w").over(later), F.lit(0.0)), "ends": F.coalesce(F.sum("z").over(later), F.lit(0))})
    sums = parts.groupBy("f").agg(F.sum(alive(F.col("s") * F.exp("after"))).alias("s"), F.sum("w").alias("w"), F.sum("z").alias("z"), F.exp(F.sum("w")).alias("p"))
    return {r["f"]: (r["s"], 0.0 if r["z"] else r["p"]) for r in sums.collect()}  # a row for each field
