"""Helpers that several operators use: table access, shared-folder materialisation, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch on its way to or from a Python worker; long texts make a batch of few rows.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a session whose executors run in the driver's process (tests); on a
    cluster a folder of one machine would lose rows, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete ``materialize``'s tables whose successors are written, and the shuffle files of finished queries.

    Spark deletes a shuffle's files when the driver collects the garbage that held it; a driver with memory to spare may
    not do so for half an hour, in which a long job's shuffles would add up on the executors' disks.
    """
    for df in tables:
        remove(df.sparkSession, df._written)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``, so that a worker's memory does not depend on text lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Edges, counted, up to which a round of ``components`` is one task; beyond, the same round shuffles.
ONE_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)`` for every node of an edge.

    ``component`` is the smallest node reachable.  Alternating large-star and small-star rounds: each round is two
    keyed aggregations and joins over the edges, so nothing is gathered on the driver, and the depth of the forest
    falls geometrically.  Rounds go on until the edges stay the same, however many it takes.  Self loops and repeated
    edges are harmless; nulls must be filtered by the caller.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    small = e.count() <= ONE_TASK
    joint = (lambda df: df.coalesce(1)) if small else (lambda df: df)  # rows of one partition need no exchange
    before = None
    while True:
        held, e = e, joint(e)
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # edges whose larger end is the centre keep a link to that centre's minimum
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        e1 = joint(big.unionByName(own)).where("u > v").distinct()
        # small star: smaller neighbours and the node itself point to the smallest neighbour
        m1 = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = joint(e1.join(m1, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m1.select("u", F.col("m").alias("v"))))
        after = materialize(e2.where("u > v").distinct(), "cc")
        now = tuple(joint(after).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        e = after
        remove(e.sparkSession, held._written)
        if now == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        before = now


#: Rows of a narrow table (a few numbers each) up to which it is broadcast; about 32 MB.
NARROW = 1_000_000


def narrow_join(rows: DataFrame, narrow: DataFrame, on: str, how: str = "inner", limit: int = NARROW) -> DataFrame:
    """``rows`` joined with a table of few columns: broadcast if it was counted at ``limit`` rows or fewer, else by shuffle.

    The result is the same either way; the broadcast spares shuffling the rows' texts.
    """
    small = narrow.limit(limit + 1).count() <= limit
    return rows.join(F.broadcast(narrow) if small else narrow, on, how)


def by_numbers(docs: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], back: Sequence[str]) -> DataFrame | None:
    """``run(docs)`` on whole-number keys in the order of ``docs``' own, which may be of any type that sorts.

    None where the keys are whole numbers already.  ``back``: the result's columns that hold keys.  Equal keys have equal
    numbers and a null key stays null, so ties, minima and repeats are as they would be.
    """
    kind = docs.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return None
    ids = docs.select(docs[key].alias("_own")).where("_own IS NOT NULL").distinct()
    ids = ids.repartitionByRange("_own").sortWithinPartitions("_own").select("_own", F.monotonically_increasing_id().alias("_number"))
    ids = materialize(ids, "keys")
    numbered = narrow_join(docs.withColumnRenamed(key, "_own"), ids, "_own", "left").withColumn(key, F.col("_number")).drop("_own", "_number")
    out = run(numbered)
    for name in back:
        own = ids.select(F.col("_number").alias(name), "_own")
        out = narrow_join(out, own, name, "left").withColumn(name, F.col("_own")).drop("_own").select(out.columns)
    return out
