"""Top-k search that leaves out the documents that cannot be among the best.

Documents are cut into windows of ``WINDOW`` consecutive numbers.  For each term, field and window a block keeps the highest
term frequency and the shortest length of its postings; a match's weight rises with the one and falls with the other, so
a block bounds the weight of each of its postings, whatever the ranking's parameters.

1. The query is evaluated over blocks as it is over postings (a window stands for a document), which bounds the score of
   every document of a window.  Windows that cannot match at all, as where a term of an AND is absent, are gone already.
2. The most promising windows are ranked exactly, which gives a score that the k-th best document has at least.
3. All windows whose bound reaches that score are ranked exactly; the others' postings are not read.  Up to ``RANGES``
   stretches of windows stand as ranges of document numbers in the scan's filter, so that row groups are skipped; beyond
   that postings meet the windows by a join.

The result is that of the full ranking.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Workers get these functions with the task, so they need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents of a window.
WINDOW = 256
#: Postings over which bounds are taken at a time.
STRETCH = 1_000_000
#: Windows that are ranked first, at least.
FIRST = 16
#: Stretches of windows up to which they are literals of the postings' filter.
RANGES = 64
#: Windows up to which they are broadcast.
BROADCAST_WINDOWS = 1_000_000
#: Sums of doubles depend on the order of addition; a bound this close below the score is kept.
SLACK = 1 - 1e-9


def window_of(doc_ord: Column) -> Column:
    return F.shiftright(doc_ord, WINDOW.bit_length() - 1)


def block_bounds(postings: DataFrame) -> DataFrame:
    """(term, field_id, window, max_tf, min_len) of ``postings``."""
    return postings.groupBy("term", "field_id", window_of(F.col("doc_ord")).alias("window")).agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def local_bounds(postings: DataFrame) -> DataFrame:
    """The same without an exchange, of ``postings`` that lie by document: bounds are taken over ``STRETCH`` postings at a time, so a
    block may have several rows, which searches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= STRETCH:
                yield from _bounds(held)
                held, n = [], 0
        if n:
            yield from _bounds(held)

    rows = postings.select("term", "field_id", window_of(F.col("doc_ord")).alias("window"), "tf", "len")
    return rows.mapInArrow(run, "term string, field_id int, window long, max_tf long, min_len long")


def _bounds(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    found = pa.Table.from_batches(batches).group_by(["term", "field_id", "window"]).aggregate([("tf", "max"), ("len", "min")])
    return found.select(["term", "field_id", "window", "tf_max", "len_min"]).rename_columns(["term", "field_id", "window", "max_tf", "min_len"]).to_batches()


def within(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """``postings`` of the windows: by ranges in the scan's filter where they are few, else by a join."""
    found = windows.select("window").limit(BROADCAST_WINDOWS + 1)
    n = found.count()
    if n <= RANGES * 16:
        ranges = _ranges(sorted(r["window"] for r in found.collect()))
        if len(ranges) <= RANGES:
            return postings.where(reduce(lambda a, b: a | b, [F.col("doc_ord").between(low * WINDOW, (high + 1) * WINDOW - 1) for low, high in ranges], F.lit(False)))
    windows = windows.select("window")
    return postings.join(F.broadcast(windows) if n <= BROADCAST_WINDOWS else windows, window_of(F.col("doc_ord")) == F.col("window"), "left_semi")


def _ranges(numbers: list[int]) -> list[tuple[int, int]]:
    """Sorted numbers as stretches without gaps."""
    out: list[tuple[int, int]] = []
    for n in numbers:
        if out and n == out[-1][1] + 1:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def promising(bounds: DataFrame, k: int) -> DataFrame:
    """The windows (window, bound) with the highest bounds: enough for ``k`` documents if they are full."""
    return bounds.orderBy(F.col("bound").desc(), "window").limit(max(FIRST, -(-4 * k // WINDOW)))


def promising_of_each(bounds: DataFrame, k: int) -> DataFrame:
    """The same for each query of ``bounds(query_id, window, bound)``."""
    best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "window")
    return bounds.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= max(FIRST, -(-4 * k // WINDOW))).drop("_at")
