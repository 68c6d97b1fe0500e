"""Incremental ingest of a stream of documents into a segmented index (an extension; the batch operators do not need it)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodestone.functions.scratch import kept, remove
from lodestone.operators.index import IndexConfig
from lodestone.operators.segments import FANOUT, SegmentedIndex


def ingest(stream: DataFrame, path: str, config: IndexConfig, checkpoint: str, newest: Sequence[Any] | None = None, fanout: int | None = FANOUT) -> DataStreamWriter:
    """A writer that adds each micro-batch to the index below ``path`` as one version of it, with one segment more.

    What is written is in proportion to the batch: its own segment and the tombstones of the documents that it replaces, and
    now and then a merge of segments of like size.  The version names its batch, so one that is delivered again after a
    failure is not added twice.  Of several rows of an id within a batch the greatest by ``newest`` stays (columns of the
    row; by default all of its columns, as JSON); known ids are replaced.
    """

    def add(batch: DataFrame, number: int) -> None:
        index = SegmentedIndex.open(batch.sparkSession, path, config, fanout=fanout)
        if number <= index.manifest.batch:
            return
        turn = F.struct(*newest) if newest else F.to_json(F.struct(*batch.columns))
        row = F.struct(*batch.columns)
        rows = batch.groupBy(config.column(config.id_field).alias("_id")).agg(F.max_by(row, turn).alias("row")).select("row.*")
        rows = kept(rows, "batch")
        if not rows.isEmpty():
            index.replace_all(rows, batch=number)
        remove(rows)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
