"""Running means over long runs of rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions.numbering import telescoped


def test_telescoped_adds_up_each_row_once(spark, monkeypatch):
    """Frames that end at the last row are added up anew for each row, which is quadratic in a block."""
    rows = spark.range(1, 200_001).select(F.lit(0).alias("f"), F.col("id").alias("j"))
    frame, plans = type(rows), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: (plans.append(df._jdf.queryExecution().toString()), collect(df))[1])
    found = telescoped(rows, "f", "j", (F.col("j") - 1) / F.col("j"), (F.col("j") % 7) / F.col("j"))
    assert plans and not any("unboundedfollowing" in p.lower() for p in plans)
    s, product = found[0]
    assert s == pytest.approx(math.fsum(j % 7 for j in range(1, 200_001)) / 200_000, rel=1e-9)
    assert product == 0
