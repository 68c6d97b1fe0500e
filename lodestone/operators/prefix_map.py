"""A map from strings to values as a DataFrame, with prefix views and fuzzy lookups."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans.query import SearchError


class PrefixMap:
    """(key, value) rows with distinct keys.  Changes replace the DataFrame; a prefix view shares its rows."""

    def __init__(self, rows: DataFrame, prefix: str = ""):
        self.rows, self.prefix = rows.select("key", "value"), prefix

    @classmethod
    def of(cls, spark: SparkSession, entries: Iterable[tuple[str, Any]] | Mapping[str, Any], value: T.DataType | None = None) -> PrefixMap:
        """From pairs or a mapping; of equal keys the last value stays."""
        found = dict(entries.items() if isinstance(entries, Mapping) else entries)
        for key in found:
            cls._check(key)
        schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", value or T.LongType())])
        return cls(spark.createDataFrame(list(found.items()), schema))

    @staticmethod
    def _check(key: Any) -> str:
        if not isinstance(key, str):
            raise SearchError("key must be a string")
        return key

    def at_prefix(self, prefix: str) -> PrefixMap:
        """The entries whose keys start with ``prefix``, which must go on from this view's own."""
        if not prefix.startswith(self.prefix):
            raise SearchError("mismatched prefix")
        return PrefixMap(self.rows.where(F.col("key").startswith(prefix)), prefix)

    def clear(self) -> None:
        self.rows = self.rows.where(F.lit(False))

    def delete(self, key: str) -> None:
        self.rows = self.rows.where(F.col("key") != self._check(key))

    def get(self, key: str) -> Any:
        rows = self.rows.where(F.col("key") == self._check(key)).limit(1).collect()
        return rows[0]["value"] if rows else None

    def has(self, key: str) -> bool:
        """Also for a key whose value is null."""
        return not self.rows.where(F.col("key") == self._check(key)).isEmpty()

    def set(self, key: str, value: Any) -> None:
        one = self.rows.sparkSession.createDataFrame([(self._check(key), value)], self.rows.schema)
        self.rows = self.rows.where(F.col("key") != key).unionByName(one)

    def update(self, key: str, change: Callable[[Any], Any]) -> None:
        self.set(key, change(self.get(self._check(key))))

    def fetch(self, key: str, initial: Callable[[], Any]) -> Any:
        """The value, set to ``initial()`` first if the key is absent."""
        if not self.has(key):
            self.set(key, initial())
        return self.get(key)

    def fuzzy(self, key: str, distance: int) -> DataFrame:
        """(key, value, distance) of keys within ``distance`` edits."""
        n = len(self._check(key))
        edits = F.levenshtein("key", F.lit(key), distance)
        rows = self.rows.where(F.length("key").between(n - distance, n + distance)).withColumn("distance", edits)
        return rows.where("distance >= 0")

    def fuzzy_get(self, key: str, distance: int) -> dict[str, tuple[Any, int]]:
        return {r["key"]: (r["value"], r["distance"]) for r in self.fuzzy(key, distance).collect()}

    # -- over all entries, where they are

    @classmethod
    def from_rows(cls, rows: DataFrame) -> PrefixMap:
        """From ``rows(key, value)`` with distinct keys; nothing passes through the driver."""
        if not rows.where("key IS NULL").isEmpty():
            raise SearchError("key must be a string")
        return cls(rows)

    def sorted_rows(self) -> DataFrame:
        """(key, value) by key, in ranges that are sorted side by side."""
        return self.rows.orderBy("key")

    def each(self, visit: Callable[[str, Any], None]) -> None:
        """``visit(key, value)`` for every entry, by key within each range, on the executors that hold the ranges."""

        def over(rows: Iterator) -> None:
            for r in rows:
                visit(r["key"], r["value"])

        self.sorted_rows().foreachPartition(over)

    @property
    def size(self) -> int:
        return self.rows.count()

    def entries(self) -> Iterator[tuple[str, Any]]:
        """By key, one partition at a time through the driver; ``each`` and ``sorted_rows`` stay on the executors."""
        return ((r["key"], r["value"]) for r in self.rows.orderBy("key").toLocalIterator())

    __iter__ = entries

    def keys(self) -> list[str]:
        return [k for k, _ in self.entries()]

    def values(self) -> list[Any]:
        return [v for _, v in self.entries()]

    def to_dict(self) -> dict[str, Any]:
        return dict(self.entries())
