"""An index on disk in immutable segments, for appends, replacements and discards that write no more than they change.

Below the index's path:

* ``segments/<name>/{docs,lengths,postings,terms,blocks}`` (and ``neighbours``): one batch of documents, never changed once written;
* ``deletes/<name>``: the documents (``doc_ord``) that one commit took out of the segments it met (tombstones);
* ``manifests/version=<n>``: which segments and tombstones make up version ``n``, with the counters and mean lengths.

A commit writes new files first and its manifest last, so readers see whole versions, and a version stays readable until
``expire`` deletes what no kept version names.  One writer at a time: a second commit of the same version is refused.

Segments of like size are merged when ``fanout`` of them have come together, which drops their tombstones: each document
is rewritten about log(documents / batch) times to the base ``fanout``.  ``vacuum`` rewrites only the segments whose share of
tombstones is past a bound.  Searches run on ``index()``, which reads all segments as one table.
"""

from __future__ import annotations

import dataclasses
import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scratch import kept, remove
from lodestone.operators.index import AUTO_VACUUM, BROADCAST_IDS, IndexConfig, TextIndex, sent
from lodestone.operators.neighbours import neighbour_table
from lodestone.operators.topk import block_bounds
from lodestone.plans.query import SearchError

#: Segments of like size that are merged into one.
FANOUT = 8


@dataclass(frozen=True)
class Segment:
    """A batch of documents: how many it has, how many of them are tombstones, and the names of those."""

    name: str
    docs: int
    postings: int
    deleted: int = 0
    deletes: tuple[str, ...] = ()

    @property
    def share(self) -> float:
        return self.deleted / self.docs


@dataclass(frozen=True)
class Manifest:
    """One version of an index."""

    version: int
    fields: tuple[str, ...]
    segments: tuple[Segment, ...] = ()
    means: Mapping[int, float] = field(default_factory=dict)
    document_count: int = 0
    next_ord: int = 0
    dirt_count: int = 0
    #: Whether segments keep their lexicons by deletions.
    neighbours: bool = False
    #: The last micro-batch of a stream that is in this version.
    batch: int = -1

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @classmethod
    def of(cls, text: str) -> Manifest:
        d = json.loads(text)
        segments = tuple(Segment(**{**s, "deletes": tuple(s["deletes"])}) for s in d["segments"])
        return cls(**{**d, "fields": tuple(d["fields"]), "segments": segments, "means": {int(k): v for k, v in d["means"].items()}})


class SegmentedIndex:
    """A ``TextIndex`` kept on disk in segments."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig, manifest: Manifest, fanout: int | None = FANOUT):
        self.spark, self.path, self.manifest, self.fanout = spark, path.rstrip("/"), manifest, fanout
        self.config = dataclasses.replace(config, fields=list(manifest.fields))

    # -- versions

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: IndexConfig, version: int | None = None, fanout: int | None = FANOUT, neighbours: bool = False) -> SegmentedIndex:
        """The index at ``path`` in its last or the given version; a new, empty one where there is none, whose segments will keep
        ``neighbours`` for fuzzy terms."""
        rows = _manifests(spark, path)
        found = None
        if rows is not None:
            last = rows.agg(F.max("version")).first()[0] if version is None else version
            found = rows.where(F.col("version") == last).select("value").first()
        if found is None and version is not None:
            raise SearchError(f"the index has no version {version}")
        return cls(spark, path, config, Manifest.of(found[0]) if found else Manifest(0, tuple(config.fields), neighbours=neighbours), fanout)

    def versions(self) -> list[int]:
        rows = _manifests(self.spark, self.path)
        return sorted(r[0] for r in rows.select("version").collect()) if rows is not None else []

    def _commit(self, **changes: Any) -> None:
        """A manifest with ``changes`` as the next version; refused if another writer has made that one."""
        after = dataclasses.replace(self.manifest, version=self.manifest.version + 1, **changes)
        self.spark.createDataFrame([(after.to_json(),)], "value string").coalesce(1).write.text(f"{self.path}/manifests/version={after.version}")
        self.manifest = after

    def expire(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions, and the files that only those needed.  Gives how many files' folders went."""
        rows = _manifests(self.spark, self.path)
        if rows is None:
            return 0
        known = {m.version: m for m in (Manifest.of(r["value"]) for r in rows.select("value").collect())}  # a line for each version
        last = sorted(known)[-keep:]
        of = lambda versions: {f"segments/{s.name}" for v in versions for s in known[v].segments} | {f"deletes/{d}" for v in versions for s in known[v].segments for d in s.deletes}
        old = [v for v in known if v not in last]
        gone = of(old) - of(last)
        for folder in [*gone, *(f"manifests/version={v}" for v in old)]:
            _delete(self.spark, f"{self.path}/{folder}")
        return len(gone)

    # -- counters, as TextIndex has them

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def segments(self) -> tuple[Segment, ...]:
        return self.manifest.segments

    @property
    def document_count(self) -> int:
        return self.manifest.document_count

    @property
    def dirt_count(self) -> int:
        return self.manifest.dirt_count

    @property
    def dirt_factor(self) -> float:
        return self.dirt_count / (1 + self.document_count + self.dirt_count)

    # -- reading

    def _read(self, table: str, segments: Iterable[Segment]) -> DataFrame:
        """A table of several segments in one scan."""
        return self.spark.read.parquet(*[f"{self.path}/segments/{s.name}/{table}" for s in segments])

    def _deleted(self, segments: Iterable[Segment]) -> DataFrame | None:
        """(doc_ord) of the segments' tombstones, broadcast where the manifest's counts allow it; None if there are none."""
        names = sorted({d for s in segments for d in s.deletes})
        if not names:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/deletes/{d}" for d in names]).where(F.col("segment").isin([s.name for s in segments])).select("doc_ord")
        return F.broadcast(rows) if sum(s.deleted for s in segments) <= BROADCAST_IDS else rows

    def _live(self, table: str, segments: Sequence[Segment]) -> DataFrame:
        """A table's rows of documents that are not deleted; segments without tombstones are not joined."""
        clean, dirty = [s for s in segments if not s.deleted], [s for s in segments if s.deleted]
        parts = ([self._read(table, clean)] if clean else []) + ([self._read(table, dirty).join(self._deleted(dirty), "doc_ord", "left_anti")] if dirty else [])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def index(self) -> TextIndex:
        """This version as a ``TextIndex`` over the segments' files; changing that one changes nothing here."""
        m, out = self.manifest, TextIndex(self.spark, self.config)
        out.means, out.document_count, out.next_ord, out.dirt_count = dict(m.means), m.document_count, m.next_ord, m.dirt_count
        if not m.segments:
            return out
        out.docs, out.lengths = self._live("docs", m.segments), self._live("lengths", m.segments)
        out.postings = self._read("postings", m.segments)
        terms = self._read("terms", m.segments)
        out._terms = terms if len(m.segments) == 1 else terms.groupBy("term", "field_id").agg(F.sum("df").alias("df"))
        out._blocks = self._read("blocks", m.segments)
        out._neighbours = self._read("neighbours", m.segments) if m.neighbours else None
        return out

    # -- writing

    def _write(self, part: TextIndex, docs: int) -> Segment:
        """The tables of ``part`` as a new segment: postings by term and document, so that terms and places skip row groups."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        part.postings.repartitionByRange("term", "doc_ord").sortWithinPartitions("term", "field_id", "doc_ord").write.parquet(f"{at}/postings")
        postings = self.spark.read.schema(part.postings.schema).parquet(f"{at}/postings")
        postings.groupBy("term", "field_id").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        block_bounds(postings).repartitionByRange("term", "window").sortWithinPartitions("term", "window").write.parquet(f"{at}/blocks")
        if self.manifest.neighbours:
            neighbour_table(self.spark.read.parquet(f"{at}/terms").select("term").distinct()).write.parquet(f"{at}/neighbours")
        part.lengths.write.parquet(f"{at}/lengths")
        part.docs.write.parquet(f"{at}/docs")
        return Segment(name, docs, postings.count())

    def _append(self, base: Manifest, documents: DataFrame, order: Any, state: Mapping[str, Any]) -> None:
        """Commit ``base`` with the documents as one more segment, numbered and averaged as its next ones."""
        part = TextIndex(self.spark, self.config)
        part.means, part.document_count, part.next_ord = dict(base.means), base.document_count, base.next_ord
        try:
            part.add_all(documents, order)
            added = part.document_count - base.document_count
            if base.segments:
                met = self._live("docs", base.segments).select("id").join(sent(part.docs.select("id"), added), "id", "left_semi").limit(1).collect()
                if met:
                    raise SearchError(f"duplicate id {met[0]['id']}")
            more = (self._write(part, added),) if added else ()
            changes = {f.name: getattr(base, f.name) for f in dataclasses.fields(base) if f.name != "version"}
            self._commit(**changes | {"segments": base.segments + more, "means": part.means, "document_count": part.document_count, "next_ord": part.next_ord} | dict(state))
        finally:
            part.close()
        self.merge()

    def add_all(self, documents: DataFrame, order: Any = None, **state: Any) -> None:
        """Add documents as one segment.  All or none: ids must be present, new and distinct."""
        self._append(self.manifest, documents, order, state)

    def replace_all(self, documents: DataFrame, order: Any = None, **state: Any) -> None:
        """Add documents; those whose ids are known are discarded first, in the same order.  All or none, in one version."""
        base, c = self.manifest, self.config
        if self.segments:
            ident = c.column(c.id_field)
            turn = [F.struct(*order).alias("turn")] if order and not isinstance(order, str) else []
            asked = kept(documents.select(ident.alias("id"), *turn).dropDuplicates(["id"]), "asked")
            held = self._live("docs", self.segments).select("id").join(sent(asked.select("id"), asked.count()), "id", "left_semi")
            known = kept(asked.join(held, "id", "left_semi"), "known")
            if not known.isEmpty():
                base = self._tombstones(known, ["turn"] if turn else None)
            remove(known)
            remove(asked)
        self._append(base, documents, order, state)
        self._maybe_vacuum()

    def discard_all(self, ids: Iterable[Any] | DataFrame, order: Any = None) -> None:
        """Hide documents by tombstones, which are all that is written; the postings' files stay as they are."""
        if self._discard(ids, order):
            self._maybe_vacuum()

    def _discard(self, ids: Iterable[Any] | DataFrame, order: Any = None) -> bool:
        ids = ids if isinstance(ids, DataFrame) else list(ids)
        if ids.isEmpty() if isinstance(ids, DataFrame) else not ids:
            return False
        after = self._tombstones(ids, order)
        self._commit(segments=after.segments, means=after.means, document_count=after.document_count, dirt_count=after.dirt_count)
        return True

    def _tombstones(self, ids: Sequence[Any] | DataFrame, order: Any = None) -> Manifest:
        """What the manifest will be once the documents, whose tombstones are written here, have left in the given order."""
        view = self.index()
        view.config = dataclasses.replace(self.config, auto_vacuum=False)
        found = kept(self._located(view._found(view._placed(ids, order))), "leaving")
        counts = {r["segment"]: r["n"] for r in found.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row for each segment
        name = uuid.uuid4().hex
        found.select("segment", "doc_ord").repartitionByRange("segment", "doc_ord").write.parquet(f"{self.path}/deletes/{name}")
        gone = view._drop(found.select("id", "place", "doc_ord"))
        segments = tuple(dataclasses.replace(s, deleted=s.deleted + counts[s.name], deletes=(*s.deletes, name)) if s.name in counts else s for s in self.segments)
        for df in [found, *view._scratch]:
            remove(df)
        return dataclasses.replace(self.manifest, segments=segments, means=view.means, document_count=view.document_count, dirt_count=self.dirt_count + gone)

    def _located(self, found: DataFrame) -> DataFrame:
        """``found`` with the name of each document's segment, which is a folder in its file's path."""
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([0-9a-f]+)/docs/", 1)
        where = self._read("docs", self.segments).select("doc_ord", folder.alias("segment"))
        return where.join(sent(found, found.count()), "doc_ord")

    def remove_all(self, ids: Iterable[Any] | DataFrame, order: Any = None) -> None:
        """Take documents out at once: their segments, and no others, are rewritten without them, and leave no dirt."""
        before = {s.name: s for s in self.segments}
        dirt = self.dirt_count
        if not self._discard(ids, order):
            return
        met = [s for s in self.segments if s.deleted != before[s.name].deleted]
        last = {s.deletes[-1] for s in met}
        drop = self.spark.read.parquet(*[f"{self.path}/deletes/{d}" for d in last]).select("doc_ord")
        fresh = tuple(self._rewrite([s], drop) for s in met)
        # tombstones of earlier discards stay with the rewritten segment
        kept_dead = []
        for old, new in zip(met, fresh, strict=True):
            if new and (was := before[old.name]).deleted:
                kept_dead.append(self._moved(was, new))
            elif new:
                kept_dead.append(new)
        self._commit(segments=tuple(s for s in self.segments if s not in met) + tuple(kept_dead), dirt_count=dirt)

    def _moved(self, old: Segment, new: Segment) -> Segment:
        """``new`` with the tombstones of ``old``, whose place it takes."""
        name = uuid.uuid4().hex
        self._deleted([old]).select(F.lit(new.name).alias("segment"), "doc_ord").write.parquet(f"{self.path}/deletes/{name}")
        return dataclasses.replace(new, deleted=old.deleted, deletes=(name,))

    def _rewrite(self, segments: Sequence[Segment], drop: DataFrame | None) -> Segment | None:
        """One segment of the rows of ``segments`` without the documents ``drop(doc_ord)``; None if nothing is left."""
        part = TextIndex(self.spark, self.config)
        of = lambda table: self._read(table, segments) if drop is None else self._read(table, segments).join(drop, "doc_ord", "left_anti")
        part.docs, part.lengths, part.postings = of("docs"), of("lengths"), of("postings").select("term", "field_id", "doc_ord", "tf", "len")
        left = part.docs.count()
        return self._write(part, left) if left else None

    # -- upkeep

    def _maybe_vacuum(self) -> None:
        conditions = self.config.auto_vacuum
        if conditions in (None, True):
            conditions = AUTO_VACUUM
        if conditions and self.dirt_count >= conditions.get("min_dirt_count", AUTO_VACUUM["min_dirt_count"]) and self.dirt_factor >= conditions.get("min_dirt_factor", AUTO_VACUUM["min_dirt_factor"]):
            self.vacuum()

    def vacuum(self, min_share: float = 0.0) -> int:
        """Rewrite, without their tombstones, the segments of which ``min_share`` or more (and any) are; gives how many."""
        worn = [s for s in self.segments if s.deleted and s.share >= min_share]
        if worn:
            self._replaced({s.name: [s] for s in worn})
        return len(worn)

    def merge(self) -> int:
        """Merge segments of like size where ``fanout`` have come together, until there are no such; gives how many went."""
        went = 0
        while self.fanout:
            tiers = defaultdict(list)
            for s in self.segments:
                tiers[int(math.log(max(1, s.docs), self.fanout))].append(s)
            full = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]
            if not full:
                break
            self._replaced({full[0][0].name: full[0]})
            went += len(full[0])
        return went

    def _replaced(self, groups: Mapping[str, Sequence[Segment]]) -> None:
        """Commit one segment without tombstones in place of each group."""
        out = {first: self._rewrite(group, self._deleted(group)) for first, group in groups.items()}
        gone = {s.name for group in groups.values() for s in group}
        segments = [out[s.name] if s.name in out else s for s in self.segments if s.name in out or s.name not in gone]
        self._commit(segments=tuple(s for s in segments if s), dirt_count=self.dirt_count - sum(s.deleted for group in groups.values() for s in group))


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    """(value, version) of the versions that were written whole; None if there are none."""
    try:
        rows = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), T.StructField("version", T.IntegerType())])).text(f"{path}/manifests")
        return None if rows.isEmpty() else rows
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
