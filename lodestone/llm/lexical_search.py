"""Ranked lexical search by windowed bucket scoring: the best documents of each query, by whole-number BM25 scores.

Terms are the runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lower-cased.

1. One pass over the texts writes postings of the queries' terms, and of no others, in windows of ``WINDOW`` documents: a
   row holds the window's document ids and lengths and, term by term, slots and frequencies.  Slots number the documents
   that hold such a term, as they come, so texts are never shuffled and ids may be of any type that sorts.
2. The windows' counters give the number of documents, of terms, and each term's document frequency.
3. Windows are traversed one by one.  For each query the contributions of its terms' postings are added into an array of
   ``WINDOW`` sums, which stays in a core's cache, and the terms' bit sets are united; the sums of occupied slots are
   harvested into the query's heap.  A task leaves its heaps, and a ranking over those gives the result.

The scores are whole numbers, so no order of addition changes them, and equal ones are told apart by the document's id.
Queries go to the workers in slices of at most ``TERMS`` terms; more take further passes over the texts, with the same result.

Defined results: a null or empty text, of a document or a query, has no terms, and such a document is not counted; a
query none of whose terms occurs has no rows; rows that repeat a query id are ranked each for itself; rows that repeat a
document, or its id, are documents of their own, and which of two equal ones stands first is all the same; a null id sorts
first; texts of any length are read whole; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.decontaminate import words_of
from lodestone.llm.shared import bounded_batches, materialize
from lodestone.llm.words import chunks, release

#: Documents of a window; their sums take 32 KB.
WINDOW = 4096
#: Postings at which a window ends before it is full, which bounds a row of the postings table.
POSTINGS = 1 << 20
#: Query terms, repeats included, that are sent to the workers at once.
TERMS = 500_000
#: Bytes to bytes: A-Z lower-cased, the rest of ASCII but digits and letters made a blank.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

BLOCK = "n_docs long, n_terms long, lens binary, terms array<int>, sizes array<int>, slots binary, tfs binary"


class Postings:
    """The postings of one window in the making."""

    def __init__(self):
        self.n_docs = self.n_terms = 0
        self.ids, self.lens, self.terms, self.slots, self.tfs = [], [], [], [], []

    def add(self, ident, text: bytes | None, vocabulary: dict[bytes, int]) -> None:
        words = text.translate(TABLE).split() if text else []
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = [(t, n) for w, n in Counter(words).items() if (t := vocabulary.get(w)) is not None]
        if found:
            terms, counts = zip(*found, strict=True)
            self.terms += terms
            self.tfs += counts
            self.slots += [len(self.ids)] * len(found)
            self.ids.append(ident)
            self.lens.append(len(words))

    def row(self, kind: pa.DataType) -> pa.RecordBatch:
        """As a row of the postings table: postings by term, and by slot within it."""
        terms = np.array(self.terms, np.int32)
        order = np.argsort(terms, kind="stable")
        present, sizes = np.unique(terms, return_counts=True)
        values = [[self.n_docs], [self.n_terms], [np.array(self.lens, np.int64).tobytes()], [present], [sizes.astype(np.int32)], [np.array(self.slots, np.int16)[order].tobytes()], [np.array(self.tfs, np.int32)[order].tobytes()]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["n_docs", "n_terms", "lens", "terms", "sizes", "slots", "tfs", "ids"]
        return pa.RecordBatch.from_arrays([*[pa.array(v, k) for v, k in zip(values, kinds, strict=True)], pa.array([self.ids], pa.list_(kind))], names=names)


def write_postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``docs(key, body)`` as windows of postings; tables of ``BLOCK`` and ``ids``."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([*T._parse_datatype_string(BLOCK).fields, T.StructField("ids", T.ArrayType(docs.schema["key"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, kind = sent.value, Postings(), None
        for b in chunks(batches):
            kind = b.schema.field(0).type
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now.add(ident, text, words)
                if len(now.ids) == WINDOW or len(now.terms) >= POSTINGS:
                    yield now.row(kind)
                    now = Postings()
        if now.n_docs:
            yield now.row(kind)

    return materialize(docs.mapInArrow(run, schema), "postings")


def _rank_in_window(ids: list) -> np.ndarray:
    """Each slot's place among the window's ids in ascending order, nulls first."""
    ranks = np.empty(len(ids), np.int64)
    ranks[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
    return ranks


class Harvest:
    """Heaps of the best ``k`` documents of each query over the windows of a task."""

    def __init__(self, queries: list[tuple[int, list[tuple[int, int]]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.queries, self.weights, self.n_docs, self.n_terms, self.k = queries, weights, n_docs, n_terms, k
        self.best: dict[int, list] = {}
        self.sums = np.zeros(WINDOW, np.int64)

    def window(self, ids: list, lens: bytes, terms: list[int], sizes: list[int], slots: bytes, tfs: bytes) -> None:
        if not ids:
            return
        slots, tfs = np.frombuffer(slots, np.int16), np.frombuffer(tfs, np.int32).astype(np.int64)
        m = 100 - 25 + (25 * np.frombuffer(lens, np.int64) * self.n_docs) // self.n_terms
        gains = np.repeat(self.weights[terms], sizes) * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m[slots]))
        ends = np.cumsum(sizes)
        lists = {}
        for t, a, b in zip(terms, ends - sizes, ends, strict=True):
            held = np.zeros(WINDOW, bool)
            held[slots[a:b]] = True
            lists[t] = slots[a:b], gains[a:b], np.packbits(held)
        ranks = _rank_in_window(ids)
        occupied = np.zeros(WINDOW // 8, np.uint8)
        for q, asked in self.queries:
            occupied[:] = 0
            for t, times in asked:
                if t in lists:
                    at, gain, bits = lists[t]
                    self.sums[at] += times * gain  # the slots of a term are distinct
                    occupied |= bits
            at = np.flatnonzero(np.unpackbits(occupied))
            self._take(q, at, ids, ranks)
            self.sums[at] = 0

    def _take(self, q: int, at: np.ndarray, ids: list, ranks: np.ndarray) -> None:
        score = self.sums[at]
        held = self.best.setdefault(q, [])
        least = max(1, -held[-1][0]) if len(held) == self.k else 1
        keep = score >= least
        at, score = at[keep], score[keep]
        if not len(at):
            return
        best = np.lexsort((ranks[at], -score))[: self.k]
        new = [(-int(score[i]), (ids[at[i]] is not None, ids[at[i]])) for i in best]
        self.best[q] = heapq.nsmallest(self.k, heapq.merge(held, new))


def _best_of_tasks(postings: DataFrame, queries: list, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    kind = postings.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", kind), T.StructField("score", T.LongType())])
    sent = postings.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        harvest, kind = Harvest(*sent.value, n_docs, n_terms, k), None
        for b in batches:
            kind = b.schema.field("ids").type.value_type
            for i in range(b.num_rows):
                row = {name: b.column(name)[i].as_py() for name in ("ids", "lens", "terms", "sizes", "slots", "tfs")}
                harvest.window(**row)
        rows = [(q, ident[1], -score) for q, best in harvest.best.items() for score, ident in best]
        if rows:
            q, key, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(key, kind), pa.array(score, pa.int64())], names=["q", "key", "score"])
        release()

    return postings.select("ids", "lens", "terms", "sizes", "slots", "tfs").mapInArrow(run, schema)


def _search_slice(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(q, key, score): the tasks' best for the queries ``rows(q, terms)``; None if no document holds a term."""
    vocabulary: dict[bytes, int] = {}
    queries = [(r["q"], list(Counter(vocabulary.setdefault(w.encode("utf-8", "surrogatepass"), len(vocabulary)) for w in r["terms"]).items())) for r in rows]
    postings = write_postings(docs, vocabulary)
    n_docs, n_terms = postings.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not n_docs:
        return None
    held = postings.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df")).collect()  # a row for each term of the slice
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held:
        weights[r["terms"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return _best_of_tasks(postings, queries, weights, n_docs, n_terms, k)


def search_items(docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of each query, with a score above 0: ``item``, rank (int, from 1), ``key``, score (long)."""
    asked = queries.select(queries[item].alias("item"), words_of(queries[item_text]).alias("terms")).where(F.size("terms") > 0)
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    body = docs.select(docs[key].alias("key"), docs[text].cast("binary").alias("body"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = -(-total // TERMS)
    slices = (asked.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i).select("q", "terms").collect() for i in range(n))
    parts = [p for rows in slices if rows and (p := _search_slice(body, rows, k)) is not None]
    if not parts:
        fields = [(item, asked.schema["item"].dataType), ("rank", T.IntegerType()), (key, body.schema["key"].dataType), ("score", T.LongType())]
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("key").asc_nulls_first())
    top = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("q", "item"), "q").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
