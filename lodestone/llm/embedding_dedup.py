"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Rows of one label are projected on ``m`` fixed random directions.  A pair collides on a projection if one lies in the
other's query-centred window of half width ``w``.  Pairs with at least ``t`` collisions are verified by cosine in double
precision.  ``m``, ``w`` and ``t`` come from the wanted recall: at the cosine threshold the collisions of a pair are
binomial, and ``t`` is the largest count that such a pair reaches with probability ``recall``; closer pairs reach it more
often.  The first projection is the sort key: rows of a label are cut into blocks along it, and only blocks whose windows
can meet are put together, each such pair of blocks in a task of its own.

One-dimensional windows cannot be selective at low cosines: the expected collisions of all pairs grow with the square of
a label's rows.  They are counted on bytes, in blocks, and never become rows; what a block pair emits is at most one
count and one forest link for each of its rows.

Defined results: null, zero and non-finite vectors, vectors with null components, null labels and null ids link with nothing and
are their own component; equal vectors are linked (cosine 1) and are compared once, by their class; rows that repeat a
vec_id are separate vectors of the same id whose links add up; vectors of unequal lengths do not link; an empty table
gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import by_numbers, components, materialize, partitions

BLOCK = 2048


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def calibrate(cosine: float, recall: float = 0.9999, m: int = 48, width: float = 1.5) -> tuple[float, int]:
    """(half width, least collisions): the window is ``width`` standard deviations of a borderline pair's gap."""
    gap = math.sqrt(max(2 - 2 * cosine, 1e-6))
    p = 2 * _phi(width) - 1
    tail, t = 1.0, 0
    while t < m:
        tail -= math.comb(m, t) * p**t * (1 - p) ** (m - t)
        if tail < recall:
            break
        t += 1
    return gap * width, t


def directions(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def _prepare(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, label, v): v is the unit vector as packed doubles, null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, lab, v in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                unit = None
                if i is not None and lab is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    big = np.abs(x).max()
                    if np.isfinite(x).all() and big > 0:
                        x = x / big
                        unit = (x / np.sqrt((x * x).sum())).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "v"])

    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def embedding_components(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, recall: float = 0.9999, m: int = 48, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df``."""
    narrow = df.select(df[vec_id].alias("vec_id"), df[embedding].alias("embedding"), df[label].alias("label"))
    other = by_numbers(narrow, "vec_id", lambda rows: embedding_components(rows, cosine=cosine, recall=recall, m=m, seed=seed, block=block), ["vec_id", "component_id"])
    if other is not None:
        return other
    spark = df.sparkSession
    half, least = calibrate(cosine, recall, m)
    rows = materialize(_prepare(df, vec_id, embedding, label), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sort_by: dict[int, np.ndarray] = {}  # the first direction of each dimension
        for b in batches:
            vs = [np.frombuffer(v) for v in b.column(1).to_pylist()]
            for dim in {len(v) for v in vs} - set(sort_by):
                sort_by[dim] = directions(dim, m, seed)[:, 0].copy()
            firsts = [float(v @ sort_by[len(v)]) for v in vs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(firsts, pa.float64())], names=["label", "v", "rep", "n", "p"])

    placed = classes.select("label", "v", "rep", "n").mapInArrow(project, "label string, v binary, rep long, n long, p double")
    dims = F.length("v")
    placed = materialize(placed.select("*", dims.alias("dim")), "placed")
    # Blocks along the sort projection: bounds by approximate quantiles, one block for each ``block`` rows.
    sizes = placed.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.percentile_approx("p", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 2000).alias("q"))
    bounds = sizes.select("label", "dim", "rows", F.greatest(F.lit(1), F.ceil(F.col("rows") / block)).cast("int").alias("blocks"), "q")
    # With more blocks than quantiles, a quantile's rows are dealt to sub-blocks by hash.
    cuts = bounds.select("label", "dim", F.expr("array_distinct(transform(sequence(1, least(blocks, 256) - 1 + int(blocks = 1)), i -> q[least(254, int(i * 256 / least(blocks, 256)) - 1)]))").alias("cuts"), "blocks").withColumn("cuts", F.when(F.col("blocks") == 1, F.expr("array()").cast("array<double>")).otherwise(F.col("cuts")))
    cuts = cuts.withColumn("subs", F.ceil(F.col("blocks") / 256).cast("int"))
    homed = placed.join(cuts, ["label", "dim"]).withColumn("home", F.expr("size(filter(cuts, c -> c <= p))")).withColumn("sub", F.pmod(F.xxhash64("v"), F.col("subs").cast("long")).cast("int"))
    # Blocks within 4 standard deviations of a borderline pair's gap on the sort projection can meet (recall 0.9999+).
    reach = 4 * math.sqrt(2 - 2 * cosine)
    tiled = homed.withColumn("far", F.expr(f"size(filter(cuts, c -> c <= p + {reach!r}))")).withColumn("near", F.expr(f"size(filter(cuts, c -> c <= p - {reach!r}))"))
    tiled = tiled.withColumn("other", F.explode(F.expr("sequence(near, far)"))).withColumn("osub", F.explode(F.expr("sequence(0, subs - 1)")))
    mine, its = F.col("home") * F.col("subs") + F.col("sub"), F.col("other") * F.col("subs") + F.col("osub")
    tiled = tiled.select("label", "dim", F.least(mine, its).alias("x"), F.greatest(mine, its).alias("y"), (mine > its).alias("right"), "rep", "n", "v")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}

        def work(key, ids, ns, vs, right):
            ids, ns, right = np.array(ids), np.array(ns), np.array(right)
            V = np.frombuffer(b"".join(vs)).reshape(len(vs), -1)
            if V.shape[1] not in lines:
                lines[V.shape[1]] = directions(V.shape[1], m, seed)
            P = V @ lines[V.shape[1]]
            # Bytes over the range that holds all but the tails; tails share the end cells, which only adds candidates.
            scale = half / 24
            Q = np.clip(np.rint(P / scale), -127, 127).astype(np.int8)
            w = int(math.ceil(half / scale)) + 1
            same = key[2] == key[3]
            a = np.arange(len(ids)) if same else np.flatnonzero(~right)
            b = np.arange(len(ids)) if same else np.flatnonzero(right)
            if not len(a) or not len(b):
                return None
            links = np.zeros(len(ids), np.int64)
            root = np.arange(len(ids))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            QT = np.ascontiguousarray(Q[b].T)
            for at in range(0, len(a), 64):
                rows_ = a[at : at + 64]
                count = np.zeros((len(rows_), len(b)), np.uint8)
                for j in range(m):
                    x, y = Q[rows_, j][:, None], QT[j][None, :]
                    # |x - y| <= w on bytes: the difference of clipped bytes can wrap, so compare through the larger
                    count += (np.maximum(x, y).view(np.uint8) - np.minimum(x, y).view(np.uint8)) <= np.uint8(min(w, 255))
                u, v = np.nonzero(count >= least)
                ii, jj = rows_[u], b[v]
                if same:
                    ok = ii < jj
                    ii, jj = ii[ok], jj[ok]
                if not len(ii):
                    continue
                hit = np.empty(len(ii), bool)
                for c in range(0, len(ii), 1 << 16):
                    hit[c : c + (1 << 16)] = np.einsum("ij,ij->i", V[ii[c : c + (1 << 16)]], V[jj[c : c + (1 << 16)]]) >= cosine
                ii, jj = ii[hit], jj[hit]
                np.add.at(links, ii, ns[jj])
                np.add.at(links, jj, ns[ii])
                while (root[root] != root).any():
                    root[:] = root[root]
                apart = root[ii] != root[jj]  # links within a known component need no union
                for i, j in zip(ii[apart].tolist(), jj[apart].tolist(), strict=True):
                    p, q = find(i), find(j)
                    if p != q:
                        root[max(p, q)] = min(p, q)
            tops = np.array([find(i) for i in range(len(ids))])
            got = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(links[got]), pa.array(ids[tops[got]])], names=["rep", "links", "to"])

        key, held = None, ([], [], [], [])
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if r[:4] != key:
                    if key is not None and (out := work(key, *held)) is not None:
                        yield out
                    key, held = r[:4], ([], [], [], [])
                for x, v in zip(held, (r[5], r[6], r[7], r[4]), strict=True):
                    x.append(v)
        if key is not None and (out := work(key, *held)) is not None:
            yield out

    keys = ["label", "dim", "x", "y"]
    dealt = tiled.repartition(max(partitions(spark), 12), *keys).sortWithinPartitions(*keys, "right", "rep").select(*keys, "right", "rep", "n", "v")
    found = materialize(dealt.mapInArrow(tile, "rep long, links long, to long"), "collisions")
    return _result(rows, classes, found)


def _result(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    # A representative is named by its smallest vec_id; an id can name one class only unless ids repeat.
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    named = classes.join(links, "rep", "left").join(label, classes["rep"] == label["node"], "left")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    out = rows.join(named, ["label", "v"], "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (comp == F.col("vec_id")).alias("kept"))
