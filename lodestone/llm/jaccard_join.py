"""Exact Jaccard self-join on word shingles by PartEnum signatures.

Sets are banded by size so that two sets of similarity >= t lie in the same or in neighbouring bands.  Family f of
signatures serves the pairs whose smaller set lies in band f; a set signs for its own band and for the one below.  In
family f a similar pair differs in at most ``k_f`` elements.  The feature domain is cut into ``n_f > k_f / 2`` partitions,
so that one of them holds at most one difference, and each partition into three sub-partitions, of which every subset of
two gives a signature: one difference leaves one of the three subsets alike.  Empty subsets sign only where agreements on
empty ones alone would be possible, so empties do not attract strangers and no pair is lost.

A pair that differs less shares more: ``shared_least`` bounds the common signatures of a similar pair from below, and a
document with fewer shared signatures than any partner of its size asks for has no partner.  Such documents leave, twice,
as each time others lose signatures with them; documents that merely share a passage go that way.  Signatures of the same
members, of which near copies have hundreds, are one group with their number as its weight.

Pairs are not spelled out within a signature's group.  Round 1 verifies each member against the group's smallest class.
Groups whose members then lie in one component are settled.  Round 2 takes the other groups: pairs of different
components are first held against element counts in 256 bins, whose L1 distance bounds the set difference from below, in
blocks that are dealt to tasks of their own, and must share as many signatures as similar sets of their sizes do at least.
What is left is verified exactly, the nearest pair of each two components first.  The result is that of comparing all pairs.

Defined results: null, empty or blank texts have an empty set, link with nothing and are their own component; texts of
fewer words than the shingle width are one shingle; equal sets are one class (told apart by 128 bits); rows that repeat a
document id count as one document by their distinct texts' union of links; null ids keep their rows (component null) and
link with nothing; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import bounded_batches, by_numbers, components, discard, materialize, narrow_join, new_path, partitions, remove
from lodestone.llm.words import U, WordHashes, chunks, mix64, shingle_sets, shingles

#: Bins by which elements are counted, and bins of sums of them that are compared first.
BINS, COARSE = 256, 64
#: Sub-partitions of a partition; each subset that leaves one out is a signature.
SUBS = 3
#: Members of a signature's group that are compared within one task; larger groups are cut into blocks of about so many.
BLOCK = 1024
#: Pairs of one class that are verified in one task.
PAIRS = 64


class Bands:
    """Size bands for similarity >= num/den; for each family the partitions and what similar pairs share."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("similarity must be in (0, 1]")
        self.num, self.den, self.low, self.high = num, den, [1], [den // num]

    def reach(self, band: int) -> None:
        while len(self.high) <= band:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * self.den // self.num))

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The band of each size."""
        while len(sizes) and self.high[-1] < sizes.max():
            self.reach(len(self.high))
        return np.searchsorted(np.array(self.high), sizes)

    def differences(self, x, y):
        """Most elements by which similar sets of sizes x and y differ."""
        return (self.den - self.num) * (x + y) // (self.den + self.num)

    def partitions(self, family: int) -> int:
        """Partitions of family ``family`` (0 for -1, which serves no pair): more than half the differences."""
        if family < 0:
            return 0
        self.reach(family + 1)
        return (self.differences(self.high[family], self.high[family + 1]) + 2) // 2

    def _partitions(self, family: np.ndarray) -> np.ndarray:
        known = np.array([self.partitions(f) for f in range(int(family.max(initial=0)) + 1)] + [0])
        return known[family]

    @staticmethod
    def alike(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Fewest subsets that stay alike in n partitions with k differences: a first one costs a partition two subsets,
        a second one the third."""
        return np.maximum(0, SUBS * n - (SUBS - 1) * np.minimum(k, n) - np.clip(k - n, 0, n))

    def sign_empties(self, sizes: np.ndarray, family: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Whether sets' empty subsets sign: with so many, a partner could agree with a set on empty ones alone."""
        band = self.of(sizes)
        high = np.array(self.high)
        other = np.where(family == band, np.minimum(sizes, high[band]) * self.den // self.num, high[family])
        return empty >= self.alike(self._partitions(family), self.differences(sizes, other))

    def shared_least(self, x: np.ndarray, y: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
        """Fewest signatures that similar sets of sizes x and y share; ex, ey (n, 2): their empty subsets in the family of
        their band and in the one below."""
        bx, by, k = self.of(x), self.of(y), self.differences(x, y)
        rows, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for step in (0, 1):
            family = bx - step
            at = by - family
            both = ((at == 0) | (at == 1)) & (family >= 0)
            lost = np.minimum(ex[:, step], ey[rows, np.clip(at, 0, 1)])
            total += np.where(both, np.maximum(0, self.alike(self._partitions(family), k) - lost), 0)
        return np.maximum(total, 1)

    def shared_by_any(self, n: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Fewest signatures that sets of sizes n share with whatever set is similar to them."""
        b = self.of(n)
        self.of(n * self.den // self.num + 1)
        high, low = np.array(self.high), np.array(self.low)
        own, below = self._partitions(b), self._partitions(b - 1)
        most = n * self.den // self.num
        same = self.differences(n, np.minimum(high[b], most))
        within = np.maximum(0, self.alike(own, same) - e[:, 0]) + np.where(b > 0, np.maximum(0, self.alike(below, same) - e[:, 1]), 0)
        up = np.where(most > high[b], self.alike(own, self.differences(n, most)) - e[:, 0], within)
        under = low[b] - 1
        down = np.where((b > 0) & (under * self.den >= n * self.num), self.alike(below, self.differences(n, under)) - e[:, 1], within)
        return np.maximum(1, np.minimum(np.minimum(within, up), down))


def sign_sets(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of distinct non-empty shingle sets and whose they are, and each set's empty subsets (n, 2) in its band's
    family and the one below."""
    if not sets:
        return np.empty(0, U), np.empty(0, np.int64), np.empty((0, 2), np.int64)
    sizes = np.array([len(s) for s in sets])
    band, flat, owner = bands.of(sizes), np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    strong = mix64(flat ^ U(0x5851F42D4C957F2D))
    sigs, owners, empties = [], [], np.zeros((len(sets), 2), np.int64)
    for step in (0, 1):
        family = band - step
        cells = SUBS * bands._partitions(family)
        first = np.cumsum(cells) - cells
        some = cells[owner] > 0
        at = first[owner[some]] + (flat[some] % cells[owner[some]].astype(U)).astype(np.int64)
        held = np.bincount(at, minlength=int(cells.sum())).reshape(-1, SUBS)
        sums = np.zeros(held.size, U)
        np.add.at(sums, at, strong[some])
        sums = sums.reshape(-1, SUBS)
        # a subset is the partition without one of its sub-partitions
        whole = (sums.sum(axis=1, dtype=U)[:, None] - sums).ravel()
        filled = (held.sum(axis=1)[:, None] - held).ravel() > 0
        of = np.repeat(np.arange(len(sets)), cells)
        place = (np.arange(len(of)) - first[of]).astype(U) + (family[of] + 1).astype(U) * U(1 << 40)
        empties[:, step] = cells - np.bincount(of[filled], minlength=len(sets))
        keep = filled | (bands.sign_empties(sizes, family, empties[:, step]) & (cells > 0))[of]
        sigs.append(mix64(whole[keep] + mix64(place[keep])))
        owners.append(of[keep])
    return np.concatenate(sigs), np.concatenate(owners), empties


def prints_of(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits that stand for each of some non-empty sets."""
    if not sets:
        return []
    start = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    both = np.stack([np.add.reduceat(mix64(flat), start, dtype=U), np.add.reduceat(mix64(flat ^ U(0x2545F4914F6CDD1D)), start, dtype=U)], axis=1)
    data = both.tobytes()
    return [data[i : i + 16] for i in range(0, len(data), 16)]


#: What the signing pass leaves for each row of the input (kind 0) and each class of a shared signature (kind 1).
FIELDS = "kind int, id long, n_shingles long, print binary, bins binary, empty binary, least long, tag long, sig long, weight long"
KINDS = {"id": pa.int64(), "n_shingles": pa.int64(), "print": pa.binary(), "bins": pa.binary(), "empty": pa.binary(), "least": pa.int64(), "tag": pa.int64(), "sig": pa.int64(), "weight": pa.int64()}


def _sign(docs: DataFrame, key: str, text: str, width: int, num: int, den: int, shards: int) -> DataFrame:
    """One pass over the texts and one exchange: sets and, of signatures of two or more classes, the classes' tags.

    A tag is half of a class's print: classes of one tag only share candidates.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(num, den)
        for b in chunks(batches, 1 << 20):
            ids, sets = b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), hashes, width)
            some = [k for k, (i, s) in enumerate(zip(ids, sets, strict=True)) if len(s) and i is not None]
            names = prints_of([sets[k] for k in some])
            first: dict[bytes, int] = {}  # copies within a slice sign once; all copies are one class
            for name, k in zip(names, some, strict=True):
                first.setdefault(name, k)
            own = [sets[k] for k in first.values()]
            g, owner, empty = sign_sets(own, bands)
            sizes = np.array([len(s) for s in own], np.int64)
            tags = np.frombuffer(b"".join(first), np.int64)[::2]
            bins = np.bincount(np.repeat(np.arange(len(own)), sizes) * BINS + (np.concatenate(own) >> U(65 - BINS.bit_length())).astype(np.int64), minlength=BINS * len(own)) if own else np.empty(0, np.int64)
            bins = np.minimum(bins, 255).astype(np.uint8).reshape(-1, BINS)
            least = bands.shared_by_any(sizes, empty) if own else sizes
            about = {name: (name, bins[j].tobytes(), empty[j].astype(np.int32).tobytes(), int(least[j]), int(tags[j])) for j, name in enumerate(first)}
            of = dict(zip(some, names, strict=True))
            rows = [(k % shards, i, len(s), *(about[of[k]] if k in of else [None] * 5), None, None) for k, (i, s) in enumerate(zip(ids, sets, strict=True))]
            if len(g):
                shard = ((g >> U(33)) % U(shards)).astype(np.int32)
                order = np.argsort(shard, kind="stable")
                g, i = g[order], tags[owner[order]]
                at = np.searchsorted(shard[order], np.arange(shards + 1))
                rows += [(x, *[None] * 7, g[p:q].tobytes(), i[p:q].tobytes()) for x, (p, q) in enumerate(zip(at[:-1], at[1:], strict=True)) if p < q]
            kinds = [pa.int32(), *list(KINDS.values())[:7], pa.binary(), pa.binary()]
            fields = ["shard", *list(KINDS)[:7], "sigs", "tags"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=fields)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind, n, **cols):
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[cols.get(c, pa.nulls(n, k)) for c, k in KINDS.items()]], names=["kind", *KINDS])

        sigs, tags = [], []
        for b in batches:
            sets = b.filter(b.column(8).is_null())
            if sets.num_rows:
                yield out(0, sets.num_rows, **{c: sets.column(k) for k, c in enumerate(list(KINDS)[:7], 1)})
            signed = b.filter(b.column(8).is_valid())
            sigs += [np.frombuffer(x, U) for x in signed.column(8).to_pylist()]
            tags += [np.frombuffer(x, np.int64) for x in signed.column(9).to_pylist()]
        if not sigs:
            return
        g, i = np.concatenate(sigs), np.concatenate(tags)
        del sigs, tags
        order = np.argsort(g, kind="stable")
        g, i = g[order], i[order]
        twin = np.zeros(len(g), bool)
        twin[1:] = g[1:] == g[:-1]
        twin[:-1] |= twin[1:]
        g, i = g[twin], i[twin]
        order = np.lexsort((i, g))
        g, i = g[order], i[order]
        if len(g):  # copies of one class that were signed in several slices count once
            new = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
            g, i = g[new], i[new]
        if not len(g):
            return
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        size = np.diff(np.r_[start, len(g)])
        # groups of two or more; of those with the same members the first, with their number
        whose = np.stack([np.add.reduceat(mix64(i.view(U)), start, dtype=U), np.add.reduceat(mix64(i.view(U) ^ U(0x2545F4914F6CDD1D)), start, dtype=U), size.astype(U)], axis=1)
        start, size, whose = start[size > 1], size[size > 1], whose[size > 1]
        order = np.lexsort(whose.T)
        start, size, whose = start[order], size[order], whose[order]
        new = np.flatnonzero(np.r_[True, (whose[1:] != whose[:-1]).any(axis=1)]) if len(start) else np.empty(0, np.int64)
        weight = np.diff(np.r_[new, len(start)])
        start, size = start[new], size[new]
        at = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(start) else new
        g, i, weight = g[at].view(np.int64), i[at], np.repeat(weight, size)
        for at in range(0, len(g), 100_000):
            cut = slice(at, at + 100_000)
            yield out(1, len(g[cut]), tag=pa.array(i[cut]), sig=pa.array(g[cut]), weight=pa.array(weight[cut]))

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    cut = rows.mapInArrow(sign, "shard int, id long, n_shingles long, print binary, bins binary, empty binary, least long, tag long, sigs binary, tags binary")
    return cut.repartition(shards, "shard").mapInArrow(group, FIELDS)


def _verify(pairs: DataFrame, info: DataFrame, docs: DataFrame, key: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose sets are similar.

    The pairs of a class ``a`` are dealt to one task for each ``PAIRS`` of them; its text goes to each of these once, and
    the texts of its partners once to each of their pairs.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, now, own = WordHashes(), None, None
        for b in chunks(batches):
            a, c = [], []
            for x, y, name, t in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                s = shingles(t, hashes, width)
                if not len(s) or prints_of([s])[0] != name:
                    continue  # another text under the same id
                if y is None:
                    now, own = x, s
                elif now == x:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if den * both >= num * (len(own) + len(s) - both):
                        a.append(x)
                        c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    t = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    needed = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    needed = materialize(needed.join(info, "c").select("c", "rep", "print"), "needed")
    texts = materialize(narrow_join(t, needed, "rep").select("c", "print", "t"), "texts")
    deals = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("deals"))
    own = deals.join(texts, deals["a"] == texts["c"]).select("a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), "print", "t")
    other = pairs.join(deals, "a").select("a", F.pmod(F.xxhash64("b"), F.col("deals").cast("long")).cast("int").alias("deal"), "b")
    other = other.join(texts, other["b"] == texts["c"]).select("a", "deal", "b", "print", "t")
    dealt = own.unionByName(other).repartition(partitions(spark), "a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())
    found = materialize(dealt.mapInArrow(run, "a long, b long").distinct(), "similar")
    discard(needed, texts)
    return found


def _close(num: int, den: int, nearest: bool):
    """Pairs of one signature's members from different components that sizes and bins allow, with ``shared_least``.

    Input rows: sig, x, y (blocks of the group), right, c, n_shingles, comp, weight, bins, empty; sorted by the first four.  Where x
    and y differ, only pairs of a left and a right member are tried.  ``nearest``: of each signature and two components
    (by block) only the pair whose bins are closest, with their distance and the components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)

        def distance(bins: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
            far = np.empty(len(p), np.int64)
            for at in range(0, len(p), 1 << 14):
                part = slice(at, at + (1 << 14))
                far[part] = np.abs(bins[p[part]].astype(np.int16) - bins[q[part]]).sum(axis=1, dtype=np.int64)
            return far

        def test(ids, sizes, comps, weight, bins, empty, coarse, u, v):
            ok = (comps[u] != comps[v]) & (np.minimum(sizes[u], sizes[v]) * den >= np.maximum(sizes[u], sizes[v]) * num)
            u, v = u[ok], v[ok]
            for at in range(0, len(u), 1 << 17):
                p, q = u[at : at + (1 << 17)], v[at : at + (1 << 17)]
                # sums of bins are never farther apart than the bins
                near = distance(coarse, p, q) <= bands.differences(sizes[p], sizes[q])
                p, q = p[near], q[near]
                far = distance(bins, p, q)
                near = far <= bands.differences(sizes[p], sizes[q])
                p, q, far = p[near], q[near], far[near]
                w = weight[p]
                if not len(p):
                    continue
                a, b = np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q])
                if nearest:
                    x, y = np.minimum(comps[p], comps[q]), np.maximum(comps[p], comps[q])
                    order = np.lexsort((far, y, x))
                    a, b, far, x, y = a[order], b[order], far[order], x[order], y[order]
                    first = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                    yield pa.RecordBatch.from_arrays([pa.array(z[first]) for z in (a, b, far, x, y)], names=["a", "b", "far", "x", "y"])
                else:
                    least = bands.shared_least(sizes[p], sizes[q], empty[p], empty[q])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(least), pa.array(w)], names=["a", "b", "least", "weight"])

        def tiles(x, y, right, *cols):
            """Sorted whole tiles; those of one size and kind are tried together."""
            start = np.flatnonzero(x)  # here: whether a tile begins
            size = np.diff(np.r_[start, len(x)])
            split = y[start]
            for n in np.unique(size[(size > 1) & ~split]).tolist():
                heads = start[(size == n) & ~split]
                u, v = np.triu_indices(n, 1)
                step = max(1, (1 << 20) // len(u))
                for at in range(0, len(heads), step):
                    h = heads[at : at + step, None]
                    yield from test(*cols, (h + u).ravel(), (h + v).ravel())
            for h, n in zip(start[split].tolist(), size[split].tolist(), strict=True):
                left, other = h + np.flatnonzero(right[h : h + n] == 0), h + np.flatnonzero(right[h : h + n] == 1)
                step = max(1, (1 << 20) // max(1, len(other)))
                for at in range(0, len(left), step):
                    u, v = np.meshgrid(left[at : at + step], other, indexing="ij")
                    yield from test(*cols, u.ravel(), v.ravel())

        held = None
        for b in chunks(batches):
            now = [b.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
            now.append(np.frombuffer(b"".join(b.column(8).to_pylist()), np.uint8).reshape(-1, BINS))
            now.append(np.frombuffer(b"".join(b.column(9).to_pylist()), np.int32).reshape(-1, 2).astype(np.int64))
            now.append(now[8].reshape(-1, COARSE, BINS // COARSE).sum(axis=2, dtype=np.int16))
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now, strict=True)]
            sig, x, y = now[:3]
            begins = np.r_[True, (sig[1:] != sig[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            last = int(np.flatnonzero(begins)[-1])  # the last tile may go on in the next batch
            if last:
                yield from tiles(begins[:last], (x != y)[:last], *(z[:last] for z in now[3:]))
            held = [z[last:] for z in now]
        if held is not None:
            yield from tiles(np.arange(len(held[0])) == 0, held[1] != held[2], *held[3:])

    return run


def _tiles(rows: DataFrame, spark) -> DataFrame:
    """``rows`` (sig, c, ...) with each group over ``BLOCK`` members cut into blocks, each pair of which is a tile."""
    blocks = rows.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "sig").withColumn("home", F.pmod(F.xxhash64("c"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("home", "other"), "y": F.greatest("home", "other"), "right": (F.col("home") > F.col("other")).cast("int")})
    keys = ["sig", "x", "y"]
    return rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "right").select(*keys, "right", "c", "n_shingles", "comp", "weight", "bins", "empty")


def _collapsed(rows: DataFrame) -> DataFrame:
    """(sig, tag, low, weight) of groups of two or more; one of all groups with the same members, with their joint weight."""
    seen = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("tag")))
    groups = rows.groupBy("sig").agg(F.min("tag").alias("low"), seen(1).alias("x"), seen(2).alias("y"), F.count("*").alias("n"), F.first("weight").alias("w")).where("n > 1")
    heads = groups.groupBy("x", "y", "n", "low").agg(F.min("sig").alias("sig"), F.sum("w").alias("weight")).select("sig", "low", "weight")
    return rows.select("sig", "tag").join(heads, "sig").select("sig", "tag", "low", "weight")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``; ``similarity`` is a fraction (numerator, denominator)."""
    num, den = similarity
    spark = docs.sparkSession
    other = by_numbers(docs.select(docs[key], docs[text]), key, lambda rows: jaccard_components(rows, key, text, width, similarity), [key, "component_id"])
    if other is not None:
        return other
    bounded_batches(spark)
    path = new_path(spark, "signed")
    # A shard's signatures are sorted in one task: there are as many shards as splits of the input at least.
    shards = max(partitions(spark), docs.rdd.getNumPartitions())
    _sign(docs, key, text, width, num, den, shards).write.partitionBy("kind").parquet(path)
    signed = spark.read.schema(FIELDS).parquet(path)
    every, shared = signed.where("kind = 0"), signed.where("kind = 1").select("sig", "tag", "weight")
    sets = every.where("print IS NOT NULL")

    # Documents that share too few signatures leave, and signatures that one class is left of.
    members, known = shared, sets.select("tag", "least")
    for _ in range(2):
        enough = members.groupBy("tag").agg(F.sum("weight").alias("n_shared"))
        known = materialize(narrow_join(known, enough, "tag").where("n_shared >= least").select("tag", "least").distinct(), "able")
        rows = narrow_join(members.select("sig", "tag", "weight"), known.select("tag"), "tag", "left_semi")
        members = materialize(_collapsed(rows), "members")
    # Classes that may have partners, and those of ids that repeat with several texts, which bind their classes.
    several = sets.groupBy("id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p <> q").select("id")
    several = materialize(narrow_join(sets, several, "id", "left_semi").select("id", "print").distinct(), "several")
    able = narrow_join(sets, members.select("tag").distinct(), "tag", "left_semi").select("print").unionByName(several.select("print")).distinct()
    per = ["n_shingles", "tag", "bins", "empty"]
    info = narrow_join(sets, materialize(able, "able"), "print").groupBy("print").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in per])
    info = materialize(info.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers are read back, never made anew
    number = info.select("tag", "c")
    bound = several.join(info.select("print", "c"), "print")
    bound = bound.join(bound.groupBy("id").agg(F.min("c").alias("a")), "id").where("a <> c").select("a", F.col("c").alias("b"))

    def labels(links: DataFrame) -> DataFrame:
        found = components(links)
        return materialize(number.join(found, F.col("c") == F.col("node"), "left").select("tag", "c", F.coalesce("component", "c").alias("comp")), "labels")

    # Round 1: each member against its group's smallest class.
    stars = members.where("tag <> low").select("tag", "low").distinct()
    stars = stars.join(number, "tag").withColumnRenamed("c", "b").join(number.select(F.col("tag").alias("low"), F.col("c").alias("a")), "low").select("a", "b")
    stars = materialize(_may_link(stars, info, num, den), "stars")
    links = materialize(_verify(stars, info, docs, key, text, width, num, den).unionByName(bound), "links")
    label, tried = labels(links), stars
    # Round 2: groups that hold several components.  First the nearest pair of each two components of a group: where one
    # links them, their other pairs are settled.  Then all pairs that are left; similar ones share several signatures.
    for nearest in (True, False):
        rows = members.select("sig", "tag", "weight").join(label, "tag").select("sig", "c", "comp", "weight")
        open_ = rows.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("sig")
        rows = materialize(rows.join(open_, "sig", "left_semi"), "open")
        # a partner in another component shares the signatures that hold both, which are open
        many = rows.groupBy("c").agg(F.sum("weight").alias("n")).join(info.select("c", "n_shingles", "bins", "empty", "tag"), "c")
        many = narrow_join(many, known, "tag").where("n >= least").drop("n", "tag", "least").distinct()
        rows = _tiles(rows.join(many, "c"), spark)
        if nearest:
            pairs = rows.mapInArrow(_close(num, den, True), "a long, b long, far long, x long, y long")
            pairs = pairs.groupBy("x", "y").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            pairs = rows.mapInArrow(_close(num, den, False), "a long, b long, least long, weight long")
            pairs = pairs.groupBy("a", "b", "least").agg(F.sum("weight").alias("shares")).where("shares >= least")
        pairs = materialize(pairs.select("a", "b").join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = materialize(links.unionByName(_verify(pairs, info, docs, key, text, width, num, den)), "links")
            label = labels(links)
            tried = tried.unionByName(pairs)
    # Ids whose component is another than themselves: by links, or as copies.
    linked = info.select("print", "c", "rep").join(label.select("c", "comp"), "c")
    linked = linked.join(linked.groupBy("comp").agg(F.min("rep").alias("least_id")), "comp").select("print", "least_id")
    copies = sets.groupBy("print").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last")
    named = materialize(copies.join(linked, "print", "full").select("print", F.coalesce("least_id", "rep").alias("comp")), "named")
    moved = materialize(narrow_join(sets.select("id", "print"), named, "print").where("comp <> id").select("id", "comp").distinct(), "moved")
    out = materialize(narrow_join(every.select("id", "n_shingles"), moved, "id", "left"), "components")
    remove(spark, path)
    discard(members, known, several, info, stars, links, label, named, moved)
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("comp", "id").alias("component_id"))


def _may_link(pairs: DataFrame, info: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a < b) of different classes that sizes and bins allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for b in batches:
            if not b.num_rows:
                continue
            a, c, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for k in (4, 5))
            far = np.abs(p - q).sum(axis=1, dtype=np.int64)
            ok = (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (far <= bands.differences(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(c[ok])], names=["a", "b"])

    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = pairs.join(info.select(F.col("c").alias("a"), F.col("n_shingles").alias("x"), F.col("bins").alias("p")), "a")
    both = left.join(info.select(F.col("c").alias("b"), F.col("n_shingles").alias("y"), F.col("bins").alias("q")), "b")
    return both.select("a", "b", "x", "y", "p", "q").mapInArrow(run, "a long, b long")
