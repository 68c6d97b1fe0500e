"""SimHash fingerprints: weighted term hashes vote on 128 signed bits; permuted block tables find near fingerprints.

Terms are the text's words (A-Z lower-cased, cut at white space), weighted ``(1 + ln tf) * min(length, 8)``; texts under
64 words add their 4-character grams with a weight that fades out towards 64 words, so that short texts have enough
votes.  Each term's 128-bit hash votes its weight for or against each bit.

Defined results: a null text is the empty text; texts without words have the fingerprint of 128 zero bits; equal texts
have equal fingerprints; very long texts are read whole.  For ``fingerprint_edits`` documents follow each other by
ascending key, null keys first, equal keys by text; a lone document is its own successor; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import bounded_batches, by_numbers, materialize, narrow_join, partitions
from lodestone.llm.words import U, WordHashes, chunks, mix64

BITS = 128
SHORT = 64
#: Entries of a key that are compared with as many others in one task.
TILE = 2048


def fingerprint(text: str | None, hashes: WordHashes) -> bytes:
    """The 16 bytes of a text's fingerprint."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return bytes(BITS // 8)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    length = np.fromiter(map(len, words), np.float32, len(words))
    h, at, tf = np.unique(h, return_index=True, return_counts=True)
    weight = (1 + np.log(tf.astype(np.float32))) * np.minimum(length[at], 8)
    if len(words) < SHORT:
        joined = b" ".join(words)
        grams = np.unique(np.fromiter((hashes[joined[i : i + 4]] for i in range(max(1, len(joined) - 3))), U))
        h = np.concatenate([h, mix64(grams)])
        weight = np.concatenate([weight, np.full(len(grams), 4 * (1 - len(words) / SHORT), np.float32)])
    votes = np.zeros(BITS, np.float64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)]
        bits = np.unpackbits(np.stack([mix64(part), mix64(part ^ U(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8).reshape(len(part), -1), axis=1)
        votes += weight[i : i + (1 << 14)] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weight.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 minus the share of bits that differ."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 32 hexadecimal digits), one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, hashes).hex() for t in b.column(1).to_pylist()], pa.string())], names=["k", "f"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, f string").select(F.col("k").alias(key), F.col("f").alias("fingerprint"))


def near_fingerprints(prints: DataFrame, radius: int, fingerprint: str = "fingerprint", pairs: bool = False) -> DataFrame:
    """(fingerprint, n_near): how many other distinct fingerprints differ in at most ``radius`` bits, where there are any.

    With ``pairs`` (a, b, distance) of all these a < b instead.  Nulls are left out.

    The bits are cut into ``radius + 2`` blocks; two fingerprints within the radius agree on two blocks at least, so each
    choice of two blocks is one table, keyed by their bits.  A pair counts in the table of the first two blocks that it
    agrees on.  Entries that no other one shares a key with leave before any comparison; a key's entries are compared in
    tiles of ``TILE`` by ``TILE``, each in a task of its own, and leave one count each.
    """
    if not 0 <= radius <= 14:
        raise ValueError("radius must be 0 to 14")
    spark = prints.sparkSession
    cut = np.linspace(0, BITS, radius + 3).round().astype(int).tolist()
    tables = list(itertools.combinations(range(radius + 2), 2))

    def bits(hi: np.ndarray, lo: np.ndarray, k: int) -> np.ndarray:
        """The bits of block ``k``, at most 64."""
        p, q = cut[k], cut[k + 1]
        left = (hi << U(p)) | (lo >> U(64 - p) if p else U(0)) if p < 64 else lo << U(p - 64)
        return left >> U(64 - (q - p))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 1 << 20):
            words = np.frombuffer(bytes.fromhex("".join(b.column(0).to_pylist())), ">u8").astype(U).reshape(-1, 2)
            hi, lo = words[:, 0], words[:, 1]
            for t, (i, j) in enumerate(tables):
                key = mix64(bits(hi, lo, i) + mix64(bits(hi, lo, j) + U(t + 1) * U(0x9E3779B97F4A7C15)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), t, np.int32)), *[pa.array(x.view(np.int64)) for x in (key, hi.copy(), lo.copy())]], names=["t", "key", "hi", "lo"])

    def tile(x, y, right, t, hi, lo):
        n = len(hi)
        left = np.flatnonzero(right == 0) if x != y else np.arange(n)
        other = np.flatnonzero(right == 1) if x != y else left
        i, j = tables[t]
        found = []
        step = max(1, (1 << 20) // max(1, len(other)))
        for at in range(0, len(left), step):
            u, v = (z.ravel() for z in np.meshgrid(left[at : at + step], other, indexing="ij"))
            if x == y:
                u, v = u[u < v], v[u < v]
            far = np.bitwise_count(hi[u] ^ hi[v]) + np.bitwise_count(lo[u] ^ lo[v])
            near = far <= radius
            u, v, far = u[near], v[near], far[near]
            agreed, ok = np.zeros(len(u), np.int64), np.ones(len(u), bool)
            for k in range(j + 1):
                same = bits(hi[u], lo[u], k) == bits(hi[v], lo[v], k)
                ok &= same if k in (i, j) else ~(same & (agreed < 2)) if k < j else ok
                agreed += same
            found.append((u[ok], v[ok], far[ok]))
        u, v, far = (np.concatenate([f[c] for f in found]) if found else np.empty(0, np.int64) for c in range(3))
        if pairs:
            swap = (hi[u] > hi[v]) | ((hi[u] == hi[v]) & (lo[u] > lo[v]))
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            return [hi[u], lo[u], hi[v], lo[v], far.astype(np.int64)]
        n_near = np.bincount(np.concatenate([u, v]), minlength=n)
        some = np.flatnonzero(n_near)
        return [hi[some], lo[some], n_near[some]]

    names = ["a_hi", "a_lo", "b_hi", "b_lo", "distance"] if pairs else ["hi", "lo", "n"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chunks(batches):
            now = [b.column(k).to_numpy() for k in range(7)]
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now, strict=True)]
            begins = np.flatnonzero(np.r_[True, (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]) | (now[2][1:] != now[2][:-1]) | (now[4][1:] != now[4][:-1])])
            yield from some(now, begins)
            held = [z[begins[-1] :] for z in now]
        if held is not None:
            yield from some(held, np.array([0, len(held[0])]))

    def some(now, begins):
        out = [tile(now[1][p], now[2][p], now[3][p:q], int(now[4][p]), now[5][p:q].view(U), now[6][p:q].view(U)) for p, q in itertools.pairwise(begins.tolist()) if q - p > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]).view(np.int64)) for c in range(len(names))], names=names)

    distinct = prints.select(F.col(fingerprint).alias("fp")).where("fp IS NOT NULL").distinct()
    keyed = distinct.mapInArrow(keys, "t int, key long, hi long, lo long")
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    rows = narrow_join(keyed, shared, "key")
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")).withColumn("home", F.pmod(F.xxhash64("hi", "lo"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("home", "other"), "y": F.greatest("home", "other"), "right": (F.col("home") > F.col("other")).cast("int")})
    order = ["key", "x", "y", "t", "right"]
    rows = rows.repartition(partitions(spark), "key", "x", "y").sortWithinPartitions(*order).select("key", "x", "y", "right", "t", "hi", "lo")
    found = rows.mapInArrow(compare, ", ".join(f"{c} long" for c in names))
    spell = lambda hi, lo: F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))
    if pairs:
        return found.select(spell("a_hi", "a_lo").alias("a"), spell("b_hi", "b_lo").alias("b"), F.col("distance").cast("int").alias("distance"))
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n_near")).select(spell("hi", "lo").alias("fingerprint"), "n_near")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of an edited copy and of its successor.

    Edited: the last quarter of the characters gives way to as many first ones of the successor.  Documents are dealt to
    key ranges, whose bounds are approximate quantiles: at most one for each shuffle partition.  The first document of
    each range is also sent to the range before, so each range knows all successors.
    """
    narrow = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    other = by_numbers(narrow, "doc_id", fingerprint_edits, ["doc_id"])
    if other is not None:
        return other
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).withColumn("k", F.coalesce("id", F.lit(-(1 << 63))))
    n = partitions(spark)
    found = rows.agg(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, max(n, 2))]), 100 * n)).first()[0] or []
    bounds = sorted(set(found))
    step = max(1, int(len(bounds) ** 0.5))
    # two levels: the group of bounds, then the place in it
    heads, groups = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if bounds:
        lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        rows = rows.withColumn("g", F.size(F.filter(lit(heads), lambda b: b <= F.col("k"))))
        inner = F.filter(F.element_at(F.array(*[lit(x) for x in groups]), F.greatest("g", F.lit(1))), lambda b: b <= F.col("k"))
        rows = rows.withColumn("bucket", F.when(F.col("g") == 0, 0).otherwise((F.col("g") - 1) * step + F.size(inner)).cast("int")).drop("g")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    firsts = sorted((r["bucket"], r["k"]) for r in rows.groupBy("bucket").agg(F.min("k").alias("k")).collect())  # a row for each range
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]
    heads_df = spark.createDataFrame(before, "k long, into int")
    sent = rows.join(F.broadcast(heads_df), "k").select("id", "t", "k", F.col("into").alias("bucket"), F.lit(1).alias("guest"))
    dealt = rows.select("id", "t", "k", "bucket", F.lit(0).alias("guest")).unionByName(sent)
    # Small numbers whose hash leads to each partition: ranges do not meet in one.
    seats = {r["p"]: r["k"] for r in spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()}
    seat = F.element_at(F.array(*[F.lit(seats.get(i, i)).cast("long") for i in range(n)]), F.col("bucket") % n + 1)
    dealt = dealt.withColumn("seat", seat).repartition(n, "seat").sortWithinPartitions("bucket", "guest", "k", "t").select("bucket", "guest", "id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, bucket = WordHashes(), None, None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for b in chunks(batches):
            out = []
            for k, guest, i, t in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                t = t or ""
                if guest and held is None:
                    continue  # a further guest
                f = fingerprint(t, hashes)
                if held is not None and bucket == k:
                    j, u, g = held
                    q = len(u) // 4
                    edited = u[: len(u) - q] + t[:q]
                    e = fingerprint(edited, hashes)
                    out.append((j, len(u), hashlib.sha256(edited.encode("utf-8")).hexdigest(), g.hex(), e.hex(), likeness(g, e), likeness(g, f)))
                held, bucket = (None if guest else (i, t, f)), k
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(7)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("doc_id", key)
