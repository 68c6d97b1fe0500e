"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

Words are the runs of ASCII letters and digits and of everything beyond ASCII, with A-Z lower-cased.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.  A window is the ordered set
of its shingles of ``shingle`` words (of all its words, where it has fewer).

1. One pass over the texts meets each position's shingle, by its hash and then by its words, with the distinct shingles of
   all items, and leaves a narrow row for each document: its items' shingles by position.
2. Shingles are ordered by how often they occur in the documents.  An exact match holds all shingles of a window, so the
   necessary prefix is one: the rarest.  Windows that have a shingle of no document are dropped.
3. Only prefix shingles join the documents' rows; a candidate is held to the bounds of place and length (the window must
   start and end within the document) and verified by the window's whole run of shingles at consecutive positions.

The items' side is counted and broadcast in slices of at most ``SLICE`` rows; a larger benchmark takes further passes, with
the same result.  What is grouped by document is bounded by the document's own words.

Defined results: null and empty texts have no words and no hits; an empty benchmark hits nothing; items that share windows
are all named; items without an id hit words but are not named; an id that several items carry is named once; rows that
repeat a document, or its id with other texts, are judged each for itself; texts of any length are read whole; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialize

NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of the items' side that are broadcast at once; about 40 MB.
SLICE = 200_000


def words_of(text: Column) -> Column:
    """Words of a text; only A-Z are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, NOT_WORD), "")


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, text, size, shingles): each item's windows, the words joined by single spaces."""
    n = F.size("w")
    cut = F.when(n >= window, F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda i: F.slice("w", i + 1, F.lit(window)))).otherwise(F.array("w"))
    rows = items.where(n > 0).select("item", F.explode(cut).alias("w")).select("item", F.array_join("w", " ").alias("text"), n.alias("size"), "w")
    width = F.least(n, F.lit(shingle))
    return rows.select("item", "text", "size", F.transform(F.sequence(F.lit(0), n - width), lambda i: F.slice("w", i + 1, F.least(F.size("w"), F.lit(shingle)))).alias("shingles"))


def slices(df: DataFrame, by: str, rows: int) -> list[DataFrame]:
    """``df`` of ``rows`` rows in broadcast slices of about ``SLICE``."""
    n = -(-rows // SLICE) or 1
    return [F.broadcast(df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) if n > 1 else df) for i in range(n)]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shingle_hits(docs: DataFrame, shingles: DataFrame, rows: int) -> DataFrame:
    """(key, digest, copies, n_words, ats, sids): a row for each distinct (key, text); places and shingles by width and place."""
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # at most as many as a shingle has words
    least, most = (widths[0], widths[-1]) if widths else (1, 1)
    parts = []
    for i, some in enumerate(slices(shingles, "key", rows)):
        # position -1 stands for the document itself
        at = docs.select("key", "digest", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(-1 if i == 0 else 0), F.greatest(F.size("w") - least, F.lit(-1 if i == 0 else 0)))).alias("at"))
        code = lambda n: F.when(F.col("at") >= 0, F.xxhash64(*[F.get("w", F.col("at") + j) for j in range(n)]))
        if len(widths) < 2:
            at = at.withColumn("code", code(most))
        else:
            kinds = F.array(*[F.struct(F.lit(n).alias("width"), code(n).alias("code")) for n in widths])
            at = at.withColumn("x", F.explode(F.when(F.col("at") >= 0, kinds).otherwise(F.slice(kinds, 1, 1)))).select("*", "x.code")
        same = (F.col("code") == F.col("s.key")) & (F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("s.width")) == F.col("s.words"))
        met = at.join(some.alias("s"), same, "left").where("at < 0 OR sid IS NOT NULL")
        parts.append(met.select(at["key"], "digest", "n_words", "at", "width" if len(widths) < 2 else F.col("s.width").alias("width"), "sid"))
    hit = F.when(F.col("at") >= 0, F.struct("width", "at", "sid"))
    rows = union(parts).groupBy("key", "digest").agg(F.sum(F.when(F.col("at") < 0, 1)).alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"))
    return rows.select("key", "digest", "copies", "n_words", F.col("hits.at").alias("ats"), F.col("hits.sid").alias("sids"))


def occurrences(found: DataFrame, probes: DataFrame, rows: int) -> DataFrame:
    """(key, digest, copies, n_words, spans, wids): ``found`` with the windows that occur and the words that they hit."""
    parts = []
    for i, some in enumerate(slices(probes, "sid", rows)):
        first = -1 if i == 0 else 0
        each = found.select("*", F.explode(F.sequence(F.lit(first), F.greatest(F.size("sids") - 1, F.lit(first)))).alias("i")).withColumn("sid", F.get("sids", F.col("i")))
        start = F.get("ats", F.col("i")) - F.col("p.offset")
        count = F.size("p.sids")
        bounds = (F.col("i") >= F.col("p.offset")) & (start >= 0) & (start + F.col("p.size") <= F.col("n_words"))
        run = F.slice(each["sids"], F.greatest(F.col("i") - F.col("p.offset"), F.lit(0)) + 1, count) == F.col("p.sids")
        ends = (F.get("ats", F.col("i") - F.col("p.offset")) == start) & (F.get("ats", F.col("i") - F.col("p.offset") + count - 1) == start + count - 1)
        met = each.join(some.alias("p"), (each["sid"] == F.col("p.sid")) & bounds & run & ends, "left").where("i < 0 OR wid IS NOT NULL")
        parts.append(met.select("key", "digest", "copies", "n_words", "i", "wid", F.when(F.col("wid").isNotNull(), F.struct(start.alias("start"), (start + F.col("p.size")).alias("end"))).alias("place")))
    # a document has a row of its own (i = -1), once
    rows = union(parts).groupBy("key", "digest").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("place")).alias("places"), F.collect_set("wid").alias("wids"))
    return rows.withColumn("spans", merged("places")).drop("places")


def merged(places: str) -> Column:
    """Sorted intervals as disjoint ones: array<struct<start,end>>."""
    kind = "array<struct<start:int,end:int>>"
    one = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    none = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    step = lambda acc, x: (
        F.when(acc["start"].isNull(), F.struct(acc["done"].alias("done"), x["start"].alias("start"), x["end"].alias("end")))
        .when(x["start"] <= acc["end"], F.struct(acc["done"].alias("done"), acc["start"].alias("start"), F.greatest(acc["end"], x["end"]).alias("end")))
        .otherwise(F.struct(F.concat(acc["done"], one(acc["start"], acc["end"])).cast(kind).alias("done"), x["start"].alias("start"), x["end"].alias("end")))
    )
    close = lambda acc: F.when(acc["start"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], one(acc["start"], acc["end"])))
    return F.aggregate(F.col(places), none, step, close)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: ``key``, n_words, ``spans`` (array<struct<start,end>>, words from 0, disjoint and in order) and ``items``
    (ids of the items that have a window in it, each once)."""
    windows = materialize(item_windows(benchmark.select(benchmark[item].alias("item"), words_of(benchmark[item_text]).alias("w")), window, shingle), "windows")
    distinct = materialize(windows.dropDuplicates(["text"]).select(F.monotonically_increasing_id().alias("wid"), "text", "size", "shingles"), "distinct")
    each = distinct.select(F.explode("shingles").alias("words")).distinct()
    width = F.size("words")
    code = reduce(lambda out, n: F.when(width == n, F.xxhash64(*[F.get("words", F.lit(j)) for j in range(n)])).otherwise(out), range(1, shingle + 1), F.lit(None).cast("long"))
    shingles = materialize(each.select(F.monotonically_increasing_id().alias("sid"), width.alias("width"), code.alias("key"), "words"), "shingles")
    n_shingles, n_windows = shingles.count(), distinct.count()

    body = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("t"))
    body = body.select("key", F.sha2("t", 256).alias("digest"), words_of(F.col("t")).alias("w"))
    found = materialize(shingle_hits(body, shingles, n_shingles), "hits")

    # rarity: how often each shingle was met; the rarest of a window is its prefix, windows with an absent one cannot occur
    rarity = found.select(F.explode("sids").alias("sid")).groupBy("sid").agg(F.count("*").alias("n"))
    parts = distinct.select("wid", "size", F.posexplode("shingles").alias("offset", "words")).join(shingles.select("words", "sid"), "words").join(rarity, "sid", "left")
    order = F.array_sort(F.collect_list(F.struct("offset", "sid")))
    probes = parts.groupBy("wid", "size").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "sid", "offset")).alias("low"), order.alias("run")).where("absent = 0")
    probes = materialize(probes.select("low.sid", "low.offset", "wid", "size", F.col("run.sid").alias("sids")), "probes")

    placed = occurrences(found, probes, n_windows)
    named = distinct.select("wid", "text").join(windows.where("item IS NOT NULL").select("text", "item").distinct(), "text").select("wid", "item")
    named = materialize(named, "named")
    named = F.broadcast(named) if named.count() <= SLICE else named
    rows = placed.select("*", F.explode_outer("wids").alias("wid")).join(named, "wid", "left").groupBy("key", "digest").agg(F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.first("spans").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    out = rows.select(F.col("key").alias(key), F.col("n_words").cast("long").alias("n_words"), "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    discard(shingles, windows, distinct)
    return out
