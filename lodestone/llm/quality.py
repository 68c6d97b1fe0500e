"""Text quality by the perplexity of an interpolated modified Kneser-Ney n-gram model trained on trusted text.

Texts are read as code points, with a mark after a word that repeats one of the few words before it, in 4-grams; a code
point of the basic plane is a symbol of its own, those beyond share 2,048.  The model: raw counts for 4-grams, continuation
counts below, three discounts for each order from its counts of counts, interpolation down to the uniform distribution.
It is kept as tables sharded by n-gram, which grow with the trusted text and go to no single place.

Scoring joins counts in shards: documents are dealt to chunks of about ``CHUNK_BYTES``, each chunk's distinct 4-grams are
joined with the tables, order by order, and the answers meet the chunk's documents, whose negative log probabilities are
summed there.  So a task holds the n-grams of one chunk, and a text is exchanged once.  A chunk is a run of rows of one
partition of the input, which is read twice for it; an input that is the result of a shuffle is written first.

A document's perplexity is ``exp(mean negative log probability)``, over its symbols and ``PRIOR`` symbols at its language's
median, which keeps short texts from being judged on a few letters.  Documents above the ``quantile`` of their language's
trusted documents (of those that the model has not seen) are rejected.  Medians and quantiles are exact, over means
rounded to ``PLACES`` digits.

Defined results: null and empty texts have the prior's perplexity, so they are kept; languages without trusted documents
(null included, as a language of its own) use the quantile of all trusted documents; without any trusted document the
model is uniform and all are kept; rows that repeat are scored alike; texts of any length are read whole; empty tables
give empty results; all columns of the input are kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.shared import bounded_batches, discard, materialize, narrow_join
from lodestone.llm.words import chunks

ORDER = 4
#: Symbols that there are, boundary, repetition mark and shared ones included.
SYMBOLS = 1 << 16
BITS = 16
#: Pseudo-symbols at the language's median that each document is scored with.
PRIOR = 60
#: A word of so many characters or more is marked if it is among the last ``BACK`` words.
LONG, BACK = 4, 12
#: The boundary before a text, and the mark of a repeated word.
BOUND, REPEAT = 0, 0xFFFF
#: Bytes of text that are scored together.
CHUNK_BYTES = 32 << 20
#: Bytes of text whose symbols are found together.
RUN_BYTES = 1 << 19
#: Digits of mean negative log probabilities.
PLACES = 3
#: Which code points are white space, NUL included; none is beyond the last.
BLANK = np.array([chr(c).isspace() or not c for c in range(0x3002)])


def symbol_run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some texts, three boundaries before each and one behind the last, and where the boundaries start."""
    units = np.frombuffer(("\0\0\0" + "\0\0\0".join(texts) + "\0").encode("utf-32-le", "replace"), np.uint32)
    out, beyond = units.astype(np.uint64), units > 0xFFFF
    if beyond.any():  # they share the places of the surrogates, which no text has
        out[beyond] = 0xD800 + out[beyond] % np.uint64(2048)
    offset = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])
    blank = BLANK[np.minimum(units, len(BLANK) - 1)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    if len(start) > 1:
        # a word's number: sums of mixed letters by place, upper case folded for ASCII
        size = end - start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        letters = units[np.repeat(start, size) + place].astype(np.uint64)
        letters[(letters >= 65) & (letters <= 90)] += np.uint64(32)
        mixed = (letters + np.uint64(0x9E37)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        word = np.add.reduceat(mixed, np.cumsum(size) - size)
        of = np.searchsorted(offset, start, side="right")
        again = np.zeros(len(word), bool)
        for back in range(1, min(BACK, len(word) - 1) + 1):
            again[back:] |= (word[back:] == word[:-back]) & (of[back:] == of[:-back])
        again &= size >= LONG
        out = np.insert(out, end[again], REPEAT)
        offset = offset + np.searchsorted(end[again], offset, side="right")
    return out, offset


def symbols(text: str | None) -> np.ndarray:
    """Symbols of a text, three boundaries in front."""
    return symbol_run([text or ""])[0][:-1]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' 4-grams as 64-bit numbers, the last symbol in the lowest 16 bits, and how many each text has."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    s, offset = symbol_run([t or "" for t in texts])
    codes = ((s[:-4] << np.uint64(48)) | (s[1:-3] << np.uint64(32)) | (s[2:-2] << np.uint64(16)) | s[3:-1]).view(np.int64)
    own = np.ones(len(codes), bool)
    between = offset[1:-1, None] - np.arange(1, ORDER)
    own[between[between >= 0]] = False
    return codes[own], np.diff(offset) - (ORDER - 1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts 1, 2 and 3 or more from the counts of counts 1 to 4; 0.5, 0.75, 0.9 of it where too few."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3, n4) == 0:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(v, 0.05), k - 0.05) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _counted(texts: DataFrame) -> DataFrame:
    """(gram, n) of a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, RUN_BYTES):
            codes, _ = grams(b.column(0).to_pylist())
            if len(codes):
                at, found = pd.factorize(codes)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(at, minlength=len(found)))], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _context(gram: Column | str) -> Column:
    return F.shiftrightunsigned(gram, BITS)


def _suffix(gram: Column | str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def train(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model of the texts (one column): for orders 1 to 4 the tables (gram, share) and (context, gamma).

    Each order's counts are sharded by n-gram and joined with their context's totals; an n-gram's share is its discounted
    count over the context's total, a context's gamma the part that its discounts leave to the order below.
    """
    level, out = materialize(_counted(texts), "grams"), []
    for order in range(ORDER, 0, -1):
        few = level.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()  # four rows
        d = discounts([next((r["m"] for r in few if r["n"] == k), 0) for k in range(1, 5)])
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = level.withColumn("context", _context("gram")).withColumn("cut", cut)
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("lost"))
        shares = materialize(rows.join(totals, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share")), f"shares{order}")
        out.append((shares, materialize(totals.select("context", (F.col("lost") / F.col("total")).alias("gamma")), f"gammas{order}")))
        if order > 1:  # continuation counts: in how many contexts' first symbols the shorter n-gram occurs
            level = materialize(level.groupBy(_suffix("gram", order).alias("gram")).agg(F.count("*").alias("n")), "grams")
    return out[::-1]


def probabilities(needed: DataFrame, model: list[tuple[DataFrame, DataFrame]], order: int = ORDER) -> DataFrame:
    """(gram, p) for the distinct n-grams ``needed(gram)``: joins with the shares, the gammas and the order below."""
    shares, gammas = model[order - 1]
    rows = needed.select("gram", _context("gram").alias("context"), _suffix("gram", order).alias("suffix"))
    rows = rows.join(shares, "gram", "left").join(gammas, "context", "left")
    if order == 1:
        below = F.lit(1 / SYMBOLS)
    else:
        shorter = materialize(needed.select(_suffix("gram", order).alias("gram")).distinct(), "needed")
        rows = rows.join(probabilities(shorter, model, order - 1).select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        below = F.col("below")
    return rows.select("gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * below).alias("p"))


def _fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores as make it unlike all ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def measured(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], text: str) -> tuple[DataFrame, str, str, list[DataFrame]]:
    """``docs`` with the number of symbols and their negative log probability; the names of these two columns; the tables
    that can go once the rows are written."""
    bounded_batches(docs.sparkSession)
    if re.search(r"\bExchange\b", docs._jdf.queryExecution().executedPlan().toString()):
        docs = materialize(docs, "measured")  # two readings must have the same partitions
    count, cost, chunk = (_fresh(docs.columns, x) for x in ("n_symbols", "nll", "chunk"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    per = max(1, rows * CHUNK_BYTES // max(size or 0, 1))
    # A chunk is a run of rows of one partition, whatever their keys, so none is hot; 2**30 chunks a partition at most.
    place = F.monotonically_increasing_id()
    number = F.shiftleft(F.shiftright(place, 33), 30) + F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}L) div {per}L")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.empty(0, np.int64)
        for b in chunks(batches, RUN_BYTES):
            texts, of_chunk = b.column(0).to_pylist(), b.column(1).to_pylist()
            for c in dict.fromkeys(of_chunk):
                if c != now and len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), now)), pa.array(held)], names=["chunk", "gram"])
                    held = held[:0]
                now = c
                codes, _ = grams([t for t, x in zip(texts, of_chunk, strict=True) if x == c and t])
                held = pd.unique(np.concatenate([held, pd.unique(codes)]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), now)), pa.array(held)], names=["chunk", "gram"])

    asked = materialize(docs.select(text, number.alias(chunk)).mapInArrow(ask, "chunk long, gram long"), "asked")
    needed = materialize(asked.select("gram").distinct(), "needed")
    answers = asked.join(probabilities(needed, model), "gram").select(F.col("chunk").alias("of_chunk"), "gram", (-F.log("p")).cast("float").alias("cost"))
    dealt = docs.withColumn(chunk, number)
    at, of = docs.columns.index(text), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.LongType()), T.StructField(cost, T.DoubleType())])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("gram").to_numpy()
        order = np.argsort(known)
        known, cost_of = known[order], right.column("cost").to_numpy()[order].astype(np.float64)
        n_, nll = [], []
        for b in chunks(left.to_batches(), RUN_BYTES):
            found, sizes = grams(b.column(at).to_pylist())
            codes, distinct = pd.factorize(found)
            place = np.searchsorted(known, distinct)
            if len(distinct) and (not len(known) or (known[np.minimum(place, len(known) - 1)] != distinct).any()):
                raise RuntimeError("a chunk's documents changed between its two readings")
            run = np.r_[0.0, np.cumsum(cost_of[place][codes])] if len(distinct) else np.zeros(1)
            ends = np.cumsum(sizes)
            n_.append(sizes)
            nll.append(run[ends] - run[ends - sizes])
        made = [pa.array(np.concatenate(n_) if n_ else np.empty(0, np.int64)), pa.array(np.concatenate(nll) if nll else np.empty(0))]
        return pa.Table.from_arrays([*[left.column(i) for i in range(of)], *made], schema=None, names=schema.fieldNames())

    out = dealt.groupBy(chunk).cogroup(answers.groupBy("of_chunk")).applyInArrow(answer, schema)
    return out, count, cost, [asked, needed]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quality: str = "quality", quantile: float = 0.999) -> dict:
    """The model and each language's median and limit, in nats a symbol.

    Trusted documents are those labelled 1.  Half of them by hash of the key train the model; the other half, which it
    has not seen, set medians and limits, so that they hold for documents outside the training text.
    """
    trusted = labels.where((F.col(quality) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND t <> ''")
    trusted = narrow_join(texts, materialize(trusted, "trusted"), "id")
    half = F.pmod(F.xxhash64("id"), F.lit(2))
    model = train(trusted.where(half == 0).select("t"))
    held, count, cost, spent = measured(trusted.where(half == 1).select("t", "l"), model, "t")
    held = materialize(held.select("l", F.col(count).alias("n"), F.col(cost).alias("nll")), "held")
    discard(*spent)
    mean = F.round(F.col("nll") / F.col("n"), PLACES)
    middle = held.agg(F.percentile(mean, F.lit(0.5))).first()[0]
    medians = held.groupBy("l").agg(F.percentile(mean, F.lit(0.5)).alias("median")).select(_language("l").alias("of"), "median")
    joined = narrow_join(held.withColumn("of", _language("l")), materialize(medians, "medians"), "of").withColumn("x", _mean("nll", "n"))
    overall = joined.agg(F.percentile("x", F.lit(quantile))).first()[0]
    limits = joined.groupBy("of").agg(F.first("median").alias("median"), F.percentile("x", F.lit(quantile)).alias("most"))
    flat = float(np.log(SYMBOLS))
    return {"model": model, "limits": materialize(limits, "limits"), "other": (flat if middle is None else middle, flat + 1 if overall is None else overall)}


def _language(c: str) -> Column:
    """A key of a language, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _mean(cost: str, count: str) -> Column:
    return F.round((F.col(cost) + PRIOR * F.col("median")) / (F.col(count) + PRIOR), PLACES)


def _judged(docs: DataFrame, fitted: dict, text: str, lang: str) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, the mean and whether it is good; and their names."""
    rows, count, cost, _ = measured(docs, fitted["model"], text)
    middle, most = fitted["other"]
    mean, good = _fresh(docs.columns, "mean"), _fresh(docs.columns, "good")
    limits = fitted["limits"].select(F.col("of").alias("_of"), F.struct("median", "most").alias("_limit"))
    clash = {"_of", "_limit"} & {c.lower() for c in docs.columns}
    if clash:
        limits = limits.withColumnsRenamed({c: _fresh(docs.columns, c) for c in clash})
    of, limit = (_fresh(docs.columns, c) for c in ("_of", "_limit"))
    rows = narrow_join(rows.withColumn(of, _language(lang)), limits, of, "left")
    median, least = F.coalesce(F.col(limit)["median"], F.lit(middle)), F.coalesce(F.col(limit)["most"], F.lit(most))
    value = F.round((F.col(cost) + PRIOR * median) / (F.col(count) + PRIOR), PLACES)
    return rows.select(*[rows[c] for c in docs.columns], value.alias(mean), ((F.col(count) == 0) | (value <= least)).alias(good)), mean, good


def score(docs: DataFrame, fitted: dict, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, perplexity, good) of each row."""
    rows, mean, good = _judged(docs.select(key, text, lang), fitted, text, lang)
    return rows.select(key, lang, F.exp(mean).alias("perplexity"), F.col(good).alias("good"))


def keep_good(docs: DataFrame, fitted: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are good, with all their columns."""
    rows, _, good = _judged(docs, fitted, text, lang)
    return rows.where(F.col(good)).select(*docs.columns)
