"""Toxicity scores of texts after noisy-channel deobfuscation.

Fitting (bounded sample of labelled documents, ``MAX_TRAIN``): distinct words are counted by label; words that are much
likelier in toxic documents form the lexicon, with the logarithm of that ratio as weight.  A character trigram model is
trained on all documents, with the lexicon's words weighted up.

Scoring: plain words are looked up as they stand.  Words that may be disguised (digits or signs among letters, letters
doubled, runs of single spaced letters or signs) become a lattice: each character offers the letters it may stand for, a sign may
also be dropped, and a run of equal letters may be one or two.  Viterbi decoding finds the path of least cost under
channel costs and the character model; the restored word is scored in place of the written one.  Words no path of whose
lattice spells a lexicon word are left out before decoding, whatever their length.  The score is the
logistic of the intercept plus the weights of the distinct lexicon words found.

Inputs of a score are the text and the model alone.  Defined results: null and empty texts score the intercept; rows
that repeat score alike; labels that are null, or whose document is missing, are left out of fitting; without labelled
rows of both kinds the lexicon is empty and all texts score 0.5 or less; empty tables give empty results; other input
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_bpe import Remembered
from lodestone.llm.shared import bounded_batches, materialize
from lodestone.llm.words import WordHashes, chunks, shingles

#: Labelled documents that are used for fitting, at most; those of least hash of the key.
MAX_TRAIN = 40_000
#: A lexicon word's count in the character model: at least this, and together this share of all letters.
LEXICON_WEIGHT, LEXICON_SHARE = 50, 0.01
#: Logarithm of how much likelier a lexicon word is in toxic documents, and the share of those that it is in, at least.
LEAST_RATIO, LEAST_SHARE = 2.0, 0.005
#: Other documents that a word is supposed to be in beyond those counted: keeps chance words of small samples out.
UNSEEN = 2.5

#: What signs and digits stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Signs that may stand between letters and mean nothing.
NOISE = "*.-_~'`^#%&/\\,:;=+!|$@"

EDGE = re.compile(r"^[^\w@$€£(]+|[^\w]+$")
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$€£!|+(])[.\-_*]?\s+){2,}(?:[^\W_]|[@$€£!|+(])[.,;:?!\-_*]*(?!\S)")
PLAIN = re.compile(r"[^\W\d_]+\Z")
DOUBLE = re.compile(r"([^\W\d_])\1")
#: Channel cost of a word's end between spaced letters.
GAP = 1.0


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


#: The letters of the character model, in code order; everything else is a word's end, " ".
LETTERS = [chr(c) for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()]
CODES = np.zeros(0x181, np.int64)
for _i, _c in enumerate(LETTERS):
    CODES[ord(_c)] = _i + 1
WIDTH = len(LETTERS) + 1


def trigram_counts(texts: list[str | None], total: np.ndarray) -> None:
    """Add the texts' character trigrams to ``total``, an array of WIDTH ** 3 counts."""
    for t in texts:
        if t:
            c = CODES[np.minimum(np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "replace"), np.uint32), 0x180)]
            np.add.at(total, (c[:-2] * WIDTH + c[1:-1]) * WIDTH + c[2:], 1)


def trigram_text(code: int) -> str:
    return "".join([" ", *LETTERS][x] for x in (code // WIDTH // WIDTH, code // WIDTH % WIDTH, code % WIDTH))


class CharModel:
    """Character trigrams, interpolated with bigrams and unigrams by Witten-Bell weights."""

    def __init__(self, trigrams: dict[str, int], lexicon: list[str]):
        self.tri, self.bi, self.uni, self.after2, self.after1 = Counter(trigrams), Counter(), Counter(), Counter(), Counter()
        each = max(LEXICON_WEIGHT, LEXICON_SHARE * sum(trigrams.values()) / (8 * max(1, len(lexicon))))
        for word in lexicon:
            s = f"^ {word} "
            for i in range(2, len(s)):
                self.tri[s[i - 2 : i + 1]] += each
        for g, n in self.tri.items():
            self.bi[g[1:]] += n
            self.uni[g[2]] += n
            self.after2[g[:2]] += n
        for g, n in self.bi.items():
            self.after1[g[0]] += n
        self.kinds2, self.kinds1 = Counter(g[:2] for g in self.tri), Counter(g[0] for g in self.bi)
        self.total, self.memo = sum(self.uni.values()), {}

    def cost(self, context: str, c: str) -> float:
        """Negative log probability of ``c`` after the two characters of ``context``."""
        key = context + c
        got = self.memo.get(key)
        if got is None:
            p1 = (self.uni[c] + 0.1) / (self.total + 20)
            n1, k1 = self.after1[context[1]], self.kinds1[context[1]]
            p2 = (self.bi[key[1:]] + k1 * p1) / (n1 + k1) if n1 else p1
            n2, k2 = self.after2[context], self.kinds2[context]
            p3 = (self.tri[key] + k2 * p2) / (n2 + k2) if n2 else p2
            got = -math.log(p3)
            if len(self.memo) < 100_000:
                self.memo[key] = got
        return got


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the letters it may stand for and their channel costs."""
    out, i = [], 0
    while i < len(word):
        c, n = word[i], 1
        while i + n < len(word) and word[i + n] == c:
            n += 1
        if c.isalpha():
            options = [(c, 0.0 if n == 1 else 0.7)]
            if n > 1:
                options.append((c * 2, 0.0 if n == 2 else 0.7))
        else:
            options = [(x, 1.0) for x in LEET.get(c, "")]
            options += [(x * 2, 1.2) for x in LEET.get(c, "") if n > 1]
            if c in NOISE or not options:
                options.append(("", 2.0 if c in LEET else 1.0))
            if c.isdigit():
                options.append((c * n, 3.0))
        out.append(options)
        i += n
    return out


def reaches(steps: list[list[tuple[str, float]]], heads: set[str], words, anywhere: bool = False) -> bool:
    """Whether a path of the lattice spells one of ``words``, whose beginnings are ``heads``; ``anywhere``: in a part of it."""
    states = {""}
    for options in steps:
        states = {t for s in states for letters, _ in options if (t := s + letters) in heads}
        if anywhere:
            if not states.isdisjoint(words):
                return True
            states.add("")
        elif not states:
            return False
    return not states.isdisjoint(words)


def restore(word: str, model: CharModel, spaced: bool = False) -> str:
    """The likeliest plain word behind ``word``: Viterbi over the lattice; states are the last two letters, all kept.

    With ``spaced`` words may end between any two characters; they are returned with blanks between them.
    """
    paths: dict[str, tuple[float, tuple | None]] = {"^ ": (0.0, None)}
    for options in lattice(word):
        step: dict[str, tuple[float, tuple | None]] = {}
        if spaced:
            for context, (cost, back) in list(paths.items()):
                if context[1] != " ":
                    total, ctx = cost + GAP + model.cost(context, " "), context[1] + " "
                    if ctx not in paths or total < paths[ctx][0]:
                        paths[ctx] = (total, (back, " "))
        for context, (cost, back) in paths.items():
            for letters, channel in options:
                total, ctx = cost + channel, context
                for c in letters:
                    total += model.cost(ctx, c)
                    ctx = ctx[1] + c
                if ctx not in step or total < step[ctx][0]:
                    step[ctx] = (total, (back, letters) if letters else back)
        paths = step
    _, back = min(((cost + model.cost(ctx, " "), back) for ctx, (cost, back) in paths.items()), default=(0.0, None), key=lambda x: x[0])
    out = []
    while back is not None:
        back, letters = back
        out.append(letters)
    return "".join(reversed(out))


class Scorer:
    """Scores texts with a fitted lexicon, intercept and character model."""

    def __init__(self, weights: dict[str, float], intercept: float, trigrams: dict[str, int]):
        self.weights, self.intercept, self.model = weights, intercept, CharModel(trigrams, sorted(weights))
        self.heads = {w[:i] for w in weights for i in range(len(w) + 1)}
        self.longest = max(map(len, weights), default=0)
        self.look = Remembered(self.lexicon_word, 120_000).__getitem__

    def lexicon_word(self, raw: str) -> str:
        """The lexicon word that a written one means, or ''."""
        if raw in self.weights:
            return raw
        word = EDGE.sub("", raw)
        if word in self.weights:
            return word
        if PLAIN.match(word) and not DOUBLE.search(word) or not any(c.isalpha() for c in word) and not any(c in LEET for c in word):
            return ""
        for w in dict.fromkeys((word, raw)):
            # most words reach no lexicon word by any path, which is told without the model
            if reaches(lattice(w), self.heads, self.weights) and (found := restore(w, self.model)) in self.weights:
                return found
        return ""

    def found(self, text: str | None) -> set[str]:
        out = set(map(self.look, set(words_of(text))))
        if text:
            for m in SPACED.finditer(text):
                run = "".join(m.group().lower().split())
                letters = "".join(c for c in run if c.isalnum())
                out.update((self.look(letters), self.look(run)))
                # letters of several words in a row: each run of lexicon length, and the likeliest words behind the signs
                out.update(self.spelled(letters))
                if reaches(lattice(run), self.heads, self.weights, anywhere=True):
                    out.update(w for w in restore(run, self.model, spaced=True).split() if w in self.weights)
        out.discard("")
        return out

    def spelled(self, letters: str) -> set[str]:
        """Lexicon words of four letters or more anywhere in a run of spaced letters."""
        return {letters[i:j] for i in range(len(letters)) if letters[i] in self.heads for j in range(i + 4, min(len(letters), i + self.longest) + 1) if letters[i:j] in self.weights}

    def score(self, text: str | None) -> float:
        return self.of_terms(sorted(self.found(text)))

    def of_terms(self, terms: list[str]) -> float:
        z = self.intercept + sum(self.weights[w] for w in terms)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def choose(rows: list[tuple[str, int, int]], n1: int, n0: int, least_ratio: float = LEAST_RATIO) -> tuple[dict[str, float], float]:
    """Lexicon weights and intercept from (word, toxic documents, other documents)."""
    weights = {word: math.log((a + 0.5) / (n1 + 1)) - math.log((b + UNSEEN) / (n0 + 1)) for word, a, b in rows}
    return {w: x for w, x in sorted(weights.items()) if x >= least_ratio}, min(0.0, math.log((n1 + 0.5) / (n0 + 0.5)))


def bare(text: str | None) -> set[str]:
    """A text's distinct words without signs at their ends."""
    out = {EDGE.sub("", w) for w in set(words_of(text))}
    out.discard("")
    return out


def _held_out(key: str):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", max_train: int = MAX_TRAIN) -> dict:
    """Lexicon, intercept and character trigrams; labels of held-out rows (crc32 of the key mod 3 is 1) are not read.

    The labelled sample holds about ``max_train`` rows at most, by hash of the key, whatever the input's size.  Of
    documents that share their least shingle hash, and so are most likely copies, one is counted.  The trigrams are
    those of all documents.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    train = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull() & ~_held_out(key)).groupBy(F.col(key).cast(kind).alias("id")).agg(F.max(toxic).cast("int").alias("y"))
    n = train.count()
    if n > max_train:
        train = train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    labelled = texts.join(F.broadcast(train), "id")  # at most about max_train rows of two numbers

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in chunks(batches):
            least = [int(s[0]) >> 1 if len(s := shingles(t, hashes)) else None for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(least, pa.int64())], names=["id", "y", "least"])

    printed = labelled.select("id", "t", "y").mapInArrow(prints, f"id {kind}, y int, least long").where("least IS NOT NULL")
    chosen = materialize(printed.groupBy("least", "y").agg(F.min("id").alias("id")).select("id", "y").distinct(), "toxic-sample")
    size = {r["y"]: r["n"] for r in chosen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    least_count = max(3, math.ceil(LEAST_SHARE * n1))

    def count(only: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter[str] = Counter()
            for b in chunks(batches):
                for t in b.column(0).to_pylist():
                    found.update(bare(t) if only is None else bare(t) & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        return run

    def counted(y: int, only: frozenset[str] | None) -> DataFrame:
        of = texts.join(F.broadcast(chosen.where(F.col("y") == y).select("id")), "id").select("t")
        return of.mapInArrow(count(only), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    # A candidate stands in LEAST_SHARE of the toxic sample, so there are at most 1 / LEAST_SHARE times the words of a text.
    often = {r["word"]: r["n"] for r in counted(1, None).where(F.col("n") >= least_count).collect()} if n1 else {}
    other = {r["word"]: r["n"] for r in counted(0, frozenset(often)).collect()} if often and n0 else {}
    weights, intercept = choose([(w, a, other.get(w, 0)) for w, a in often.items()], n1, n0)

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH**3, np.int64)
        for b in chunks(batches):
            trigram_counts(b.column(0).to_pylist(), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    grams = texts.select("t").mapInArrow(letters, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))  # WIDTH ** 3 rows at most
    return {"weights": weights, "intercept": intercept, "trigrams": {trigram_text(r["code"]): r["n"] for r in grams.collect()}}


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, terms): terms are the lexicon words found, sorted."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**sent.value)
        for b in chunks(batches):
            texts = b.column(1).to_pylist()
            found = [sorted(scorer.found(t)) for t in texts]
            scores = [scorer.of_terms(f) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], names=["k", "score", "terms"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double, terms array<string>").withColumnRenamed("k", key)


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``; all columns, in one pass."""
    bounded_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**sent.value)
        for b in chunks(batches):
            yield b.filter(pa.array([scorer.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted, terms) of each row of ``docs``."""
    model = fit(docs, labels, key, text, toxic)
    out = score(docs, model, key, text)
    return out.select(key, F.coalesce(_held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms")
