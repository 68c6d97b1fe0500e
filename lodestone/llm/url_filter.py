"""URL filters: rules by host and path, and a classifier of segmented names for the rest.

Names are cut at dots, hyphens and slashes, and the remaining concatenations are split into words by a unigram Viterbi:
known words cost their negative log probability, unknown runs a price that grows with their length.  Multinomial naive
Bayes over the words of host and path gives the verdict where no rule fits.  It is trained on the URLs that a rule decides,
with the rule's verdict; the two fixed lists of words count as known before any URL is read.

Nothing of the model is held whole by a worker.  The segmenter's words are the names of ``SHORTEST`` letters or more that
stand by themselves in URLs of several hosts; a name counts once for each host beyond its first, so that none is taken
for a word on its own evidence.  They are a table, which is asked for the pieces of the distinct runs of letters; a run is then
split by the words that were found in it.  The classifier's log ratios are a table too, joined with the words of the
distinct URLs and summed by URL.  Rare and frequent words are treated alike, whatever the input's size.

Defined results: a URL that is null or has no ``://`` has an empty host and path; those, like hosts without words, are
allowed by the method; numbers in names count as one word; names of any length are segmented whole; rows that repeat are
judged alike; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.byte_bpe import Remembered
from lodestone.llm.shared import bounded_batches, discard, materialize, narrow_join

#: (rule, verdict): a host, a slash and the start of a path; the longest that fits decides.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Words of unwanted sites.
BLOCK_WORDS = frozenset("adult ads adserver adware banner bet bets betting bingo blackjack bonus casino cheap cialis click clickbait crack cracked darknet erotic escort farm fetish free fuck gamble gambling hack hentai jackpot keygen lottery malware milf nude nudes payday phishing pills piracy poker popup porn porno ransom roulette scam sex sexy slot slots spam spyware steroids strip swinger torrent track tracker tracking trojan viagra virus warez webcam win winner xanax xxx".split())
#: Ordinary words of site names; they compete with the others in segmentation.
PLAIN_WORDS = frozenset("about account air all america app apps archive art arts auto baby bank beauty best blog board body book books box business buy cafe camera camp car care center chat chess church city class clean cloud club code coffee college com computer cook craft daily data dance day design digital direct docs dog dream drive earth east easy eco edu energy europe event example express fact family fan fashion film finance fire fish fit flower food forum game garden gift girl global go gold green group guide hair hand health help history home hope host hotel house idea image info institute inter jazz job journal kid kids kitchen lab land language law learn library life light line link list live local love mail map market master math media medicine meet mobile money moon mountain movie museum music nature net network news north ocean office online open page paint paper park part party peace people pet phone photo place plan planet play plus poem point post power press pro project radio rail real recipe red report research river road rock room school science sea search secure server service shop show site sky smart snow social soft solar song sound south space sport sports star state stay stone store story street student studio style sun support team tech test theater theatre times today tool town toy trade train travel tree trust tube university video view village visit voice walk wall water weather web week west wiki wild wind window wine winter wood word work works world yoga young zone".split())

CUT = re.compile(r"[^a-z0-9\u0080-\U0010ffff]+")
#: Count that a listed word has in the unigram model beside its own occurrences.
LISTED = 200
#: Letters of a word of the segmenter at least; shorter names are runs of their own.
SHORTEST = 3
#: Distinct URLs up to which their verdicts are broadcast to the pages.
JUDGED = 100_000
#: Price of an unknown run's letter.
UNKNOWN = 2.5
SMOOTH = 0.5
#: Occurrences that a listed word has in its class beside those in the URLs; both lists weigh the same.
KNOWN = 5


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.split(r"[?#]", rest[end:], maxsplit=1)[0] if rest[end : end + 1] == "/" else ""
    return host, path


def ruled(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits."""
    best: tuple[str | None, str | None] = (None, None)
    for rule, verdict in rules:
        of, slash, start = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith(slash + start) and (best[0] is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def best_split(name: str, words: list[list[tuple[int, float]]], begin: float) -> tuple[str, ...]:
    """The cheapest way to cut a run of letters into ``words[at]`` (size, cost) and unknown runs, which cost ``begin`` and
    ``UNKNOWN`` for each letter.  States at each place: to end a word there, and to be within an unknown run."""
    n = len(name)
    word: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
    run = (math.inf, 0)
    for at in range(n + 1):
        if run[0] < word[at][0]:
            word[at] = run
        cost = word[at][0]
        for size, known in words[at] if at < n else ():
            if cost + known < word[at + size][0]:
                word[at + size] = cost + known, at
        run = min(run, (cost + begin, at))
        run = run[0] + UNKNOWN, run[1]
    out, end = [], n
    while end:
        start = word[end][1]
        out.append(name[start:end])
        end = start
    return tuple(reversed(out))


def letter_runs(name: str) -> list[str]:
    """A name's runs of letters in lower case, and ``#`` for each run of digits."""
    runs = [run for part in CUT.split(name.lower()) for run in re.findall(r"[0-9]+|[^0-9]+", part)]
    return ["#" if run.isascii() and run.isdigit() else run for run in runs]


class Segmenter:
    """Splits concatenated names by the unigram probabilities of ``counts``, a vocabulary that fits a worker."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) or 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.sizes = sorted({len(w) for w in counts})
        self.split = Remembered(self._split, 100_000).__getitem__

    def _split(self, name: str) -> tuple[str, ...]:
        found = [[(n, self.cost[w]) for n in self.sizes if (w := name[at : at + n]) in self.cost and at + n <= len(name)] for at in range(len(name))]
        return best_split(name, found, math.log(self.total))

    def words(self, name: str) -> list[str]:
        return [w for run in letter_runs(name) for w in (("#",) if run == "#" else self.split(run))]


def names_of(host: str) -> str:
    """A host without user, port and last label."""
    return host.rsplit("@", 1)[-1].split(":")[0].rpartition(".")[0]


def features(url: str | None, segmenter: Segmenter) -> list[str]:
    """Words of the host without its last label, marked ``h:``, and of the path, marked ``p:``."""
    host, path = host_and_path(url)
    return ["h:" + w for w in segmenter.words(names_of(host))] + ["p:" + w for w in segmenter.words(path)]


PARSED = "u string, copies long, host string, path string, rule string, fixed string, names array<string>, runs array<struct<mark:string,run:string>>"


def parsed(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Distinct URLs (a null one is empty) with their copies, host, path, rule, its verdict, names and runs of letters."""
    bounded_batches(pages.sparkSession)
    kinds = {"copies": pa.int64(), "names": pa.list_(pa.string()), "runs": pa.list_(pa.struct([("mark", pa.string()), ("run", pa.string())]))}
    columns = [c.split()[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = host_and_path(u)
                names = [w for w in CUT.split(host.lower()) + CUT.split(path.lower()) if len(w) >= SHORTEST and w.isalpha()]
                runs = [{"mark": mark, "run": r} for mark, of in (("h:", names_of(host)), ("p:", path)) for r in letter_runs(of)]
                out.append((u, copies, host, path, *ruled(host, path, rules), names, runs))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds.get(c, pa.string())) for i, c in enumerate(columns)], names=columns)

    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("u")).groupBy("u").agg(F.count("*").alias("copies"))
    return materialize(urls.mapInArrow(run, PARSED), "urls")


def vocabulary_of(urls: DataFrame) -> DataFrame:
    """(word, n): in how many hosts beyond its first a name stands by itself, and the listed words with a count of their own.

    A name that splits into listed words is no word of its own, however often it stands.
    """
    listed = {w: LISTED for w in BLOCK_WORDS | PLAIN_WORDS}

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = Segmenter(listed)
        for b in batches:
            yield b.filter(pa.array([w in listed or any(x not in listed for x in first.split(w)) for w in b.column(0).to_pylist()], pa.bool_()))

    names = urls.select("host", F.explode("names").alias("word")).distinct().groupBy("word").agg((F.count("*") - 1).alias("n")).where("n > 0")
    rows = materialize(names.mapInArrow(own, "word string, n long"), "words")
    every = rows.agg(F.sum("n")).first()[0] or 0
    count = int(LISTED * max(1.0, every / (LISTED * len(listed))))
    more = urls.sparkSession.createDataFrame([(w, count) for w in sorted(listed)], "word string, n long")
    return materialize(rows.unionByName(more).groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def splits(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(run, words) for the distinct ``runs(run)`` of letters: the pieces of a run that are words are asked of the table."""
    total = vocabulary.agg(F.sum("n")).first()[0] or 1
    sizes = sorted(r["n"] for r in vocabulary.select(F.length("word").alias("n")).distinct().collect())  # a number for each length

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for run in b.column(0).to_pylist():
                found = [(at, run[at : at + n]) for n in sizes if n <= len(run) for at in range(len(run) - n + 1)]
                for k in range(0, max(1, len(found)), 10_000):
                    part = found[k : k + 10_000] or [(None, None)]  # a run without pieces stays
                    yield pa.RecordBatch.from_arrays([pa.array([run] * len(part), pa.string()), pa.array([a for a, _ in part], pa.int32()), pa.array([p for _, p in part], pa.string())], names=["run", "at", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for run, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words: list[list[tuple[int, float]]] = [[] for _ in run]
                for x in sorted(found, key=lambda x: (x["at"], x["size"])):
                    words[x["at"]].append((x["size"], -math.log(x["n"] / total)))
                out.append(list(best_split(run, words, math.log(total))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["run", "words"])

    asked = runs.mapInArrow(pieces, "run string, at int, word string")
    met = narrow_join(asked, vocabulary, "word", "left")
    places = F.collect_list(F.when(F.col("n").isNotNull(), F.struct("at", F.length("word").alias("size"), "n")))
    return materialize(met.groupBy("run").agg(places.alias("found")).mapInArrow(cut, "run string, words array<string>"), "splits")


def url_words(urls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(u, mark, place, word) of ``parsed`` URLs; a URL without words is not there."""
    each = urls.select("u", F.posexplode("runs").alias("place", "x")).select("u", "place", "x.*")
    known = splits(each.select("run").where("run <> '#'").distinct(), vocabulary)
    met = narrow_join(each, known, "run", "left").withColumn("words", F.coalesce("words", F.array("run")))
    return materialize(met.select("u", "mark", "place", F.posexplode("words").alias("part", "word")), "url-words")


def fit(pages: DataFrame, url: str = "url", rules=RULES) -> dict:
    """The model as tables: ``vocabulary`` of the segmenter, log ``ratio`` of the classifier's words; numbers ``unseen`` and
    ``prior``.  With them the fitted pages' own ``urls`` and ``words``."""
    urls = parsed(pages, url, rules)
    vocabulary = vocabulary_of(urls)
    found = url_words(urls, vocabulary)
    ruled_urls = urls.where("fixed IS NOT NULL").select("u", "copies", (F.col("fixed") == "block").cast("int").alias("kind"))
    word = F.concat("mark", "word").alias("word")
    met = found.join(ruled_urls, "u").groupBy(word, "kind").agg(F.sum("copies").cast("double").alias("n"))
    # A listed word is known before it is met; both lists weigh the same.
    known = [("h:" + w, kind, KNOWN * len(BLOCK_WORDS) / len(of)) for kind, of in ((1, BLOCK_WORDS), (0, PLAIN_WORDS)) for w in sorted(of)]
    rows = met.unionByName(urls.sparkSession.createDataFrame(known, "word string, kind int, n double"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0.0))
    words = materialize(rows.groupBy("word").agg(of(1).alias("n1"), of(0).alias("n0")), "ratios")
    size, t1, t0 = words.agg(F.count("*"), F.sum("n1"), F.sum("n0")).first()
    t1, t0 = (t + SMOOTH * (size + 1) for t in (t1, t0))
    ratio = F.log((F.col("n1") + SMOOTH) / t1) - F.log((F.col("n0") + SMOOTH) / t0)
    docs = {r["kind"]: r["n"] for r in ruled_urls.groupBy("kind").agg(F.sum("copies").alias("n")).collect()}
    return {"vocabulary": vocabulary, "ratio": words.select("word", ratio.alias("ratio")), "unseen": math.log(t0 / t1), "prior": math.log((docs.get(1, 0) + 1) / (docs.get(0, 0) + 1)), "urls": urls, "words": found}


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, score (probability of block by the method), host_words."""
    model = fit(pages, url, rules)
    found = narrow_join(model["words"].withColumn("marked", F.concat("mark", "word")), model["ratio"].withColumnRenamed("word", "marked"), "marked", "left")
    in_host = F.array_sort(F.collect_list(F.when(F.col("mark") == "h:", F.struct("place", "part", "word"))))
    sums = found.groupBy("u").agg(F.sum(F.coalesce("ratio", F.lit(model["unseen"]))).alias("z"), F.array_join(F.transform(in_host, lambda x: x["word"]), " ").alias("host_words"))
    odds = F.coalesce(F.lit(model["prior"]) + F.col("z"), F.lit(-20.0))
    score = F.round(1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-500.0)), F.lit(500.0)))), 9)
    judged = model["urls"].select("u", "host", "path", "rule", "fixed").join(sums, "u", "left").withColumn("score", score)
    judged = materialize(judged.withColumn("host_words", F.coalesce("host_words", F.lit(""))), "judged")
    discard(model["urls"], model["words"], model["vocabulary"])
    out = narrow_join(pages.select(F.col(key).alias("k"), F.coalesce(F.col(url), F.lit("")).alias("u")), judged, "u", limit=JUDGED)
    verdict = F.coalesce("fixed", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select(F.col("k").alias(key), "host", "path", "rule", verdict.alias("verdict"), "score", "host_words")
