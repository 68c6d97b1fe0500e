"""Joins, components and the pipeline against plain versions that compare everything with everything."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import byte_bpe, embedding_dedup, jaccard_join, mixing, quality, shared, toxicity
from lodestone.llm.shared import components
from lodestone.llm.words import WordHashes, shingle_sets, shingles


def closure(ids, links):
    """Smallest id reachable of each."""
    of = {i: i for i in ids}

    def find(i):
        while of[i] != i:
            i = of[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def jaccard_truth(rows, num=80, den=100):
    s = {i: shingle_set(t) for i, t in rows}
    ids = sorted(s)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    comp = closure(ids, links)
    return {(i, len(s[i]), comp[i]) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Families of edited copies, a passage that many share, exact copies, short and long texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for size in (1, 3, 4, 5, 6, 9, 14, 30, 60, 150, 400, 1200):
        base = [word() for _ in range(size)]
        texts += [base, base] + [edited(rng, base, 1 + k * size // 150) for k in range(6)]
        other = [word() for _ in range(size)]
        texts += [passage + other, other + passage, passage + edited(rng, other, 2)]
    texts += [passage + [word() for _ in range(10)] for _ in range(25)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    ids = rng.sample(range(10_000), len(rows))
    return [(i, t) for i, (_, t) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard_truth(rows)


def signed(s, bands):
    g, _, empty = jaccard_join.sign_sets([s], bands)
    return g, empty[0]


def test_sets_sign_together_as_alone():
    rng, bands = np.random.default_rng(1), jaccard_join.Bands(4, 5)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in [1, 2, 3, 5, 500, 1, 40, 7000, 9]]
    g, owner, empty = jaccard_join.sign_sets(sets, bands)
    for k, s in enumerate(sets):
        alone, e = signed(s, bands)
        assert sorted(alone.tolist()) == sorted(g[owner == k].tolist()) and e.tolist() == empty[k].tolist() and len(set(alone.tolist())) == len(alone)
    texts = [None, "", "a", "a b c d", "a b c d e", "A b c d e f g " * 9, " \t x", "é ü ñ ö ß"]
    one = [shingles(t, WordHashes()) for t in texts]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(one, shingle_sets(texts, WordHashes()), strict=True))
    assert shingle_sets([], WordHashes()) == [] and [len(x) for x in shingle_sets(["a", None], WordHashes())] == [1, 0]


def test_signatures_meet_for_all_similar_pairs():
    """At and above the threshold a shared signature is certain, and no fewer are shared than the bound says."""
    rng = np.random.default_rng(4)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = base[rng.random(len(base)) > rng.random() * 0.25]
        more = rng.integers(0, 1 << 63, int(len(base) * rng.random() * 0.15)).astype(np.uint64)
        other = np.unique(np.concatenate([keep, more]))
        both = len(np.intersect1d(base, other))
        if not len(other) or 5 * both < 4 * (len(base) + len(other) - both):
            continue
        bands = jaccard_join.Bands(4, 5)
        (a, ea), (b, eb) = signed(base, bands), signed(other, bands)
        shared = len(np.intersect1d(a, b))
        assert shared >= bands.shared_least(np.array([len(base)]), np.array([len(other)]), np.array([ea]), np.array([eb]))[0] >= 1
        assert shared >= bands.shared_by_any(np.array([len(base)]), np.array([ea]))[0] >= 1
        assert shared >= bands.shared_by_any(np.array([len(other)]), np.array([eb]))[0] >= 1


@pytest.mark.parametrize("similarity", [(4, 5), (9, 10), (1, 2), (1, 1)])
def test_bounds_hold_for_the_largest_differences(similarity):
    """Pairs right at the threshold: every size, as many differences as it allows."""
    num, den = similarity
    rng, bands = np.random.default_rng(7), jaccard_join.Bands(num, den)
    for n in list(range(1, 130)) + [300, 700]:
        for extra in {0, 1, n // 20, n * den // num - n}:
            m = min(n + extra, n * den // num)
            both = -(-num * (n + m) // (num + den))  # least intersection
            if both > n:
                continue
            pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m)).astype(np.uint64))
            pool = rng.permutation(pool)
            x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
            (a, ea), (b, eb) = signed(x, bands), signed(y, bands)
            shared = len(np.intersect1d(a, b))
            assert shared >= bands.shared_least(np.array([n]), np.array([m]), np.array([ea]), np.array([eb]))[0] >= 1
            assert shared >= max(bands.shared_by_any(np.array([n]), np.array([ea]))[0], bands.shared_by_any(np.array([m]), np.array([eb]))[0])


@pytest.mark.parametrize("turned", [False, True])
def test_links_of_all_texts_under_one_id(spark, turned):
    """An id with two texts links with the near copies of both, whatever the order of its rows."""
    rng = random.Random(3)
    short, long = ([f"{c}{rng.randrange(10**6)}" for _ in range(n)] for c, n in (("s", 60), ("l", 300)))
    rows = [(1, " ".join(short)), (1, " ".join(long)), (2, " ".join(short + ["x"])), (3, " ".join(["y", *long])), (4, "z z z"), (1, None)]
    df = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(1, 0, 1), (1, 56, 1), (1, 296, 1), (2, 57, 1), (3, 297, 1), (4, 1, 4)]


def test_groups_in_blocks(spark, monkeypatch):
    """Signature groups that are cut into blocks, and hubs that are dealt to several tasks, lose nothing."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "PAIRS", 3)
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    chain, texts = list(base), []
    for _ in range(40):  # neighbours are similar, the ends are not
        chain[rng.randrange(80)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    rows = list(enumerate(rng.sample(texts, len(texts))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect()}
    assert got == jaccard_truth(rows)


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(shared, "ONE_TASK", one_task)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    truth = closure({x for e in edges for x in e}, edges)
    assert got == {i: c for i, c in truth.items() if i in got} and all(truth[i] == i for i in truth if i not in got)


@pytest.mark.parametrize("block", [16, 2048])
def test_embedding_components(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    rows, n = [], 0
    for c in centres:
        for _ in range(12):
            v = c + rng.standard_normal(32) * rng.choice([0.01, 0.2, 0.3, 0.4])
            rows.append((n, [float(x) for x in v], n % 2))
            n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(5)]
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = (v @ v.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    comp = closure(range(len(rows)), np.argwhere(near).tolist())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(df, block=block).collect()}
    assert got == {(i, int(near[i].sum()), comp[i], comp[i] == i) for i in range(len(rows))}


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over symbols by dictionaries, from the definition."""

    def __init__(self, texts):
        self.counts = {quality.ORDER: collections.Counter()}
        for t in texts:
            s = quality.symbols(t).tolist()
            self.counts[quality.ORDER].update(tuple(s[i : i + quality.ORDER]) for i in range(len(s) - quality.ORDER + 1))
        for order in range(quality.ORDER - 1, 0, -1):
            self.counts[order] = collections.Counter(g[1:] for g in self.counts[order + 1])
        self.total, self.lost = collections.Counter(), collections.Counter()
        self.cut = {}
        for order, c in self.counts.items():
            of = collections.Counter(c.values())
            n1, n2, n3, n4 = (of[k] for k in (1, 2, 3, 4))
            d = (0.5, 0.75, 0.9)
            if min(n1, n2, n3, n4):
                y = n1 / (n1 + 2 * n2)
                d = [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            self.cut[order] = d
            for g, n in c.items():
                self.total[g[:-1]] += n
                self.lost[g[:-1]] += d[min(n, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / quality.SYMBOLS
        n, context = self.counts[len(g)][g], g[:-1]
        if not self.total[context]:
            return self.p(g[1:])
        return ((n - self.cut[len(g)][min(n, 3) - 1]) / self.total[context] if n else 0) + self.lost[context] / self.total[context] * self.p(g[1:])

    def nll(self, text):
        s = quality.symbols(text).tolist()
        return -sum(math.log(self.p(tuple(s[i : i + quality.ORDER]))) for i in range(len(s) - quality.ORDER + 1))


def plain_quality(texts, langs, trusted, halves, quantile=0.999):
    """Which texts are good: everything from the definition.  ``halves``: 0 trains, 1 sets limits."""
    model = PlainKneserNey([texts[i] for i in trusted if halves[i] == 0 and texts[i]])
    n = {i: len(quality.symbols(t)) - quality.ORDER + 1 for i, t in texts.items()}
    nll = {i: model.nll(t) for i, t in texts.items()}
    held = [i for i in trusted if halves[i] == 1 and texts[i]]
    middle = {x: np.percentile([round(nll[i] / n[i], 3) for i in held if langs[i] == x], 50) for x in {langs[i] for i in held}}
    mean = lambda i: round((nll[i] + quality.PRIOR * middle[langs[i]]) / (n[i] + quality.PRIOR), 3)
    most = {x: np.percentile([mean(i) for i in held if langs[i] == x], 100 * quantile) for x in middle}
    return {i: math.exp(mean(i)) for i in texts}, {i for i in texts if not n[i] or mean(i) <= most[langs[i]]}


def test_quality_against_a_plain_version(spark):
    rng = random.Random(9)
    vocabulary = {"en": ["the", "river", "runs", "past", "quiet", "houses", "while"], "el": ["το", "ποτάμι", "τρέχει", "δίπλα", "σπίτια"]}
    texts, langs = {}, {}
    for i in range(160):
        langs[i] = rng.choice(["en", "el"])
        t = " ".join(rng.choice(vocabulary[langs[i]]) for _ in range(rng.randint(1, 40)))
        texts[i] = t if i % 8 else "".join(rng.sample(t, len(t)))
    texts |= {160: None, 161: ""}
    langs |= {160: "en", 161: "el"}
    docs = spark.createDataFrame([(i, texts[i], langs[i]) for i in texts], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(120)], "doc_id long, quality int")
    halves = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2L) AS h").collect()}
    perplexity, good = plain_quality(texts, langs, [i for i in range(120) if i % 8], halves)
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(math.isclose(got[i]["perplexity"], perplexity[i], rel_tol=2e-3) for i in texts)  # means are rounded
    assert {i for i in texts if got[i]["good"]} == good and 100 < len(good) < 162


def test_pipeline(spark, tmp_path):
    """Each stage's rows from its predecessor's by a plain version of its decision."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    rng = random.Random(6)
    vocabulary = ["the", "river", "runs", "past", "quiet", "houses", "while", "people", "walk", "under", "trees", "and", "talk", "about", "weather"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "s", "ing"]) for _ in range(n))
    texts = [text(50) for _ in range(150)]
    texts = [f"{t} idiot {text(5)} clown" if i % 10 == 0 else t for i, t in enumerate(texts)]
    texts += [" | ".join(w.upper() + "%%%" for w in text(40).split()) for _ in range(10)]
    texts += [texts[i] for i in range(1, 8)] + [texts[i] + " end" for i in range(11, 18)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not 150 <= i < 160), int(i % 10 == 0 and i < 150)) for i in range(160)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: stages[name](spark, df, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = step("quality", docs)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    halves = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2L) AS h").collect()}
    assert kept == plain_quality(dict(enumerate(texts)), dict.fromkeys(range(len(texts)), "en"), [i for i in range(160) if not 150 <= i < 160], halves)[1]
    assert not kept & set(range(150, 160)) and len(kept) >= 160
    clean = step("toxicity", good)
    scorer = toxicity.Scorer(**toxicity.fit(good, labels))
    left = {r["doc_id"]: r["text"] for r in good.collect() if scorer.score(r["text"]) < 0.7}
    assert {r["doc_id"] for r in clean.collect()} == set(left) == {i for i in kept if i % 10 or i >= 150}
    single = step("near_duplicates", clean)
    want = {i for i, _, c in jaccard_truth(list(left.items())) if i == c}
    assert {r["doc_id"] for r in single.collect()} == want and single.columns == docs.columns
    mixed = step("mix", single)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r["doc_id"]: r["count"] for r in mixing.mix(single).groupBy("doc_id").count().collect()} and set(copies) <= want
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.tokenizer_ranks()), special_tokens={})
    rows = step("tokenize", mixed).collect()
    assert len(rows) == sum(copies.values()) and all(r["ids"] == enc.encode_ordinary(left[r["doc_id"]] or "") for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)


def test_pipeline_on_odd_input(spark, tmp_path):
    """Nulls, empty and long texts, repeated ids and rows, names that operators use themselves; and no rows at all."""
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    long = "alpha beta gamma delta epsilon zeta eta theta " * 4000
    rows = [(1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, "one two three four five six", "a"), (3, None, "a"), (4, "", None), (5, long, "a"), (6, long, "b"), (7, "short", "b"), (7, "a longer text under the same id", "b"), (None, "no id", "a"), (None, "no id", "a"), (8, "größe € 🙂", None)]
    kind = "doc_id long, text string, source string, lang string, n_chars long, place int, nll string, chunk string, _of string"
    made = [(*r, None if i % 2 else "en", 1, i, "x", "y", "z") for i, r in enumerate(rows)]
    for name, part in (("some", made), ("none", [])):
        spark.createDataFrame(part, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    single = stages["near_duplicates"](spark, docs, "")
    assert single.columns == docs.columns
    left = [(1, rows[0][1]), (3, None), (4, ""), (5, long), (7, rows[8][1]), (None, "no id"), (None, "no id"), (8, rows[11][1])]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in single.collect()))) == sorted(map(repr, left))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert out.columns == list(corpus_pipeline.TOKENS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(corpus_pipeline.tokenizer_ranks()), special_tokens={})
    texts = {i: t or "" for i, t in left}
    copies = sorted(str(r["doc_id"]) for r in mixing.mix(single.select("doc_id", "source")).collect())
    got = out.collect()
    assert sorted(str(r["doc_id"]) for r in got) == copies and all(r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) for r in got)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) for r in got)
    docs.withColumn("mix_rate", docs["place"]).write.parquet(str(tmp_path / "clash" / "documents.parquet"))
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, str(tmp_path / "clash"))
