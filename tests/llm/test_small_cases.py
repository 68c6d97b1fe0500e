"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, operator by operator."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, embedding_dedup, jaccard_join, license_scan, mixing, quality, sharding, simhash, toxicity, url_filter

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, label string, id string"


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "en" if n % 2 else None, None if n % 3 == 0 else f"s{n % 3}", None, "x", "y", "z", "w") for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOCS).repartition(3)


TEXTS = [None, "", " ", "one two", "one two", "The quick brown fox jumps over the lazy dog", LONG, LONG, "äöü ß €\n\t x", None]


def test_sharding(spark):
    docs = docs_of(spark, TEXTS, [5, 5, 3, None, 1, 0, 7, 8, 9, 2])
    rows = sharding.shard_rows(docs, n_shards=4, seed=3).collect()
    assert len(rows) == 10
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = next((t for t, i in zip(TEXTS, [5, 5, 3, None, 1, 0, 7, 8, 9, 2]) if i == r["doc_id"] and len((t or "").encode()) + 16 == r["size"]), None)
        assert r["text_crc32"] == zlib.crc32((text or "").encode())
        assert sharding.permute_number(r["row_number"], 10, 3) == r["position"] == r["slot"] * 4 + r["shard"]
    assert sorted(len(v) for v in by.values()) == [2, 2, 3, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shard_rows(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, n_shards=0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_a_bijection(n):
    assert sorted(sharding.permute_number(x, n, 9) for x in range(n)) == list(range(n))


def test_written_shards_keep_every_row(spark, tmp_path):
    docs = docs_of(spark, TEXTS, [5, 5, 3, None, 1, 0, 7, 8, 9, 2])
    sharding.write_shards(docs, str(tmp_path / "out"), n_shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert sorted(r["count"] for r in back.groupBy("shard_number").count().collect()) == [3, 3, 4]
    odd = docs.select(F.col("doc_id").alias("slot"), F.col("text").alias("k"), "size", F.col("lang").alias("_shard"))
    assert sharding.shard_rows(odd, "slot", "k", 3).columns == ["slot_", *sharding.COLUMNS]
    sharding.write_shards(odd, str(tmp_path / "odd"), "slot", "k", 3)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "odd")).select(odd.columns).collect())) == sorted(map(str, odd.collect()))
    with pytest.raises(ValueError):
        sharding.write_shards(odd, str(tmp_path / "no"), "slot", "k", 3, shard="_SHARD")


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "a" if i < 900 else ("b" if i < 990 else None), None) for i in range(1000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, weights={"a": 1, "b": 2})
    got = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    assert abs(got["a"] - 250) < 60 and abs(got["b"] - 500) < 80 and abs(got[None] - 250) < 60
    assert sorted(map(str, rows.collect())) == sorted(map(str, mixing.mix(docs.repartition(7), weights={"a": 1, "b": 2}).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={"a": 0}).where("source = 'a'").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("mix_copy", F.lit(1)))


def test_mixing_a_rare_source(spark):
    """One row of 200,000 has a source of its own: as many copies as the others together, and a plan of the same size."""
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("big").alias("source"), F.lit(None).cast("string").alias("text"))
    rows = mixing.mix(docs)
    got = {r["source"]: (r["n"], r["m"], r["k"]) for r in rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "mix_copy").alias("m"), F.max("mix_copy").alias("k")).collect()}
    assert all(abs(n - 100_000) < 2000 and n == m for n, m, _ in got.values()) and got["rare"][2] == got["rare"][0] - 1
    assert len(rows._jdf.queryExecution().optimizedPlan().toString()) < 40_000


def test_mixing_very_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(1, "a", "x" * 2_000_000), (1, "a", "x" * 2_000_000), (None, None, ""), (None, "b", None)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, total=40).collect()
    n = {s: sorted(sum(1 for r in rows if r["source"] == s and r["mix_copy"] == k) for k in {r["mix_copy"] for r in rows if r["source"] == s}) for s in ("a", "b", None)}
    assert set(n["a"]) == {2} and set(n["b"]) == {1} == set(n[None]) and all(len(r["text"]) == 2_000_000 for r in rows if r["source"] == "a")


def test_poisson_inverse_against_the_distribution(spark):
    import math

    rows = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u")).withColumn("k", mixing.poisson_inverse(F.col("u"), F.lit(2.5))).collect()
    for r in rows:
        k, cdf, p = 0, math.exp(-2.5), math.exp(-2.5)
        while cdf < r["u"]:
            k += 1
            p *= 2.5 / k
            cdf += p
        assert r["k"] == k


def test_jaccard(spark):
    docs = docs_of(spark, TEXTS, [5, 6, 3, None, 1, 0, 7, 8, 9, 2])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {(5, 0, 5), (6, 0, 6), (3, 0, 3), (None, 1, None), (1, 1, 1), (0, 5, 0), (7, 10, 7), (8, 10, 7), (9, 1, 9), (2, 0, 2)}
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [0.94, 0.341], 1), (11, [0.76, 0.65], 1), (12, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (13, [], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, v string, n string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 10: (3, 1, False), 11: (1, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12, 13)}, None: (0, None, None)}
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0


def test_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    data = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(data), special_tokens={})
    docs = docs_of(spark, TEXTS)
    rows = byte_bpe.encode(docs, data, P.PATTERN).collect()
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["n_words"] == "x"
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    ids = byte_bpe.encode(docs.select("doc_id", "text"), data, P.PATTERN, output="ids").drop("decoded")
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode(ids, data, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe.encode(docs.limit(0), data, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.withColumn("n_tokens", F.lit(1)), data, P.PATTERN)


def test_bpe_trees_agree_with_the_library(monkeypatch):
    import random

    import public_tokenizers as P
    import tiktoken

    ranks = byte_bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", 8)
    bpe, rng = byte_bpe.TreeBpe(ranks, P.PATTERN), random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aaabeéñ  thing\n\t0189!?#ß中🙂's") for _ in range(rng.randint(0, 120)))
        want = enc.encode_ordinary(text)
        assert bpe.encode(text).tolist() == want and bpe.encode_pieces(text) == want
        assert bpe.decode(bpe.encode(text)) == text.encode()
    for text in ("x" * 3001, "aé" * 2000, "thin" * 900, " " * 500, "ab\n" * 700):
        assert bpe.encode(text).tolist() == enc.encode_ordinary(text) == bpe.encode_pieces(text)


def test_simhash(spark):
    docs = docs_of(spark, TEXTS, [5, 6, 3, None, 1, 0, 7, 8, 9, 2])
    rows = {r["doc_id"]: r for r in simhash.fingerprint_edits(docs).collect()}
    order = sorted(zip([5, 6, 3, None, 1, 0, 7, 8, 9, 2], TEXTS), key=lambda x: (x[0] is not None, x[0]))
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u, r = t or "", u or "", rows[i]
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert rows[7]["fingerprint"] == rows[8]["fingerprint"] and rows[7]["near_next"] == 1
    assert simhash.fingerprint_edits(docs.limit(0)).count() == 0
    assert simhash.fingerprint_edits(docs.where("doc_id = 0")).collect()[0]["near_next"] == 1
    assert simhash.fingerprints(docs).count() == 10


def test_near_fingerprints_against_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = base + [x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 6))) for x in base for _ in range(3)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in prints] + [(None,)], "fingerprint string")
    names = sorted({f"{x:032x}" for x in prints})
    far = {(a, b): (int(a, 16) ^ int(b, 16)).bit_count() for a in names for b in names if a != b}
    for tile in (2048, 2):
        monkeypatch.setattr(simhash, "TILE", tile)
        for radius in (0, 3, 4, 9):
            got = sorted((r["a"], r["b"], r["distance"]) for r in simhash.near_fingerprints(df, radius, pairs=True).collect())
            assert got == sorted((a, b, d) for (a, b), d in far.items() if a < b and d <= radius) and (got or not radius)
            counts = {r["fingerprint"]: r["n_near"] for r in simhash.near_fingerprints(df, radius).collect()}
            assert counts == {a: n for a in names if (n := sum(far[a, b] <= radius for b in names if b != a))}
    assert simhash.near_fingerprints(df.limit(0), 3).count() == 0


def test_fingerprints_against_a_plain_version():
    import math
    import random

    import xxhash

    rng = random.Random(3)
    hashes = simhash.WordHashes()
    mask = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & mask
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def plain(text):
        words = [w for w in text.encode().lower().split()]
        weights = {}
        for w in set(words):
            weights[xxhash.xxh3_64_intdigest(w)] = (1 + math.log(words.count(w))) * min(len(w), 8)
        joined = b" ".join(words)
        terms = list(weights.items())
        if 0 < len(words) < 64:
            terms += [(mix(xxhash.xxh3_64_intdigest(g)), 4 * (1 - len(words) / 64)) for g in {joined[i : i + 4] for i in range(max(1, len(joined) - 3))}]
        votes = [0.0] * 128
        for h, w in terms:
            for word, x in enumerate((mix(h), mix(h ^ 0xA5A5A5A5A5A5A5A5))):
                for byte in range(8):
                    for bit in range(8):
                        votes[64 * word + 8 * byte + bit] += w if x >> (8 * byte + 7 - bit) & 1 else -w
        return votes

    for n in (0, 1, 3, 40, 63, 64, 200):
        text = " ".join(f"{'Wort' if rng.random() < 0.2 else 'w'}{rng.randrange(90)}ü" for _ in range(n))
        got = int.from_bytes(simhash.fingerprint(text, hashes), "big")
        for i, v in enumerate(plain(text)):
            assert abs(v) < 1e-3 or (got >> (127 - i) & 1) == (v > 0)


def test_license_scan(spark):
    texts = [None, "", "Released under the MIT License.", "under the mit-license CC BY NC cc_by_nc", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0", "GNU General Public License, version 3", "nothing here at all É", LONG]
    rows = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert [(rows[i]["n_words"], rows[i]["n_base"], rows[i]["first_word"], rows[i]["last_word"], rows[i]["base_labels"]) for i in range(8)] == [
        (0, 0, None, None, ""), (0, 0, None, None, ""), (5, 1, 1, 1, "mit"), (10, 3, 0, 7, "cc-by-nc,mit"), (15, 2, 3, 10, "apache-2,cc-by-nc"), (6, 0, None, None, ""), (5, 0, None, None, ""), (30000, 0, None, None, "")]
    assert rows[5]["labels"] == "gpl-3" and 0 < rows[5]["score"] < 1 and rows[6]["labels"] == "" and rows[6]["score"] == 0
    assert rows[4]["labels"] == "apache-2,cc-by-nc" and rows[4]["score"] == 1
    assert license_scan.scan(docs_of(spark, texts).limit(0)).count() == 0


def test_license_spans_lie_on_the_matches(spark):
    text = "x licensed under the GNU Lesser General Public License v2.1 or the Mozilla Public License 2.0 y"
    r = license_scan.scan(docs_of(spark, [text])).collect()[0]
    s = " " + " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split()) + " "
    assert {x["label"] for x in r["spans"]} == {"lgpl-2.1", "mpl-2"} == set(r["labels"].split(","))
    assert any(s[x["start"] - 1 : x["end"]].strip().startswith("licensed under the gnu lesser") for x in r["spans"])
    assert len(license_scan.rules()) > 200


def test_license_gates_lose_no_match(spark):
    texts = ["Released under GPLv3", "available under Apache 2.0", "distributed under the BSD 3-Clause", "provided under MIT", "https://scripts.sil.org/OFL", "mariadb.com/bsl11", "joinup.ec.europa.eu/page/eupl", "licensed under the Expat license"]
    for _, _, regex, _, _ in license_scan.rules():
        for a in license_scan.alternatives(regex.replace("[0-9]{2}", "99").replace("[a-z]+", "xyz")):
            text = " ".join(a.replace(license_scan.BREAK, "").split())
            if re.search(regex, f" {text} "):
                texts.append(text.replace(" ", "-\n").upper())
    assert len(texts) > 1900
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    gated, every = ({r["doc_id"]: r["labels"] for r in license_scan.scan(docs, gated=g).select("doc_id", "labels").collect()} for g in (True, False))
    assert {i: t for i, t in enumerate(texts) if gated[i] != every[i]} == {} and all(gated.values())
    assert max(re._parser.parse(regex).getwidth()[1] for _, _, regex, _, _ in license_scan.rules()) <= license_scan.MARGIN


def test_license_scan_against_a_plain_version(spark):
    """Every rule over the whole text by ``re``, base places by words; texts of many windows among them."""
    import random

    rng = random.Random(11)
    rules = license_scan.rules()
    phrases = [" ".join(a.replace(license_scan.BREAK, "").split()) for _, _, r, _, _ in rules for a in license_scan.alternatives(r)[:2]] + list(license_scan.BASE)
    filler = ["lorem", "Ipsum", "7", "größe", "under the", "license", "v2", "permission", "—"]
    texts = [None, "", "MIT"]
    for n in (3, 5, 8, 8, 8, 12, 20, 40, 400, 1500):
        texts.append("".join((rng.choice(phrases) if rng.random() < 0.3 else rng.choice(filler)) + rng.choice([" ", "-", "\n", ", "]) for _ in range(n)))
    texts += ["Released under the MIT License. " * 700, "x" * 4090 + " licensed under the GNU Lesser General Public License v2.1 " + "y" * 9000 + " cc by nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in license_scan.scan(docs).collect():
        words = [w for w in re.split(license_scan.NOT_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")) if w]
        s = f" {' '.join(words)} "
        places = sorted((i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        spans = [(m.start() + 1, m.end(), label, priority, sure) for label, _, regex, priority, sure in rules for m in re.finditer(regex, s)]
        kept = {x for x in spans if not any(y[0] <= x[0] and y[1] >= x[1] and (y[3] > x[3] or (y[3] == x[3] and y[1] - y[0] > x[1] - x[0])) for y in spans if y[0] <= x[0] <= y[1])}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert {tuple(x) for x in r["spans"]} == kept
        assert r["labels"] == ",".join(sorted({x for _, x in places} | {x[2] for x in kept})) and r["score"] == (1.0 if places else max((x[4] for x in kept), default=0.0))


def test_license_texts_of_every_kind_are_found(spark):
    texts = {"Released under MIT.": "mit", "Distributed under GPL v3 only": "gpl-3", "released under Expat license": "mit", "offered under Creative Commons Attribution ShareAlike 4.0": "cc-by-sa", "see mariadb.com/bsl11": "busl", "scripts.sil.org/OFL": "ofl", "gnu.org/licenses/fdl": "gfdl", "opensource.org/licenses/cpl": "cpl", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "All advertising materials mentioning features or use of this software": "bsd-4", "huggingface.co/spaces/bigscience/license": "openrail"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = list(texts.values())
    assert all(want[r["doc_id"]] in r["labels"].split(",") for r in license_scan.scan(docs).collect())


def test_toxicity(spark):
    bad = ["you are a total idiot and a clown today", "what an idiot that clown is", "such an idiot clown person", "idiot clown again here"]
    texts = [f"{bad[i % 4]} number {'abcdefghij'[i % 10]} {i}" if i % 5 == 0 else f"a calm text about gardens {i} and walks {'klmnopqrst'[i % 10]}" for i in range(200)]
    docs = docs_of(spark, [*texts, None, "", "my 1d10t", "see i d i o t indeed"], list(range(204)))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(rows[i]["predicted"] == (i % 5 == 0) for i in range(200))
    assert rows[3]["held_out"] == (zlib.crc32(b"3") % 3 == 1)
    assert rows[200]["score"] == rows[201]["score"] < 0.5 and rows[202]["terms"] == ["idiot"] == rows[203]["terms"]
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs.limit(3), labels.limit(0)).where("score > 0.5").count() == 0


def test_viterbi_against_all_paths():
    """The restored word is a path of least cost, among all paths of the lattice."""
    import collections
    import itertools
    import random

    rng = random.Random(5)
    plain = "you are such a nice person and all the others like a good book or a long letter in the sun " * 20
    model = toxicity.CharModel(collections.Counter(plain[i : i + 3] for i in range(len(plain) - 2)), ["idiot", "moron"])

    def cost(letters):
        context, total = "^ ", 0.0
        for c in letters + " ":
            total += model.cost(context, c)
            context = context[1] + c
        return total

    for _ in range(300):
        word = "".join(rng.choice("aoit1i0!*$3s+") for _ in range(rng.randint(1, 6)))
        paths = collections.defaultdict(lambda: float("inf"))
        for path in itertools.product(*toxicity.lattice(word)):
            spelled = "".join(x for x, _ in path)
            paths[spelled] = min(paths[spelled], cost(spelled) + sum(c for _, c in path))
        assert abs(paths[toxicity.restore(word, model)] - min(paths.values())) < 1e-9


def test_toxicity_against_a_plain_version(spark):
    """Weights, intercept and scores from counters over the labelled texts, on texts without disguises."""
    import collections
    import math
    import random

    rng = random.Random(8)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(6, 30)) + (["vile"] if i % 4 == 0 else []) + (["rude"] if i % 6 == 0 else [])) + f" {i}x" for i in range(300)}
    labels = {i: int(i % 4 == 0) for i in range(240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    train = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    count = {y: collections.Counter(w for i in train if labels[i] == y for w in set(texts[i].split())) for y in (0, 1)}
    n = {y: sum(labels[i] == y for i in train) for y in (0, 1)}
    weights = {w: math.log((a + 0.5) / (n[1] + 1)) - math.log((count[0][w] + toxicity.UNSEEN) / (n[0] + 1)) for w, a in count[1].items() if a >= max(3, math.ceil(toxicity.LEAST_SHARE * n[1]))}
    weights = {w: x for w, x in weights.items() if x >= toxicity.LEAST_RATIO}
    assert set(weights) == {"vile"}
    for i, r in rows.items():
        z = min(0.0, math.log((n[1] + 0.5) / (n[0] + 0.5))) + sum(x for w, x in weights.items() if w in texts[i].split())
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z))) and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_disguised_words_are_decoded():
    import collections

    plain = "you are such a nice person and all the others like a good book or a long letter in the sun " * 50
    trigrams = collections.Counter(plain[i : i + 3] for i in range(len(plain) - 2))
    scorer = toxicity.Scorer({w: 3.0 for w in ("idiot", "moron", "loser", "asshole", "sod")}, -1.0, trigrams)
    for text, word in [("id" + "i" * 80 + "ot", "idiot"), ("idiiot", "idiot"), ("mooron", "moron"), ("l o $ e r", "loser"), ("@ $ $ h o l e", "asshole"), ("l  o  s  e  r", "loser"), ("s o d", "sod"), ("y o u 1 d 1 o t", "idiot")]:
        assert scorer.found(text) == {word}, text
    assert scorer.found("a good book, a letter and all 1 2 3 4 5") == set()
    assert scorer.found("ab" * 5000 + "1") == set()


def test_quality(spark):
    import random

    rng = random.Random(1)
    vocabulary = ["the", "river", "runs", "past", "quiet", "houses", "while", "people", "walk", "under", "trees", "and", "talk", "about", "weather"]
    good = [" ".join(rng.choice(vocabulary) for _ in range(60)).capitalize() + "." for _ in range(120)]
    bad = [" | ".join(w.upper() + "%%%" for w in g.split()) for g in good[:10]]
    docs = docs_of(spark, [*good, *bad, None, ""], list(range(132)))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(130)] + [(None, 1)], "doc_id long, quality int")
    fitted = quality.fit(docs, labels)
    rows = {r["doc_id"]: r for r in quality.score(docs, fitted).collect()}
    assert sum(rows[i]["good"] for i in range(120)) >= 117 and not any(rows[i]["good"] for i in range(120, 130))
    assert rows[130]["good"] and rows[131]["good"]
    kept = quality.keep_good(docs, fitted)
    assert kept.columns == docs.columns and kept.count() == sum(r["good"] for r in rows.values())
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.keep_good(docs, nothing).count() == 132
    assert quality.score(docs.limit(0), fitted).count() == 0


def test_quality_keeps_scripts_apart_and_reads_whole_texts(spark):
    """A shuffled Cyrillic text is rejected by its own script's n-grams; long, repeated and clashing rows are scored alike."""
    import random

    rng = random.Random(2)
    words = ["река", "течёт", "мимо", "тихих", "домов", "пока", "люди", "гуляют", "под", "деревьями", "и", "говорят", "о", "погоде"]
    good = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(200)]
    shuffled = ["".join(rng.sample(g, len(g))) for g in good[:10]]
    long = " ".join(good)
    texts = [*good, *shuffled, long, long, good[0], None, "😀 \U0001F680" * 30]
    docs = spark.createDataFrame([(i, t, "ru", 1.0, "c", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, nll double, chunk string, good boolean").repartition(3)
    fitted = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int"))
    rows = {r["doc_id"]: r for r in quality.score(docs, fitted).collect()}
    assert sum(rows[i]["good"] for i in range(200)) >= 195 and not any(rows[i]["good"] for i in range(200, 210))
    assert rows[210] == rows[211].__class__(**{**rows[211].asDict(), "doc_id": 210}) and rows[212]["perplexity"] == rows[0]["perplexity"]
    assert rows[213]["good"] and not rows[214]["good"]
    kept = quality.keep_good(docs, fitted)
    assert kept.schema == docs.schema and kept.count() == sum(r["good"] for r in rows.values())


def test_chunks_change_nothing(spark, monkeypatch):
    texts = [(i, f"The cat number {i} sat on mat {i % 7}. " * (1 + i % 5), "en") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(2)
    fitted = quality.fit(docs, spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int"))
    once = sorted(quality.score(docs, fitted).collect())
    monkeypatch.setattr(quality, "CHUNK_BYTES", 500)
    assert sorted(quality.score(docs.repartition(5), fitted).collect()) == once


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Cheappills.NET/En/1?x#y", "https://a.example.org/es/1", "https://example.org/en/12", "http://x.org", "http://x.org/", "http://a.com/fr/x", "http://a.com/de/", "http://a.com/de", "https://spam-farm.example.net/fr/3", "http://quietgarden.example.net/a", "http://free-bets.example.org/en/9"]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(1, None, None, None)], "page_id long, url string, html string, host string")
    rows = sorted(url_filter.judge(pages).collect(), key=lambda r: (r["page_id"], str(r["host"])))
    by = {r["page_id"]: r for r in rows if not (r["page_id"] == 1)}
    assert [(by[i]["host"], by[i]["path"]) for i in (0, 2, 3, 4)] == [("", ""), ("", ""), ("", ""), ("www.cheappills.net", "/En/1")]
    assert [(by[i]["rule"], by[i]["verdict"]) for i in (5, 6, 7, 8, 9, 10, 14)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]
    assert by[11]["rule"] is None and by[11]["verdict"] == ("block" if by[11]["score"] >= 0.5 else "allow")
    assert by[4]["verdict"] == "block" and by[4]["host_words"] == "www cheap pills"
    assert by[12]["verdict"] == "block" and by[13]["verdict"] == "allow" and by[0]["verdict"] == "allow"
    assert len(rows) == 16 and url_filter.judge(pages.limit(0)).count() == 0


def test_all_url_words_count(spark):
    letters = "bcdfghjklmnpqrstvwz"
    words = [a + b + c + d + e for a in letters[:2] for b in letters for c in letters for d in letters for e in letters][:210_000]
    urls = [f"http://site.com/{'de' if i % 10 == 9 else 'fr'}/" + "/".join(words[i * 1000 : (i + 1) * 1000]) for i in range(210)]
    model = url_filter.fit(spark.createDataFrame([(u,) for u in urls], "url string").repartition(4))
    ratio = {r["word"]: r["ratio"] for r in model["ratio"].collect()}
    of = [["p:" + w for u in urls if ("/de/" in u) == block for w in u.split("/")[4:]] for block in (False, True)]
    assert all(w in ratio for part in of for w in part)
    assert min(ratio[w] for w in of[1]) > model["unseen"] > max(ratio[w] for w in of[0])


def test_url_verdicts_against_a_plain_version(spark):
    """Naive Bayes of the ruled URLs by counters, on the same segmenter; and every segmentation against all splits."""
    import collections
    import math
    import random

    rng = random.Random(4)
    hosts = ["quietgarden", "cheap-pills", "newsriver", "casinoroyal", "zzqx"]
    urls = [f"https://{rng.choice(['www.', ''])}{rng.choice(hosts)}.{rng.choice(['com', 'net', 'example.org'])}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.randrange(3)}{rng.choice(['', '/gardennews', '/slots?x#y'])}" for _ in range(300)] + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    model = url_filter.fit(pages)
    segmenter = url_filter.Segmenter({r["word"]: r["n"] for r in model["vocabulary"].collect()})
    n = {0: collections.Counter(), 1: collections.Counter()}
    docs = collections.Counter()
    for kind, of in ((1, url_filter.BLOCK_WORDS), (0, url_filter.PLAIN_WORDS)):
        for w in of:
            n[kind]["h:" + w] += url_filter.KNOWN * len(url_filter.BLOCK_WORDS) / len(of)
    for u in urls:
        if v := url_filter.ruled(*url_filter.host_and_path(u))[1]:
            docs[v == "block"] += 1
            n[v == "block"].update(url_filter.features(u, segmenter))
    size = len(set(n[0]) | set(n[1]))
    total = {k: math.fsum(n[k].values()) + url_filter.SMOOTH * (size + 1) for k in n}
    for r in url_filter.judge(pages).collect():
        u = urls[r["page_id"]]
        words = url_filter.features(u, segmenter)
        z = math.log((docs[1] + 1) / (docs[0] + 1)) + sum(math.log((n[1][w] + url_filter.SMOOTH) / total[1]) - math.log((n[0][w] + url_filter.SMOOTH) / total[0]) for w in words) if words else -20.0
        rule, verdict = url_filter.ruled(*url_filter.host_and_path(u))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-6 and r["rule"] == rule and r["verdict"] == (verdict or ("block" if z >= 0 else "allow"))


def test_segmentation_against_all_splits():
    import itertools
    import math

    words = {"a": 5, "ab": 9, "abc": 2, "ca": 4, "bca": 7, "cab": 3, "longerword": 1}
    s = url_filter.Segmenter(words)

    def cost(parts):  # neighbouring unknown parts are one run
        known = lambda p: -math.log(words[p] / s.total)
        return sum(known(p) if p in words else math.log(s.total) + url_filter.UNKNOWN * len(p) for p in parts)

    for name in ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)][::7] + ["longerwordab"]:
        splits = [[name[i:j] for i, j in itertools.pairwise((0, *cut, len(name)))] for k in range(len(name)) for cut in itertools.combinations(range(1, len(name)), k)] if len(name) < 9 else [[name], ["longerword", "ab"], ["longerword", "a", "b"]]
        assert math.isclose(cost(s.split(name)), min(map(cost, splits)))
    assert "".join(s.split("xyz" * 20_000)) == "xyz" * 20_000


def test_keys_that_are_no_numbers(spark):
    texts = ["one two three four five six seven"] * 2 + ["other words stand here in this very text", None, "", "one two three four five six seven"]
    names = ["b", "a", "c", "d", None, "e"]
    by_number = docs_of(spark, texts, [2, 1, 3, 4, None, 5])
    back = dict(zip([2, 1, 3, 4, None, 5], names, strict=True))
    by_name = by_number.withColumn("doc_id", F.element_at(F.create_map(*[F.lit(x) for k, v in back.items() if k for x in (k, v)]), F.col("doc_id")))
    told = lambda rows, keys: sorted(repr(tuple(back[v] if c in keys else v for c, v in r.asDict().items())) for r in rows.collect())
    for run in (lambda d: jaccard_join.jaccard_components(d), lambda d: simhash.fingerprint_edits(d)):
        plain, named = run(by_number), run(by_name)
        assert named.schema["doc_id"].dataType.simpleString() == "string" and named.columns == plain.columns
        assert told(named, ()) == told(plain, ("doc_id", "component_id"))
    vectors = spark.createDataFrame([("x", "l", [1.0, 0.0]), ("w", "l", [1.0, 0.01]), ("v", "l", [0.0, 1.0]), (None, "l", [0.0, 1.0])], "vec_id string, label string, embedding array<double>")
    rows = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_components(vectors).collect()}
    assert rows["x"] == (1, "w", False) and rows["w"] == (1, "w", True) and rows["v"][1] == "v"
    labels = by_name.select("doc_id", F.lit(1).alias("toxic")).limit(3)
    scored = toxicity.toxicity(by_name, labels).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == sorted(map(str, names))


def test_decoding_refuses_a_clash(spark):
    with pytest.raises(ValueError):
        byte_bpe.decode(spark.createDataFrame([([1], "x")], "ids array<int>, Decoded string"), b"", "x")


def test_rare_words_are_words_among_many_pages_too(spark):
    """A name that stands once splits names alike among 10 pages and among a hundred thousand."""
    few = [f"http://www.site{i}.net/page" for i in range(9)] + ["http://zorblax.net/", "http://zorblaxcasino.net/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(few)], "page_id long, url string")
    many = pages.unionByName(spark.range(100_000).selectExpr("id + 100 AS page_id", "concat('http://ordinary.net/news/', id % 7) AS url"))
    told = [{r["page_id"]: r["host_words"] for r in url_filter.judge(p).where("page_id < 100").collect()} for p in (pages, many)]
    assert told[0] == told[1] and told[0][10] == "zorblax casino"


def test_decoding_up_the_tree(monkeypatch):
    import numpy as np
    import public_tokenizers

    from lodestone.llm.queries import tokenizer_ranks

    bpe = byte_bpe.TreeBpe(byte_bpe.read_ranks(tokenizer_ranks()), public_tokenizers.PATTERN)
    text = LONG[:5000] + "äöü ß €\n" * 50
    ids = bpe.encode(text)
    for leaf in (1, 3, 256):
        monkeypatch.setattr(byte_bpe, "LEAF_IDS", leaf)
        assert bpe.decode(ids) == text.encode() and bpe.decode(np.array([], np.int64)) == b""
