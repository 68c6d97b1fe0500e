"""The first search after discards against a plain model that takes stale occurrences out as it goes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex, search, tree
from lodestone.operators import search as searching
from lodestone.operators.search import contributions
from lodestone.plans.query import Resolver, leaves


def expand(leaf, term):
    """Weight of an exact or prefix match."""
    if term == leaf.term:
        return 1.0
    return 0.375 * len(term) / (len(term) + 0.3 * (len(term) - len(leaf.term))) if leaf.prefix and term.startswith(leaf.term) else None


def plain(docs, gone, query, options, fields=("a", "b")):
    """Scores by document of an OR query."""
    postings, lens = {}, {}
    for i, d in enumerate(docs):
        for f in fields:
            if d[f] is not None:
                words = d[f].split()
                lens[i, f] = len(set(words))
                for w in words:
                    postings.setdefault(w, {}).setdefault(f, {}).setdefault(i, 0)
                    postings[w][f][i] += 1
    index = TextIndexMeans(docs, gone, fields)
    config = IndexConfig(list(fields))
    scores, matched = {}, {}
    for leaf in leaves(Resolver(config.fields, config.analyzer, config.search_options).resolve(query, options)):
        for term in sorted(postings):
            if (weight := expand(leaf, term)) is None:
                continue
            for f, boost in leaf.fields:
                held = postings[term].get(f)
                if held is None:
                    continue
                m = len(held)
                for i in sorted(held):
                    if docs[i]["id"] in gone:
                        held[i] -= 1
                        if not held[i]:
                            del held[i]
                        m -= 1
                        continue
                    rarity = math.log(1 + (index.n - m + 0.5) / (m + 0.5))
                    w = weight * boost * rarity * (0.5 + held[i] * 2.2 / (held[i] + 1.2 * (0.3 + 0.7 * lens[i, f] / index.means[f])))
                    scores[docs[i]["id"]] = scores.get(docs[i]["id"], 0) + w
                    matched.setdefault(docs[i]["id"], set()).add(leaf.term)
    return {i: s * len(matched[i]) for i, s in scores.items()}


class TextIndexMeans:
    def __init__(self, docs, gone, fields):
        self.means, self.n = {}, len(docs) - len(gone)
        for f in fields:
            n, mean = 0, 0.0
            for d in docs:
                n += 1
                mean = (mean * (n - 1) + len(set(d[f].split()))) / n if d[f] is not None else mean
            for i in gone:
                d = next(d for d in docs if d["id"] == i)
                mean = (mean * n - len(set(d[f].split()))) / (n - 1) if d[f] is not None else mean
                n -= 1
            self.means[f] = mean


@pytest.mark.parametrize("query, options", [("ab", {}), ("ab abc a", {"prefix": True}), ("a ab ab", {"prefix": True}), ("a b c", {"prefix": True, "fields": ["b"], "boost": {"b": 2}}), (tree("ab", tree("a", fields=["a"]), "abc"), {"prefix": True})])
@pytest.mark.parametrize("block", [1 << 16, 4])
def test_snapshot_equals_taking_occurrences_out(spark, monkeypatch, query, options, block):
    monkeypatch.setattr(searching, "STALE_BLOCK", block)
    r = random.Random(2)
    words = ["a", "ab", "abc", "b", "c"]
    text = lambda: " ".join(r.choices(words, k=r.randrange(1, 7))) if r.random() < 0.9 else None
    docs = [{"id": i, "a": text(), "b": text()} for i in range(40)]
    gone = [i for i in range(40) if i % 4 == 1]
    index = TextIndex.build(spark.createDataFrame(docs, "id int, a string, b string"), IndexConfig(["a", "b"], auto_vacuum=False))
    index.discard_all(gone)
    got = {x["id"]: x["score"] for x in search(index, query, details=False, sort=False, df_mode="snapshot", **options).collect()}
    want = plain(docs, gone, query, options)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in got)


def test_no_window_holds_a_whole_term(spark):
    docs = spark.range(30).select("id", F.lit("a b").alias("a"))
    index = TextIndex.build(docs, IndexConfig(["a"], auto_vacuum=False))
    index.discard_all([3])
    found = leaves(Resolver(["a"], index.config.analyzer, index.config.search_options).resolve("a", {}))
    plan = contributions(index, found, "snapshot")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "doc_ord" in line]
    assert windows and all("block" in line for line in windows)
