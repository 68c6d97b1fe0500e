"""Suggestions made beforehand against ``auto_suggest``."""

import pytest

from lodestone import IndexConfig, SearchError, TextIndex, auto_suggest
from lodestone.operators.suggestions import save, suggest, suggestion_table

DOCS = [(1, "red ring", "ruby"), (2, "red ring ringed", None), (3, "ring road rounded", "red"), (4, "Rot rose", "rosé rose"), (5, "blue bell", "x"), (6, "red rose", "ruby ring")]


@pytest.fixture(scope="module", params=[False, True])
def index(spark, request):
    made = TextIndex.build(spark.createDataFrame(DOCS, "id int, title string, text string"), IndexConfig(["title", "text"], auto_vacuum=False))
    if request.param:
        made.discard(6)
    return made.cache()


def shown(rows):
    return [(r["suggestion"], r["terms"], pytest.approx(r["score"])) for r in rows.collect()]


@pytest.mark.parametrize("options", [{}, {"fields": ["title"], "boost": {"title": 3}}, {"weights": {"prefix": 0.9}, "bm25": {"k": 2.0, "b": 0.3, "d": 0.1}}])
def test_every_beginning(spark, index, tmp_path, options):
    save(suggestion_table(index, longest=4, k=50, **options), str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    prefixes = sorted({w[:n] for _, a, b in DOCS for w in f"{a} {b or ''}".lower().split() for n in range(1, 5)})
    for prefix in prefixes[:: 1 if not options else 4]:
        assert shown(suggest(index, table, prefix, longest=4, **options)) == shown(auto_suggest(index, prefix, **options))
    assert sorted(r["prefix"] for r in table.select("prefix").distinct().collect()) == prefixes or index.dirt_count or options


def test_other_queries_are_searched(index):
    table = suggestion_table(index, longest=2, k=2)
    assert shown(suggest(index, table, "red ri", longest=2)) == shown(auto_suggest(index, "red ri"))
    assert shown(suggest(index, table, "rin", longest=2)) == shown(auto_suggest(index, "rin"))
    assert shown(suggest(index, table, "R", longest=2, limit=1)) == shown(auto_suggest(index, "r", limit=1))
    assert suggest(index, table, "zz", longest=2).collect() == []
    with pytest.raises(SearchError):
        suggestion_table(index, fuzzy=1)
