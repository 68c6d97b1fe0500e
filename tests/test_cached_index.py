"""A cached index: texts counted by lines, what was written read in place, and few terms counted alone."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from lodestone import IndexConfig, TextIndex, search
from lodestone.functions import analysis
from lodestone.functions.analysis import Analyzer

ODD = [
    "The the THE, a\tb", "", None, ",,", "\n", "\r\n x \r", "a b c　d", "ΑΣ ΑΣ.ΒΣ Σ ΑΣ\nΒ ΑΣ+Β", "İI ıi İI", "Straße STRASSE ǅ ǆ",
    "é É é É", "x\\ny $1 \\1 x", "\x00 \x0b \x0c \x1f \x85 a", "\U00010400\U00010428 𝔘 ß", "-a-", "…«q»…Q", "word " * 50, "؝a⹝b",
]


def rows(index):
    counted = index.postings.join(index.docs, "doc_ord").select("id", "field_id", "term", "tf", "len").collect()
    return sorted(map(tuple, counted)), sorted(map(tuple, index.lengths.collect())), index.means


@pytest.mark.parametrize("stretch", [1, 1 << 20])
def test_lines_count_as_the_columns_do(spark, monkeypatch, stretch):
    monkeypatch.setattr(analysis, "STRETCH", stretch)
    docs = spark.createDataFrame([(i, t, ODD[-i]) for i, t in enumerate(ODD)], "id long, text string, title string")
    same = Analyzer(tokenize_column=lambda value, name: analysis.tokenize_column(value), process_column=lambda term, name: analysis.process_column(term))
    assert Analyzer().plain and not same.plain
    by_lines, by_columns = (TextIndex.build(docs, IndexConfig(["text", "title"], analyzer=a)) for a in (Analyzer(), same))
    assert rows(by_lines) == rows(by_columns)
    plain = docs.select("id", F.posexplode(F.array("text", "title")).alias("field_id", "t")).select("id", "field_id", F.explode(F.transform(F.split("t", analysis.SEPARATORS, -1), F.lower)).alias("term"))
    want = plain.where("term <> ''").groupBy("id", "field_id", "term").count().collect()
    assert sorted(r[:4] for r in rows(by_lines)[0]) == sorted(map(tuple, want))


def test_exact_searches_keep_no_copy_and_count_their_terms_alone(spark):
    docs = spark.createDataFrame([(i, f"the {'of' if i % 2 else 'and'} w{i % 5}") for i in range(40)], "id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text"])).cache()
    first = search(index, "the of", details=False, limit=7).collect()
    assert not index.postings.storageLevel.useMemory and not index.docs.storageLevel.useMemory and index._terms is None
    assert sorted(map(tuple, index.terms_of(["of", "w3", "absent"]).collect())) == [("of", 0, 20), ("w3", 0, 8)]
    search(index, "w", prefix=True, details=False).collect()
    assert index._terms.storageLevel.useMemory  # asked for as a whole, so kept and used
    assert search(index, "the of", details=False, limit=7).collect() == first and [r["id"] for r in first] == [1, 3, 5, 7, 9, 11, 13]
    index.add_all(spark.createDataFrame([(100, "of of w3")], "id long, text string"))
    assert sorted(map(tuple, index.terms_of(["of", "w3"]).collect())) == [("of", 0, 21), ("w3", 0, 9)]
    index.close()


def test_tables_that_were_joined_are_kept_in_memory(spark):
    docs = spark.createDataFrame([(i, f"the w{i % 5}") for i in range(20)], "id long, text string")
    index = TextIndex.build(docs, IndexConfig(["text"], auto_vacuum=False))
    index.discard(3)
    assert index.cache().postings.storageLevel.useMemory
    assert sorted(r["id"] for r in search(index, "w3", details=False).collect()) == [8, 13, 18]
    index.close()
