"""Segments, tombstones, merges and versions of an index on disk, against an index in memory."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone import IndexConfig, SearchError, TextIndex, search
from lodestone.operators.segments import SegmentedIndex

WORDS = "red blue ring anvil plate gear small old cold hot nation sea".split()


def rows(spark, low, high, extra=""):
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(12)) + 1).cast("int")) for i in range(5)], F.lit(extra))
    return spark.range(low, high, 1, 2).select("id", F.when(F.col("id") % 7 != 0, text).alias("title"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("note"))


def config(**options):
    return IndexConfig(["title", "note"], store_fields=["title"], **{"auto_vacuum": False, "logger": None, **options})


def found(index, query="red ring small", **options):
    return {r["id"]: pytest.approx(r["score"], rel=1e-9) for r in search(index, query, details=False, sort=False, **options).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def test_batches_replacements_and_discards_equal_an_index_in_memory(spark, tmp_path):
    disk, memory = SegmentedIndex.open(spark, str(tmp_path), config(), fanout=None), TextIndex(spark, config())
    for low, high in ((0, 40), (40, 60)):
        disk.add_all(rows(spark, low, high))
        memory.add_all(rows(spark, low, high))
    disk.discard_all([44, 3, 17, 21])
    memory.discard_all([44, 3, 17, 21])
    again = rows(spark, 50, 70, "renewed").orderBy("id")
    memory.discard_all(again.where("id < 60").select("id"))
    memory.add_all(again)
    disk.replace_all(again)
    assert (disk.document_count, disk.dirt_count, disk.version) == (memory.document_count, memory.dirt_count, 4)
    assert disk.manifest.means == {f: pytest.approx(m) for f, m in memory.means.items()}
    assert [(s.docs, s.deleted) for s in disk.segments] == [(40, 3), (20, 11), (20, 0)]
    reread = SegmentedIndex.open(spark, str(tmp_path), config())
    for options in ({}, {"prefix": True}, {"fuzzy": 1}, {"combine_with": "AND"}, {"df_mode": "snapshot"}):
        assert found(reread.index(), "red ring renewed", **options) == found(memory, "red ring renewed", **options)
    # removal leaves no dirt, and a partial vacuum meets only what is worn
    disk.remove_all([1, 14, 20])
    memory.remove_all(rows(spark, 0, 40).where("id IN (1, 14, 20)"))
    assert (disk.document_count, disk.dirt_count) == (memory.document_count, memory.dirt_count)
    assert disk.manifest.means == {f: pytest.approx(m) for f, m in memory.means.items()}
    assert found(disk.index()) == found(memory)
    assert disk.vacuum(min_share=0.5) == 1 and [(s.docs, s.deleted) for s in disk.segments if s.deleted] == [(37, 3)]
    assert found(disk.index()) == found(memory)
    assert disk.vacuum() == 1 and disk.dirt_count == 0
    memory.vacuum()
    assert found(disk.index()) == found(memory) and disk.index().term_count == memory.term_count


def test_what_a_batch_writes_is_in_proportion_to_it(spark, tmp_path):
    path = str(tmp_path)
    index = SegmentedIndex.open(spark, path, config(), fanout=None)
    index.add_all(rows(spark, 0, 4000))
    large, before = size(path), files(path)
    index.replace_all(rows(spark, 3990, 4010, "new"))
    assert before <= files(path)  # nothing is rewritten
    assert size(path) - large < large / 8
    large, before = size(path), files(path)
    index.discard_all([5, 6])
    assert before <= files(path) and not [f for f in files(path) - before if "/segments/" in f]


def test_segments_of_like_size_are_merged(spark, tmp_path):
    index = SegmentedIndex.open(spark, str(tmp_path), config(), fanout=3)
    for i in range(4):
        index.replace_all(rows(spark, i * 4, i * 4 + 5))
    # the third batch made three of a size; the document that each batch replaces went with the merge
    assert sorted(s.docs for s in index.segments) == [5, 13] and index.dirt_count == 1
    whole = TextIndex.build(rows(spark, 0, 17), config())
    index.vacuum()
    assert set(found(index.index())) == set(found(whole))
    assert index.merge() == 0


def test_versions(spark, tmp_path):
    path = str(tmp_path)
    index = SegmentedIndex.open(spark, path, config())
    assert index.document_count == 0 and search(index.index(), "red").collect() == []
    index.add_all(rows(spark, 0, 10))
    index.discard_all([2])
    index.vacuum()
    other = SegmentedIndex.open(spark, path, config(), version=1)
    assert (other.document_count, other.dirt_count, SegmentedIndex.open(spark, path, config(), version=2).dirt_count) == (10, 0, 1)
    with pytest.raises(Exception, match="(?i)exists"):
        other.discard_all([3])  # version 2 is there
    with pytest.raises(SearchError):
        SegmentedIndex.open(spark, path, config(), version=9)
    assert index.versions() == [1, 2, 3] and index.expire() == 2
    assert index.versions() == [3] and found(SegmentedIndex.open(spark, path, config()).index()) == found(index.index())


def test_all_or_none(spark, tmp_path):
    index = SegmentedIndex.open(spark, str(tmp_path), config())
    index.add_all(rows(spark, 0, 10))
    twice = rows(spark, 8, 12).union(rows(spark, 8, 12))
    for change in (lambda: index.add_all(rows(spark, 9, 12)), lambda: index.replace_all(twice), lambda: index.discard_all([1, 99]), lambda: index.discard_all([1, 1])):
        with pytest.raises(SearchError):
            change()
    assert (index.version, index.document_count, index.dirt_count) == (1, 10, 0)
    index.discard_all([])
    index.add_all(rows(spark, 0, 0))
    assert index.document_count == 10 and len(index.segments) == 1


def test_automatic_vacuum(spark, tmp_path):
    index = SegmentedIndex.open(spark, str(tmp_path), config(auto_vacuum={"min_dirt_count": 3, "min_dirt_factor": 0.1}))
    index.add_all(rows(spark, 0, 10))
    index.discard_all([1, 2])
    assert index.dirt_count == 2
    index.discard_all([4])
    assert index.dirt_count == 0 and [(s.docs, s.deleted) for s in index.segments] == [(7, 0)]
