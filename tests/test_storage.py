import json

import pytest

from lodestone import IndexConfig, SearchError, TextIndex, search
from lodestone.operators.prefix_map import PrefixMap
from lodestone.operators.segments import SegmentedIndex
from lodestone.sources import tables
from lodestone.sources import interchange
from lodestone.sources.interchange import as_plain_object, from_json, from_plain_object, read_json, to_json, write_json
from lodestone.streaming.ingest import ingest

DOCS = [(1, "alpha beta", "the quick brown fox"), (2, "beta gamma", None), (3, "gamma delta", "the fox and the dog")]
SCHEMA = "id int, title string, text string"


@pytest.fixture(scope="module")
def config():
    return IndexConfig(["title", "text"], store_fields=["title"])


def found(index, query, **options):
    return [(r["id"], pytest.approx(r["score"])) for r in search(index, query, **options).collect()]


def test_json_round_trip(spark, config):
    index = TextIndex.build(spark.createDataFrame(DOCS, SCHEMA), config)
    index.discard(3)
    plain = as_plain_object(index)
    assert (plain["documentCount"], plain["nextId"], plain["dirtCount"], plain["serializationVersion"]) == (2, 3, 1, 2)
    assert plain["fieldIds"] == {"title": 0, "text": 1} and plain["fieldLength"]["0"] == [2, 4]
    assert dict((t, f) for t, f in plain["index"])["fox"] == {"1": {"0": 1, "2": 1}}
    assert json.loads(to_json(index))["averageFieldLength"][0] == 2
    again = from_json(spark, to_json(index), config)
    for mode in ("live", "snapshot"):
        assert found(again, "beta fox", df_mode=mode) == found(index, "beta fox", df_mode=mode)
    assert again.get_stored_fields(2) == {"title": "beta gamma"}
    again.vacuum()
    assert again.term_count == 7


def test_version_1_and_errors(spark, config):
    old = {"documentCount": 1, "nextId": 1, "documentIds": {"0": 7}, "fieldIds": {"title": 0, "text": 1}, "fieldLength": {"0": {"0": 1, "1": 2}}, "averageFieldLength": {"0": 1, "1": 2}, "storedFields": {"0": {"title": "x"}}, "index": [["hello", {"1": {"df": 1, "ds": {"0": 2}}}]], "serializationVersion": 1}
    index = from_plain_object(spark, old, config)
    assert [r["id"] for r in search(index, "hello").collect()] == [7] and index.dirt_count == 0
    with pytest.raises(SearchError):
        from_plain_object(spark, {**old, "serializationVersion": 3}, config)
    with pytest.raises(SearchError):
        from_json(spark, "{}", None)


def test_tables_round_trip_and_pushed_filters(spark, config, tmp_path):
    index = TextIndex.build(spark.createDataFrame(DOCS, SCHEMA), config)
    tables.save(index, str(tmp_path / "x"))
    again = tables.load(spark, str(tmp_path / "x"), config)
    assert found(again, "fox beta", prefix=True) == found(index, "fox beta", prefix=True)
    plan = search(again, "fox", prefix=True, details=False)._jdf.queryExecution().toString()
    assert "EqualTo(term,fox)" in plan or "In(term, [fox" in plan


def test_prefix_map(spark):
    m = PrefixMap.of(spark, [("border", 1), ("bore", 2), ("bound", 3), ("bore", 4)])
    assert m.to_dict() == {"border": 1, "bore": 4, "bound": 3} and m.size == 3
    view = m.at_prefix("bo").at_prefix("bor")
    assert view.keys() == ["border", "bore"]
    with pytest.raises(SearchError):
        view.at_prefix("x")
    assert m.fuzzy_get("boar", 2) == {"bore": (4, 2)} and m.fuzzy_get("border", 0) == {"border": (1, 0)}
    m.set("null", None)
    assert m.has("null") and m.get("null") is None and not m.has("bo")
    m.update("bore", lambda x: x + 1)
    assert m.fetch("bore", lambda: 0) == 5 and m.fetch("new", lambda: 9) == 9
    m.delete("bore")
    m.delete("absent")
    assert not m.has("bore")
    with pytest.raises(SearchError):
        m.set(3, 1)
    m.clear()
    assert m.size == 0 and m.values() == []


def test_stream_ingest(spark, config, tmp_path):
    for n, rows in enumerate((DOCS[:2], [(2, "omega", "fresh"), (3, "gamma delta", "the fox")])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = ingest(stream, str(tmp_path / "out"), config, str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    stored = SegmentedIndex.open(spark, str(tmp_path / "out"), config)
    assert (stored.manifest.batch, len(stored.segments), stored.dirt_count) == (1, 2, 1)
    index = stored.index()
    assert index.document_count == 3 and [r["id"] for r in search(index, "omega").collect()] == [2]
    assert [r["id"] for r in search(index, "beta").collect()] == [1]


@pytest.mark.parametrize("version", [1, 2])
def test_the_portable_form_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch, version):
    monkeypatch.setattr(interchange, "PIECE", 4)
    config = IndexConfig(["title", "text"], store_fields=["title", "n"])
    docs = [(f"d{i}", None if i % 5 == 0 else f'al"pha {{x, \tb{i % 3}', None if i % 4 == 1 else f"the fox {'fox ' * (i % 3)}é\\{i}", i if i % 2 else None) for i in range(40)]
    index = TextIndex.build(spark.createDataFrame(docs, "id string, title string, text string, n long"), config)
    index.discard("d7")
    path = tmp_path / "portable"
    write_json(index, str(path), version)
    text = "".join(f.read_text() for f in sorted(path.glob("*/part-*")))
    plain, want = json.loads(text), as_plain_object(index)
    if version == 1:
        want = want | {"serializationVersion": 1, "index": [[t, {f: {"df": len(of), "ds": of} for f, of in by.items()}] for t, by in want["index"]]}
    assert plain == json.loads(json.dumps(want))
    again, whole = read_json(spark, str(path), config, stored="title string, n long"), from_json(spark, text, config)
    shown = lambda rows: sorted(map(repr, rows.collect()))
    for name in ("postings", "lengths", "docs"):
        a, b = getattr(again, name), getattr(whole, name)
        assert shown(a.select(*b.columns)) == shown(b) and not a.isEmpty()
    assert found(again, "fox x", df_mode="snapshot") == found(index, "fox x", df_mode="snapshot")
    assert again.get_stored_fields("d1") == index.get_stored_fields("d1")


def test_an_empty_index_in_the_portable_form(spark, tmp_path, config):
    write_json(TextIndex(spark, config), str(tmp_path / "none"))
    again = read_json(spark, str(tmp_path / "none"), config)
    assert (again.document_count, again.docs, again.postings.count()) == (0, None, 0)
