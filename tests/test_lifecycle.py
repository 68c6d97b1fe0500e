import pytest
from pyspark.sql import functions as F

from lodestone import WILDCARD, IndexConfig, SearchError, TextIndex, search
from lodestone.operators.index import ARRIVAL

DOCS = [
    (1, "alpha beta", "the quick brown fox"),
    (2, "beta gamma", "jumps over the lazy dog"),
    (3, "gamma delta", "the fox and the dog"),
    (4, "delta epsilon", "quick quick quick brown"),
    (5, "epsilon alpha", "lazy lazy fox dog dog dog"),
]


@pytest.fixture
def index(spark):
    docs = spark.createDataFrame(DOCS, "id int, title string, text string")
    return TextIndex.build(docs, IndexConfig(["title", "text"], store_fields=["title"]))


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_term_frequency_scores(index):
    rows = search(index, "quick").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(4, pytest.approx(1.9476891595835022, rel=1e-9)), (1, pytest.approx(1.2775735643943542, rel=1e-9))]
    assert rows[0]["title"] == "delta epsilon"


@pytest.mark.parametrize("mode", ["live", "snapshot"])
def test_discard_and_vacuum(index, mode):
    assert index.term_count == 14
    index.discard(3)
    assert (index.dirt_count, index.document_count, index.term_count, index.has(3)) == (1, 4, 14, False)
    assert index.dirt_factor == pytest.approx(1 / 6)
    assert ids(search(index, "fox dog the", df_mode=mode)) == [5, 1, 2]
    index.vacuum()
    assert (index.term_count, index.dirt_count) == (13, 0)


def test_discard_all_and_absent(index):
    index.discard_all([1, 2])
    assert (index.dirt_count, index.document_count) == (2, 3)
    assert ids(search(index, "alpha beta gamma")) == [5, 3]
    with pytest.raises(SearchError):
        index.discard(1)


def test_snapshot_and_live_differ_as_documented(index):
    index.discard(2)
    assert ids(search(index, "beta gamma", df_mode="snapshot")) == [3, 1]
    assert ids(search(index, "beta gamma")) == [1, 3]


def test_remove_all(index):
    index.remove_all()
    assert (index.document_count, index.term_count) == (0, 0)
    assert ids(search(index, "fox")) == []


def test_remove_and_add_again(index):
    index.remove({"id": 1, "title": "alpha beta", "text": "the quick brown fox"})
    assert index.document_count == 4
    assert ids(search(index, "alpha")) == [5]
    index.add({"id": 1, "title": "alpha reborn", "text": "brand new alpha content"})
    rows = search(index, "alpha").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(1, pytest.approx(3.336225691153481, rel=1e-9)), (5, pytest.approx(1.3132031060308498, rel=1e-9))]


def test_replace(index):
    index.replace({"id": 1, "title": "omega", "text": "fresh"})
    assert ids(search(index, "omega")) == [1] and ids(search(index, "beta")) == [2]
    assert ids(search(index, WILDCARD)) == [2, 3, 4, 5, 1]
    with pytest.raises(SearchError):
        index.replace({"id": 99, "title": "x", "text": "y"})


def test_changed_document_is_reported(spark):
    said = []
    docs = spark.createDataFrame(DOCS, "id int, title string, text string")
    index = TextIndex.build(docs, IndexConfig(["title", "text"], logger=lambda *x: said.append(x)))
    index.remove({"id": 1, "title": "alpha other", "text": "the quick brown fox"})
    assert len(said) == 1 and said[0][0] == "warn" and '"other"' in said[0][1] and said[0][2] == "version_conflict"


def test_auto_vacuum(spark):
    many = spark.createDataFrame([(i + 1, f"doc {i}", f"content word{i % 5} common") for i in range(60)], "id int, title string, text string")
    index = TextIndex.build(many, IndexConfig(["title", "text"]))
    assert index.term_count == 68
    index.discard_all(range(1, 20))
    index.discard(20)
    index.discard_all(range(21, 26))
    assert (index.dirt_count, index.document_count) == (5, 35)


def test_ids_are_checked(spark, index):
    with pytest.raises(SearchError):
        index.add({"id": 1, "title": "again", "text": "x"})
    with pytest.raises(SearchError):
        index.add({"title": "none", "text": "x"})
    with pytest.raises(SearchError):
        IndexConfig([])
    with pytest.raises(SearchError):
        index.remove_all(None)
    index.remove_all([])
    assert index.document_count == 5
    assert index.get_stored_fields(2) == {"title": "beta gamma"} and index.get_stored_fields(77) is None
    assert index.config.default("id_field") == "id"
    with pytest.raises(SearchError):
        index.config.default("nothing")


def stepwise(docs, gone):
    """Mean length of a field after documents came and left one by one."""
    n, mean = 0, 0.0
    for d in docs:
        n += 1
        mean = (mean * (n - 1) + len(d["a"].split())) / n if d.get("a") else mean
    for i in gone:
        d = next(d for d in docs if d["id"] == i)
        mean = (mean * n - len(d["a"].split())) / (n - 1) if d.get("a") else mean
        n -= 1
    return mean


ODD = [{"id": 1, "a": "x y z", "b": "q"}, {"id": 2, "b": "q"}, {"id": 3, "a": "x", "b": "q"}, {"id": 4, "a": "x y", "b": "q"}, {"id": 5, "a": "u v w x", "b": "q"}]


@pytest.mark.parametrize("gone", [[1, 2], [2, 1], [5, 2, 3], [3, 2, 5]])
def test_removal_in_the_callers_order(spark, gone):
    schema = "id int, a string, b string, turn int"
    rows = spark.createDataFrame([d | {"turn": gone.index(d["id"]) if d["id"] in gone else 9} for d in ODD], schema)
    leaving = rows.where(F.col("id").isin(gone))
    want = stepwise(ODD, gone)
    made = lambda: TextIndex.build(rows.drop("turn"), IndexConfig(["a", "b"], auto_vacuum=False))
    as_list, as_rows, dropped, dropped_rows = made(), made(), made(), made()
    as_list.remove_all([next(d for d in ODD if d["id"] == i) for i in gone])
    as_rows.remove_all(leaving, order=[F.col("turn")])
    dropped.discard_all(gone)
    dropped_rows.discard_all(leaving, order=["turn"])
    assert [i.means[0] for i in (as_list, as_rows, dropped, dropped_rows)] == [pytest.approx(want)] * 4
    assert stepwise(ODD, [1, 2]) != pytest.approx(stepwise(ODD, [2, 1]))


def test_arrival_order_numbers_without_sorting(spark):
    rows = spark.createDataFrame([(i, "a b" if i % 2 else None) for i in (5, 3, 9, 1, 7, 2)], "id int, title string").repartition(3)
    index = TextIndex.build(rows, IndexConfig(["title"]), order=ARRIVAL)
    assert sorted(r["doc_ord"] for r in index.docs.collect()) == list(range(6))
    index.add_all(rows.selectExpr("id + 100 AS id", "title"), order=ARRIVAL)
    assert sorted(r["doc_ord"] for r in index.docs.collect()) == list(range(12))
    with pytest.raises(SearchError, match="duplicate id 5"):
        index.add_all(rows.where("id = 5"))
    with pytest.raises(SearchError, match="duplicate id 3"):
        index.add_all(rows.where("id = 3").union(rows.where("id = 3")).selectExpr("id", "title"))
    with pytest.raises(SearchError, match="id field"):
        index.add_all(rows.selectExpr("cast(null AS int) AS id", "title"), order=ARRIVAL)
    assert index.document_count == 12
    index.close()
    assert index.document_count == 0
