
import pytest

from lodestone import WILDCARD, Analyzer, IndexConfig, SearchError, TextIndex, auto_suggest, search, search_batch, tree
from pyspark.sql import functions as F

ITALIAN = [
    (1, "Divina Commedia", "Nel mezzo del cammin di nostra vita", None, "poetry"),
    (2, "I Promessi Sposi", "Quel ramo del lago di Como", "it", "fiction"),
    (3, "Vita Nova", "In quella parte del libro della mia memoria", None, "poetry"),
]
SONGS = [("1", "Killer Queen", "Queen"), ("2", "The Witch Queen Of New Orleans", "Redbone"), ("3", "Waterloo", "Abba"), ("4", "Take A Chance On Me", "Abba"), ("5", "Help", "The Beatles"), ("6", "Yellow Submarine", "The Beatles"), ("7", "Dancing Queen", "Abba"), ("8", "Bohemian Rhapsody", "Queen")]


@pytest.fixture(scope="module")
def italian(spark):
    docs = spark.createDataFrame(ITALIAN, "id int, title string, text string, lang string, category string")
    return TextIndex.build(docs, IndexConfig(["title", "text"], store_fields=["lang", "category"])).cache()


@pytest.fixture(scope="module")
def match_docs(spark):
    rows = [(1, "Divina Commedia", "Nel mezzo del cammin di nostra vita ... cammin"), (2, "I Promessi Sposi", "Quel ramo del lago di Como"), (3, "Vita Nova", "In quella parte del libro della mia memoria ... vita")]
    return TextIndex.build(spark.createDataFrame(rows, "id int, title string, text string"), IndexConfig(["title", "text"])).cache()


def ids(rows):
    return [r["id"] for r in rows.collect()]


def test_songs_fuzzy_and_prefix(spark):
    index = TextIndex.build(spark.createDataFrame(SONGS, "id string, song string, artist string"), IndexConfig(["song", "artist"], store_fields=["song"])).cache()
    titles = lambda q: [r["song"] for r in search(index, q, fuzzy=1, prefix=True).collect()]
    assert titles("witch queen") == ["The Witch Queen Of New Orleans", "Killer Queen", "Bohemian Rhapsody", "Dancing Queen"]
    assert titles("queen") == ["Killer Queen", "Bohemian Rhapsody", "Dancing Queen", "The Witch Queen Of New Orleans"]


def test_match_terms_and_query_terms(match_docs):
    rows = search(match_docs, "vi nuova m de", fuzzy=0.2, prefix=True).collect()
    assert [r["query_terms"] for r in rows] == [["vi", "nuova", "m", "de"], ["vi", "m", "de"], ["de"]]
    assert rows[0]["match"] == {"vita": ["title", "text"], "nova": ["title"], "memoria": ["text"], "mia": ["text"], "del": ["text"], "della": ["text"]}
    assert [sorted(r["terms"]) for r in rows] == [["del", "della", "memoria", "mia", "nova", "vita"], ["del", "mezzo", "vita"], ["del"]]


def test_and_keeps_documents_with_all_terms(match_docs):
    rows = search(match_docs, "vita nova", combine_with="AND").collect()
    assert [(r["id"], r["match"]) for r in rows] == [(3, {"vita": ["title", "text"], "nova": ["title"]})]


def test_trees_cascade_options(italian):
    rows = search(italian, tree(tree("vit", prefix=True, fields=["title"]), tree("bago", "coomo", combine_with="AND"), combine_with="OR", fuzzy=True, weights={"fuzzy": 0.2, "prefix": 0.75}))
    assert ids(rows) == [3, 2]
    assert ids(search(italian, tree(WILDCARD, "vita", combine_with="AND_NOT"))) == [2]
    two = [{"fields": ["text"], "queries": ["vita"]}, {"fields": ["title"], "queries": ["promessi"]}]
    reference = search(italian, {"queries": two}).collect()
    assert ids(search(italian, {"queries": two}, combine_with="AND")) == []
    assert len(search(italian, {"queries": two, "combine_with": "OR"}, combine_with="AND").collect()) == len(reference)
    boosted = {r["id"]: r["score"] for r in search(italian, {"queries": two}, boost={"title": 2}).collect()}
    assert boosted[2] > {r["id"]: r["score"] for r in reference}[2]


def test_fields_boosts_and_filters(italian):
    assert ids(search(italian, "vita", fields=["title"], boost={"text": 2})) == [3]
    assert ids(search(italian, "del", filter=F.col("category") == "fiction")) == [2]
    assert 3 not in ids(search(italian, "vita", boost_document=lambda i, t, s: F.when(i != 3, 1)))
    plain = {r["id"]: r["score"] for r in search(italian, "vita").collect()}
    twice = {r["id"]: r["score"] for r in search(italian, "vita", boost_term=lambda t, i, ts: 2).collect()}
    assert twice == {k: pytest.approx(2 * v) for k, v in plain.items()}
    for how in (None, "OR", "AND", "AND_NOT"):
        assert ids(search(italian, "", combine_with=how)) == []
    with pytest.raises(SearchError):
        search(italian, "vita", combine_with="XOR")
    with pytest.raises(SearchError):
        search(italian, "vita", bm25={"k": 1})


def test_options_may_be_functions(italian):
    calls = []
    fuzzy = lambda t, i, ts: calls.append((t, i, ts)) or (2 if len(t) > 4 else False)
    assert ids(search(italian, "quel comedia", fuzzy=fuzzy, prefix=lambda t, i, ts: len(t) > 4)) == [2, 1]
    assert calls == [("quel", 0, ["quel", "comedia"]), ("comedia", 1, ["quel", "comedia"])]


def test_search_time_analysis(italian):
    assert ids(search(italian, "divinaXcommedia", tokenize=lambda s: s.split("X"))) == [1]
    assert ids(search(italian, "d1v1n4", process_term=lambda t: t.replace("1", "i").replace("4", "a").lower())) == [1]
    assert ids(search(italian, "quel commedia", process_term=lambda t: None if t == "quel" else t)) == [1]
    assert ids(search(italian, "divinacommedia", process_term=lambda t: ["divina", "commedia"] if t == "divinacommedia" else t)) == [1]


def test_wildcard_and_null_fields(spark):
    rows = [(1, "something cool", True), (2, "something else", False), (3, None, True)]
    index = TextIndex.build(spark.createDataFrame(rows, "id int, text string, cool boolean"), IndexConfig(["text"], store_fields=["cool"]))
    assert ids(search(index, "*")) == [] and ids(search(index, "")) == []
    assert ids(search(index, WILDCARD)) == [1, 2, 3]
    assert ids(search(index, WILDCARD, filter="cool", boost_document=lambda i, t, s: i)) == [3, 1]


def test_limit_keeps_the_first_rows(italian):
    every = search(italian, "vita del quella", prefix=True).collect()
    assert len(every) == 3 and search(italian, "vita del quella", prefix=True, limit=2).collect() == every[:2]
    assert search(italian, "vita del quella", prefix=True, limit=1, filter=F.col("category") == "fiction").collect() == [r for r in every if r["category"] == "fiction"][:1]


def test_suggestions(italian):
    said = lambda q, **o: [r["suggestion"] for r in auto_suggest(italian, q, **o).collect()]
    assert said("com") == ["como", "commedia"]
    assert said("vita no") == ["vita nova", "vita nostra"]
    assert said("nostra vi") == ["nostra vita"]
    assert said("paguro") == [] and said("") == []
    assert said("que", filter=F.col("category") == "fiction") == ["quel"]


def test_suggestion_defaults(spark):
    docs = spark.createDataFrame([r[:3] for r in ITALIAN], "id int, title string, text string")
    index = TextIndex.build(docs, IndexConfig(["title", "text"], auto_suggest_options={"combine_with": "OR", "fuzzy": True})).cache()
    assert [r["suggestion"] for r in auto_suggest(index, "nosta vi").collect()] == ["nostra vita", "vita"]
    index = TextIndex.build(docs, IndexConfig(["title", "text"], search_options={"combine_with": "OR", "fuzzy": True})).cache()
    assert [r["suggestion"] for r in auto_suggest(index, "nosta vi").collect()] == ["nostra vita"]


def test_mean_length_follows_the_order_of_documents(spark):
    import random

    random.seed(3)
    lens = [random.choice([None, *range(1, 9)]) for _ in range(60)]
    rows = [(i, None if n is None else " ".join(f"w{j}" for j in range(n)), "x") for i, n in enumerate(lens)]
    index = TextIndex(spark, IndexConfig(["a", "b"]))
    schema = "id int, a string, b string"
    index.add_all(spark.createDataFrame(rows[:23], schema))
    index.add_all(spark.createDataFrame(rows[23:], schema))
    mean = 0.0
    for i, n in enumerate(lens):
        mean = mean if n is None else (mean * i + n) / (i + 1)
    assert index.means[0] == pytest.approx(mean, rel=1e-9) and index.means[1] == pytest.approx(1.0)


def test_synonyms_stopwords_and_nested_fields(spark):
    rows = [(1, ("ann",), ["red", "green"]), (2, ("bob",), ["blue"])]
    docs = spark.createDataFrame(rows, "id int, author struct<name:string>, tags array<string>")
    more = Analyzer(process_column=lambda t, f: F.when(t == "red", F.array(F.lit("red"), F.lit("crimson"))).when(t != "green", F.array(t)), expands=True)
    config = IndexConfig(["tags", "author.name"], analyzer=more, stringify=lambda v, f: F.array_join(v, " ") if f == "tags" else v.cast("string"))
    index = TextIndex.build(docs, config)
    assert ids(search(index, "crimson")) == [1] and ids(search(index, "green")) == [] and ids(search(index, "bob")) == [2]


def test_batch_agrees_with_single_searches(spark, italian):
    queries = spark.createDataFrame([(1, "vita del"), (2, "nova nova como"), (3, "absent")], "query_id int, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in search_batch(italian, queries).collect()}
    want = {(q, r["id"]): r["score"] for q, t in ((1, "vita del"), (2, "nova nova como")) for r in search(italian, t).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_batch_expands_prefixes_and_edits(spark, italian):
    texts = ["vit del", "nuova como", "mezo", "co me", "quela parti memorie", "vita"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    for options in ({"prefix": True}, {"fuzzy": 0.2}, {"fuzzy": 2}, {"fuzzy": 3, "prefix": True}):
        got = {(r["query_id"], r["id"]): r["score"] for r in search_batch(italian, queries, k=None, **options).collect()}
        want = {(q, r["id"]): r["score"] for q, t in enumerate(texts) for r in search(italian, t, details=False, **options).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}, options
