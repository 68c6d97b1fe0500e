"""Queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from lodestone import IndexConfig, TextIndex, catalog, catalog_sql, search

SF = "/root/testdata/sf0.001"


def test_every_search_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog_sql.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture
def compiled(spark):
    """The session as users run it, with stages compiled."""
    settings = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
@pytest.mark.parametrize("name", ["tokenize_default", "search_exact_or", "search_tree", "search_prefix_fuzzy", "search_boost_document", "match_terms", "suggest_prefix", "nullable_field_mean", "search_batch", "topk_by_blocks", "batch_by_buckets", "segmented_search", "segment_stats", "removals_in_order", "snapshot_overlap", "python_analyzer", "map_lookups"])
def test_query_equals_its_sql(compiled, name):
    import duckdb

    spark = compiled

    con = duckdb.connect()
    for table in ("documents", "part", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(catalog_sql.SQL[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows and rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_json_roundtrip_takes_every_part(spark, tmp_path):
    parts = spark.range(500).selectExpr("id AS p_partkey", "CASE WHEN id % 3 = 0 THEN 'small gear' WHEN id % 3 = 1 THEN 'small ring' ELSE 'old plate' END AS p_name", "concat('b', id % 7) AS p_brand")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.QUERIES["json_roundtrip"](spark, str(tmp_path))
    assert sorted(r["p_partkey"] for r in got.collect()) == [i for i in range(500) if i % 3 < 2]
    index = TextIndex.build(spark.read.parquet(str(tmp_path / "part.parquet")), IndexConfig(["p_name"], id_field="p_partkey", store_fields=["p_brand"]))
    want = catalog.scored(search(index, "small gear", details=False, sort=False), "p_partkey", "p_brand")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_documents_are_not_sent_to_their_rows(spark, tmp_path, monkeypatch):
    spark.range(60).selectExpr("id AS p_partkey", "concat('small ring ', id % 3) AS p_name", "concat('b', id % 7) AS p_brand", "'tin' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr("lodestone.operators.index.BROADCAST_IDS", 20)
    catalog.parts_index(spark, str(tmp_path)).docs.count()  # once cached, its size is that of compressed columns
    for name, n in (("field_lengths", 180), ("search_multifield", 60)):
        rows = catalog.QUERIES[name](spark, str(tmp_path))
        assert len(rows.collect()) == n
        assert "ShuffledHashJoin" in rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lens = {(r["p_partkey"], r["field_id"]): r["len"] for r in catalog.QUERIES["field_lengths"](spark, str(tmp_path)).collect()}
    assert lens == {(i, f): (3, 1, 1)[f] for i in range(60) for f in range(3)}
