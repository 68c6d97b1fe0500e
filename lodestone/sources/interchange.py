"""The portable JSON form of an index: written as version 2, read as version 1 or 2.

The form is one JSON text.  ``to_json`` and ``from_json`` hold it whole and so belong to indexes that fit a driver.  ``write_json``
writes it as text files, whose contents in the order of their paths are that text, and ``read_json`` reads them back; both work on
entries and pieces of postings, so neither the driver nor a task holds the text, an index or all postings of a term.
"""

from __future__ import annotations

import dataclasses
import json
from collections import defaultdict
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scratch import kept
from lodestone.operators.index import BROADCAST_IDS, IndexConfig, TextIndex
from lodestone.plans.query import SearchError

#: Documents of a piece of a term's postings, at most.
PIECE = 4096
#: The parts of the text with many entries, in order.
HEAD, IDS, LENGTHS, STORED, POSTINGS = "0-head", "1-documentIds", "3-fieldLength", "5-storedFields", "7-index"


def as_plain_object(index: TextIndex) -> dict[str, Any]:
    """The index as nested dictionaries and lists: a snapshot, stale postings included."""
    docs = sorted(index.docs.collect(), key=lambda r: r["doc_ord"]) if index.docs is not None else []
    lengths: dict[str, list] = {str(r["doc_ord"]): [] for r in docs}
    for r in index.lengths.orderBy("doc_ord", "field_id").collect():
        row = lengths.setdefault(str(r["doc_ord"]), [])
        row += [None] * (r["field_id"] - len(row)) + [r["len"]]
    inner = index.postings.groupBy("term", "field_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_ord", "tf")))).alias("of"))
    terms = inner.groupBy("term").agg(F.collect_list(F.struct("field_id", "of")).alias("fields")).orderBy("term").collect()
    fields = list(index.config.fields)
    return {
        "documentCount": index.document_count,
        "nextId": index.next_ord,
        "documentIds": {str(r["doc_ord"]): r["id"] for r in docs},
        "fieldIds": {name: i for i, name in enumerate(fields)},
        "fieldLength": lengths,
        "averageFieldLength": [index.means.get(i) for i in range(max(index.means, default=-1) + 1)],
        "storedFields": {str(r["doc_ord"]): {k: v for k, v in (r["stored"].asDict(True) if r["stored"] else {}).items() if v is not None and k in index.config.store_fields} for r in docs},
        "dirtCount": index.dirt_count,
        "index": [[r["term"], {str(f["field_id"]): {str(k): v for k, v in f["of"].items()} for f in sorted(r["fields"], key=lambda f: f["field_id"])}] for r in terms],
        "serializationVersion": 2,
    }


def _numbers(value: Any) -> Any:
    """Whole doubles are written as integers, as the format's other writers do."""
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _numbers(v) for k, v in value.items()}
    return [_numbers(v) for v in value] if isinstance(value, list) else value


def to_json(index: TextIndex) -> str:
    plain = as_plain_object(index)
    plain["averageFieldLength"] = _numbers(plain["averageFieldLength"])
    return json.dumps(plain, ensure_ascii=False)


def from_plain_object(spark: SparkSession, plain: dict[str, Any], config: IndexConfig | None) -> TextIndex:
    if config is None:
        raise SearchError("loading an index needs the configuration that it was built with")
    version = plain.get("serializationVersion")
    if version not in (1, 2):
        raise SearchError(f"cannot read serialization version {version!r}")
    fields = [name for name, _ in sorted(plain["fieldIds"].items(), key=lambda x: x[1])]
    index = TextIndex(spark, dataclasses.replace(config, fields=fields))
    index.document_count, index.next_ord, index.dirt_count = plain["documentCount"], plain["nextId"], plain.get("dirtCount") or 0
    index.means = {i: float(v) for i, v in enumerate(_listed(plain["averageFieldLength"])) if v is not None}
    lens = {int(k): _listed(v) for k, v in plain["fieldLength"].items()}
    index.lengths = spark.createDataFrame([(o, i, n) for o, row in lens.items() for i, n in enumerate(row) if n is not None], "doc_ord long, field_id int, len long")
    of = defaultdict(dict, {o: {i: n for i, n in enumerate(row) if n is not None} for o, row in lens.items()})
    rows = []
    for term, by_field in plain["index"]:
        for f, entry in by_field.items():
            counts = entry["ds"] if version == 1 else entry
            # a discarded document has no length any more; its postings wait for the vacuum
            rows += [(term, int(f), int(o), int(tf), of[int(o)].get(int(f), 0)) for o, tf in counts.items()]
    index.postings = spark.createDataFrame(rows, "term string, field_id int, doc_ord long, tf long, len long")
    ids = {int(o): i for o, i in plain["documentIds"].items()}
    stored = {int(o): v for o, v in plain.get("storedFields", {}).items()}
    if ids:
        kind = spark.createDataFrame([(i,) for i in ids.values()]).schema[0].dataType
        known = [{k: v for k, v in s.items() if v is not None} for s in stored.values() if s]
        kinds = {f.name: f.dataType for f in spark.createDataFrame(known).schema} if known else {}
        struct = T.StructType([T.StructField(s, kinds.get(s, T.StringType())) for s in config.store_fields] or [T.StructField("_", T.IntegerType())])
        schema = T.StructType([T.StructField("doc_ord", T.LongType()), T.StructField("id", kind), T.StructField("stored", struct)])
        index.docs = spark.createDataFrame([(o, i, tuple(stored.get(o, {}).get(s) for s in config.store_fields) or (None,)) for o, i in sorted(ids.items())], schema)
    return index


def _listed(value: Any) -> list:
    """Lists may be written as objects keyed by place."""
    if isinstance(value, dict):
        return [value.get(str(i)) for i in range(max(map(int, value), default=-1) + 1)]
    return value


def from_json(spark: SparkSession, text: str, config: IndexConfig | None) -> TextIndex:
    if config is None:
        raise SearchError("loading an index needs the configuration that it was built with")
    return from_plain_object(spark, json.loads(text), config)


def _json(value: Column) -> Column:
    """A value's JSON text."""
    whole = F.to_json(F.array(value), {"ignoreNullFields": "true"})
    return F.substring(whole, 2, F.length(whole) - 2)


def write_json(index: TextIndex, path: str, version: int = 2) -> None:
    """The portable form as text files below ``path``: their contents, in the order of their paths, are the JSON text.

    An entry of a document is a line; a term's postings are lines of up to ``PIECE`` documents between lines that name the term
    and the field.  Version 1 wraps each posting map.
    """
    c, spark = index.config, index.spark
    head = {"documentCount": index.document_count, "nextId": index.next_ord, "fieldIds": {name: i for i, name in enumerate(c.fields)}, "averageFieldLength": _numbers([index.means.get(i) for i in range(max(index.means, default=-1) + 1)]), "dirtCount": index.dirt_count, "serializationVersion": version}
    opened = json.dumps(head, ensure_ascii=False)[:-1]
    for name, text in ((HEAD, f'{opened}, "documentIds": {{'), ("2-then", '}, "fieldLength": {'), ("4-then", '}, "storedFields": {'), ("6-then", '}, "index": ['), ("8-end", "]}")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    shape = ",".join(f"`{name}`:string" for name in c.store_fields) or "_:int"
    docs = index.docs if index.docs is not None else spark.createDataFrame([], f"doc_ord long, id long, stored struct<{shape}>")
    first = docs.agg(F.min("doc_ord")).first()[0]

    def entries(rows: DataFrame, value: Column, name: str) -> None:
        key = F.concat(F.when(F.col("doc_ord") > F.lit(first), F.lit(",")).otherwise(F.lit("")), F.lit('"'), F.col("doc_ord").cast("string"), F.lit('":'))
        rows.repartitionByRange("doc_ord").sortWithinPartitions("doc_ord").select(F.concat(key, value).alias("value")).write.text(f"{path}/{name}")

    entries(docs, _json(F.col("id")), IDS)
    by_field = F.map_from_entries(F.collect_list(F.struct("field_id", "len")))
    lens = index.lengths.groupBy("doc_ord").agg(by_field.alias("of"), F.max("field_id").alias("last"))
    lens = lens.select("doc_ord", F.to_json(F.transform(F.sequence(F.lit(0), "last"), lambda i: F.try_element_at("of", i))).alias("lens"))
    entries(docs.select("doc_ord").join(lens.hint("shuffle_hash"), "doc_ord", "left"), F.coalesce("lens", F.lit("[]")), LENGTHS)
    entries(docs, F.coalesce(_json(F.struct(*[F.col(f"stored.{s}").alias(s) for s in c.store_fields])), F.lit("{}")) if c.store_fields else F.lit("{}"), STORED)

    entry = F.concat(F.lit('"'), F.col("doc_ord").cast("string"), F.lit('":'), F.col("tf").cast("string"))
    pieces = index.postings.groupBy("term", "field_id", F.expr(f"doc_ord div {PIECE}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_ord", entry.alias("entry")))).alias("entries"))
    pieces = kept(pieces.select("term", "field_id", "block", F.size("entries").alias("n"), F.array_join("entries.entry", ",").alias("entries")), "pieces")
    index._scratch.append(pieces)
    fields = pieces.groupBy("term", "field_id").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.sum("n").alias("df"))
    terms = fields.groupBy("term").agg(F.min("field_id").alias("first_field"), F.max("field_id").alias("last_field"))
    rows = pieces.join(fields, ["term", "field_id"]).join(terms, "term")
    new_field, new_term = F.col("block") == F.col("first"), F.col("field_id") == F.col("first_field")
    ends = (F.col("block") == F.col("last")) & (F.col("field_id") == F.col("last_field"))
    close, opens = ("}}", F.concat(F.lit(':{"df":'), F.col("df").cast("string"), F.lit(',"ds":{'))) if version == 1 else ("}", F.lit(":{"))
    lowest = pieces.agg(F.min("term")).first()[0]
    quoted = F.to_json(F.array("term"))
    begun = F.concat(F.when(F.col("term") > F.lit(lowest), F.lit(",")).otherwise(F.lit("")), F.substring(quoted, 1, F.length(quoted) - 1), F.lit(",\n{"))
    named = F.concat(F.when(new_term, begun).otherwise(F.lit(close + ",")), F.lit('"'), F.col("field_id").cast("string"), F.lit('"'), opens, F.lit("\n"))
    text = F.concat(F.when(new_field, named).otherwise(F.lit(",")), "entries", F.when(ends, F.lit(f"\n{close}}}]")).otherwise(F.lit("")))
    rows.repartitionByRange("term", "field_id", "block").sortWithinPartitions("term", "field_id", "block").select(text.alias("value")).write.text(f"{path}/{POSTINGS}")


def read_json(spark: SparkSession, path: str, config: IndexConfig | None, stored: str | None = None) -> TextIndex:
    """The index that ``write_json`` wrote.  ``stored``: types of the stored fields, which the form does not name (default: strings)."""
    if config is None:
        raise SearchError("loading an index needs the configuration that it was built with")
    plain = json.loads(spark.read.text(f"{path}/{HEAD}").first()[0] + "}}")
    version = plain["serializationVersion"]
    if version not in (1, 2):
        raise SearchError(f"cannot read serialization version {version!r}")
    fields = [name for name, _ in sorted(plain["fieldIds"].items(), key=lambda x: x[1])]
    index = TextIndex(spark, dataclasses.replace(config, fields=fields))
    index.document_count, index.next_ord, index.dirt_count = plain["documentCount"], plain["nextId"], plain["dirtCount"]
    index.means = {i: float(v) for i, v in enumerate(plain["averageFieldLength"]) if v is not None}

    def entries(name: str, kind: str) -> DataFrame:
        line = F.concat(F.lit("{"), F.ltrim(F.col("value"), F.lit(",")), F.lit("}"))
        return spark.read.text(f"{path}/{name}").select(F.explode(F.from_json(line, f"map<string,{kind}>"))).select(F.col("key").cast("long").alias("doc_ord"), "value")

    text = F.regexp_extract("value", '^,?"[0-9]+":(.*)$', 1)
    kinds = spark.read.text(f"{path}/{IDS}").agg(F.max(text.startswith('"')).alias("text"), F.max(text.rlike("[.eE]")).alias("real")).first()
    kind = "string" if kinds["text"] else "double" if kinds["real"] else "bigint"
    shape = stored or ", ".join(f"`{s}` string" for s in config.store_fields) or "_ int"
    ids, kept_fields = entries(IDS, kind).withColumnRenamed("value", "id"), entries(STORED, f"struct<{T.StructType.fromDDL(shape).simpleString()[7:-1]}>").withColumnRenamed("value", "stored")
    many = index.document_count > BROADCAST_IDS
    if index.document_count:
        index.docs = kept(ids.join(kept_fields.hint("shuffle_hash") if many else kept_fields, "doc_ord"), "docs")
        index._scratch.append(index.docs)
    lens = entries(LENGTHS, "array<bigint>").select("doc_ord", F.posexplode("value").alias("field_id", "len")).where("len IS NOT NULL")
    index.lengths = kept(lens, "lengths")
    rows = _named_pieces(spark, f"{path}/{POSTINGS}").select("term", "field_id", F.explode("of")).select("term", "field_id", F.col("key").cast("long").alias("doc_ord"), F.col("value").alias("tf"))
    # a discarded document has no length any more; its postings wait for the vacuum
    rows = rows.join(index.lengths.hint("shuffle_hash") if many else index.lengths, ["doc_ord", "field_id"], "left").select("term", "field_id", "doc_ord", "tf", F.coalesce("len", F.lit(0)).cast("long").alias("len"))
    index.postings = kept(rows, "postings")
    index._scratch += [index.lengths, index.postings]
    return index


def _named_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(term, field_id, of: map of documents and occurrences): pieces with the term and the field that stand on lines before them.

    Lines are placed by file and byte; a piece takes the last names before it in its file, or at the end of the files before.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    term = F.when(F.col("value").rlike(r'^,?\["'), F.get(F.from_json(F.concat(F.rtrim(F.ltrim("value", F.lit(",")), F.lit(",")), F.lit("]")), "array<string>"), F.lit(0)))
    field = F.when(F.col("value").rlike(r"\{$"), F.regexp_extract("value", r'"([0-9]+)":\{("df":[0-9]+,"ds":\{)?$', 1).cast("int"))
    lines = lines.select("file", "start", "at", term.alias("_term"), field.alias("_field"), F.when(F.col("value").rlike(r'^,?"[0-9]+":[0-9]'), F.col("value")).alias("piece"))
    lines = kept(lines, "lines")
    last = lambda name: F.last(name, ignorenulls=True)
    files = lines.groupBy("file").agg(F.max_by("_term", F.when(F.col("_term").isNotNull(), F.struct("start", "at"))).alias("t"), F.max_by("_field", F.when(F.col("_field").isNotNull(), F.struct("start", "at"))).alias("f"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("file", last("t").over(before).alias("t"), last("f").over(before).alias("f"))
    within = Window.partitionBy("file").orderBy("start", "at")
    rows = lines.withColumns({"term": last("_term").over(within), "field_id": last("_field").over(within)}).where("piece IS NOT NULL").join(F.broadcast(files), "file")
    of = F.from_json(F.concat(F.lit("{"), F.ltrim("piece", F.lit(",")), F.lit("}")), "map<string,bigint>")
    return rows.select(F.coalesce("term", "t").alias("term"), F.coalesce("field_id", "f").alias("field_id"), of.alias("of"))
