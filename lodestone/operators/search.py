"""Search: a query tree over the index tables, as one plan.

Leaves are expanded over the table of terms, which gives each term's weights and document counts; edit distances are taken
there and nowhere else.  All leaves share one pass over the postings of the terms found: up to ``LITERALS`` of them stand as
literals in the scan's filter, beyond that the scan meets them by a join.  Each posting is exploded into the leaves that it
matches, and a single aggregation by document holds one conditional sum for each leaf.  The tree of combinators is then
arithmetic over those sums within a row, so AND, OR and AND_NOT need no joins.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scratch import kept
from lodestone.operators import batch, topk
from lodestone.operators.batch import best_in_windows, sent_terms
from lodestone.operators.index import TextIndex
from lodestone.operators.neighbours import DELETIONS, LONGEST, deletions, text_deletions
from lodestone.operators.score import any_of, bm25, by_leaf, expansions, field_boost, term_filter
from lodestone.operators.topk import BROADCAST_WINDOWS, SLACK, block_bounds, promising, promising_of_each, window_of, within
from lodestone.plans.query import BM25, FUZZY_SHARE, WEIGHTS, Leaf, Node, Resolver, SearchError, combinator, leaves


#: Best rows up to which they are broadcast to the documents.
BROADCAST_ROWS = 100_000
#: Terms up to which they are literals of the postings' filter.
LITERALS = 1_000
#: Documents of a block over which stale ones are summed.
STALE_BLOCK = 1 << 16
#: Terms up to which they are broadcast to the postings.
BROADCAST_TERMS = 1_000_000


class Matched:
    """The terms that leaves mean: ``stats(term, field_id, m, xs)``, broadcast where ``bounded``; literals where ``few``."""

    def __init__(self, index: TextIndex, found: list[Leaf]):
        self.index, self.found = index, found
        self._look_up()

    def _look_up(self) -> None:
        index, found = self.index, self.found
        if any(x.prefix or x.distance for x in found):
            near = self._near()
            matched = index.terms.where(any_of([term_filter(x, F.col("term"), x.index not in near) for x in found] + ([F.col("term").isin(sorted(set().union(*near.values())))] if near else [])))
            met = [r["term"] for r in matched.select("term").distinct().limit(LITERALS + 1).collect()]
            if len(met) <= LITERALS:
                matched = index.terms.where(F.col("term").isin(met))
        else:
            met = list(dict.fromkeys(x.term for x in found))
            matched = index.terms_of(met) if len(met) <= LITERALS else index.terms.where(F.col("term").isin(met))
        self.met, self.few = met, len(met) <= LITERALS
        self.bounded = self.few or matched.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        stats = matched.select("term", "field_id", F.col("df").cast("double").alias("m"), expansions(found, F.col("term")).alias("xs"))
        self.stats = F.broadcast(stats) if self.bounded else stats

    def _near(self) -> dict[int, list[str]]:
        """By leaf: candidates of fuzzy leaves from the stored deletions, which are asked for as literals; edits are counted later."""
        kept = self.index._neighbours
        asked = [x for x in self.found if kept is not None and 0 < x.distance <= DELETIONS and len(x.term) <= LONGEST]
        out = {}
        for x in asked:
            cuts = text_deletions(x.term, x.distance)
            rows = kept.where((F.col("times") <= x.distance) & F.col("cut").isin(sorted(cuts))).select("term").distinct().limit(LITERALS + 1).collect()
            if len(rows) <= LITERALS:
                out[x.index] = [r["term"] for r in rows]
        return out

    def of(self, table: DataFrame) -> DataFrame:
        """Rows of a table by term, held to the terms where they are few."""
        return table.where(F.col("term").isin(self.met)) if self.few else table

    def weighed(self, rows: DataFrame, tf: str, length: str) -> DataFrame:
        """``rows(term, field_id, m, xs, ...)`` for each leaf ``x`` with ``boost`` and ``rank``."""
        index, found = self.index, self.found
        if "xs" in rows.columns:
            rows = rows.withColumn("x", F.explode("xs")).drop("xs")
        means = F.create_map(*[F.lit(y) for f, mean in index.means.items() for y in (f, float(mean))]) if index.means else F.create_map().cast("map<int,double>")
        of = lambda name: by_leaf(found, lambda x: x.bm25[name], F.col("x.leaf"))
        rank = bm25(F.col(tf).cast("double"), index.document_count, F.col("m"), F.col(length).cast("double"), F.element_at(means, F.col("field_id")), of("k"), of("b"), of("d"))
        ids = {name: i for i, name in enumerate(index.config.fields)}
        return rows.withColumn("boost", field_boost(found, ids, F.col("x.leaf"), F.col("field_id"))).where("boost IS NOT NULL").withColumn("rank", rank)


def contributions(index: TextIndex, found: list[Leaf], df_mode: str = "live", matched: Matched | None = None, windows: DataFrame | None = None) -> DataFrame:
    """(doc_ord, leaf, kind, term, field_id, w): what each match adds to its document.

    ``df_mode``: a term's documents are the live ones (``live``) or, for the first search after discards on an index that
    cleans itself as it goes (``snapshot``), all stored ones less the stale ones met before.  ``windows``: only of those
    windows' documents, on an index without discarded ones.
    """
    if df_mode not in ("live", "snapshot"):
        raise SearchError(f"unknown df_mode {df_mode!r}")
    dirty = index.dirt_count > 0
    keys = ["term", "field_id"]
    matched = matched or Matched(index, found)
    stats, bounded = matched.stats, matched.bounded
    rows = matched.of(index.postings)
    if windows is not None:
        rows = within(rows, windows)
    if dirty and df_mode == "snapshot":
        rows = _as_met(index, rows.join(stats, keys), found)
    elif dirty:
        rows = rows.join(stats.drop("m"), keys).join(index.docs.select("doc_ord"), "doc_ord", "left_semi")
        # counted before the shuffle; the statistics have a row for each matched term, not for each posting
        counts = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("m"))
        rows = rows.join(F.broadcast(counts) if bounded else counts, keys)
    else:
        rows = rows.join(stats, keys)
    rows = matched.weighed(rows, "tf", "len")
    weight = F.col("x.weight") * F.col("boost")
    boosted = [x for x in found if x.boost_document is not None]
    if boosted:
        rows = index.with_docs(rows, "id", "stored")
        extra = F.lit(1.0)
        for x in boosted:
            extra = F.when(F.col("x.leaf") == x.index, x.boost_document(F.col("id"), F.col("term"), F.col("stored")).cast("double")).otherwise(extra)
        rows = rows.withColumn("extra", extra).where("extra IS NOT NULL AND extra <> 0 AND NOT isnan(extra)")
        weight = weight * F.col("extra")
    return rows.select("doc_ord", F.col("x.leaf").alias("leaf"), F.col("x.kind").alias("kind"), "term", "field_id", (weight * F.col("rank")).alias("w"))


def _as_met(index: TextIndex, rows: DataFrame, found: list[Leaf]) -> DataFrame:
    """Live ``rows(term, field_id, doc_ord, tf, m, xs)`` for each leaf ``x``, with the counts ``m`` that a search meets which
    takes stale occurrences out as it goes.

    Each leaf that reaches a term passes over its documents in order.  A pass takes one occurrence of every stale document:
    it starts from all stored ones less those with no occurrence left, and has one less after each stale one it meets.  Both
    are sums over blocks of documents, and over the places within a block, so no task sees all documents of a term.
    """
    ids = {name: i for i, name in enumerate(index.config.fields)}
    keys = ["term", "field_id", "turn"]
    searched = F.filter("xs", lambda x: field_boost(found, ids, x["leaf"], F.col("field_id")).isNotNull())
    rows = rows.join(index.docs.select("doc_ord", F.lit(True).alias("live")), "doc_ord", "left")
    rows = rows.select(*[c for c in rows.columns if c != "xs"], F.posexplode(searched).alias("turn", "x"), F.expr(f"doc_ord div {STALE_BLOCK}").alias("block"))
    stale, left = F.col("live").isNull(), F.col("tf") > F.col("turn")
    rows = rows.withColumns({"met": (stale & left).cast("int"), "spent": (stale & ~left).cast("int")})
    blocks = rows.groupBy(*keys, "block").agg(F.sum("met").alias("met"), F.sum("spent").alias("spent"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.select(*keys, "block", (F.coalesce(F.sum("met").over(before), F.lit(0)) + F.sum("spent").over(Window.partitionBy(*keys))).alias("less"))
    within_block = Window.partitionBy(*keys, "block").orderBy("doc_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("earlier", F.coalesce(F.sum("met").over(within_block), F.lit(0))).join(blocks, [*keys, "block"])
    return rows.where("live").withColumn("m", F.col("m") - F.col("less") - F.col("earlier")).drop("live", "met", "spent", "block", "less", "earlier", "turn")


def wildcards(index: TextIndex, found: list[Leaf]) -> list[DataFrame]:
    out = []
    for x in found:
        w = F.lit(1.0) if x.boost_document is None else x.boost_document(F.col("id"), F.lit(""), F.col("stored")).cast("double")
        out.append(index.docs.select("doc_ord", F.lit(x.index).alias("leaf"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("term"), F.lit(0).alias("field_id"), w.alias("w")))
    return out


class _Fold:
    """A node's presence, score, contributing leaves and deciding leaf, as Columns over one sum for each leaf.

    ``bound``: the sums are of a window's blocks, so the score bounds its documents' scores; what an AND_NOT takes away need
    not be in the same documents, and takes nothing.
    """

    def __init__(self, node: Node | Leaf, bound: bool = False):
        if isinstance(node, Leaf):
            self.score = F.col(f"s{node.index}")
            self.present = self.score.isNotNull()
            self.live = F.when(self.present, F.array(F.lit(node.index))).otherwise(_none())
            self.first = F.when(self.present, F.lit(node.index))
            return
        parts = [_Fold(c, bound) for c in node.children]
        if not parts:
            self.score, self.present, self.live, self.first = F.lit(None).cast("double"), F.lit(False), _none(), F.lit(None).cast("int")
        elif node.combine_with == "or":
            self.present = any_of([p.present for p in parts])
            self.score = F.when(self.present, sum((F.coalesce(p.score, F.lit(0.0)) for p in parts), F.lit(0.0)))
            self.live = F.concat(*[p.live for p in parts])
            self.first = F.coalesce(*[p.first for p in parts])
        elif node.combine_with == "and":
            self.present = ~any_of([~p.present for p in parts])
            self.score = F.when(self.present, sum((p.score for p in parts), F.lit(0.0)))
            self.live = F.when(self.present, F.concat(*[p.live for p in parts])).otherwise(_none())
            self.first = F.when(self.present, parts[-1].first)
        else:
            self.present = parts[0].present if bound else parts[0].present & ~any_of([p.present for p in parts[1:]])
            self.score = F.when(self.present, parts[0].score)
            self.live = F.when(self.present, parts[0].live).otherwise(_none())
            self.first = F.when(self.present, parts[0].first)


def _none() -> Column:
    return F.array().cast("array<int>")


def _words(found: list[Leaf]) -> Column:
    """The distinct query terms of the leaves that contribute to a row."""
    names = {x.index: x.term for x in found}
    words = F.array(*[F.lit(names.get(i)).cast("string") for i in range(len(found))])
    return F.array_distinct(F.filter(F.transform("live", lambda i: F.get(words, i)), lambda t: t.isNotNull()))


def prunable(index: TextIndex, found: list[Leaf], limit: int | None, keep: Any) -> bool:
    """Whether bounds hold: blocks are kept, nothing is discarded, and no weight is negative or unknown before a document is."""
    if index._blocks is None or not limit or limit > BROADCAST_ROWS or keep is not None or index.dirt_count:
        return False
    sound = lambda x: x.boost_document is None and x.term is not None and x.boost >= 0 and all(b >= 0 for _, b in x.fields) and min(x.weights.values()) >= 0 and min(x.bm25.values()) >= 0 and x.bm25["b"] <= 1
    return all(sound(x) for x in found)


def window_bounds(index: TextIndex, plan: Node, found: list[Leaf], matched: Matched) -> DataFrame:
    """(window, bound): the windows whose documents may match, and what their scores are at most."""
    blocks = matched.of(index._blocks).groupBy("term", "field_id", "window").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))  # segments may share a window
    rows = matched.weighed(blocks.join(matched.stats, ["term", "field_id"]), "max_tf", "min_len")
    w = F.col("x.weight") * F.col("boost") * F.col("rank")
    sums = rows.groupBy("window").agg(*[F.sum(F.when(F.col("x.leaf") == x.index, w)).alias(f"s{x.index}") for x in found])
    fold = _Fold(plan, bound=True)
    return sums.where(fold.present).withColumn("live", fold.live).select("window", (fold.score * F.greatest(F.size(_words(found)), F.lit(1))).alias("bound"))


def surviving_windows(index: TextIndex, plan: Node, found: list[Leaf], matched: Matched, limit: int) -> DataFrame:
    """(window, bound): the windows that may hold one of the ``limit`` best documents."""
    bounds = kept(window_bounds(index, plan, found, matched), "bounds")
    index._scratch.append(bounds)
    rows = _per_document(plan, found, [contributions(index, found, matched=matched, windows=promising(bounds, limit))], False)
    best = rows.select("score").orderBy(F.col("score").desc()).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("low")).first()
    return bounds.where(F.col("bound") >= best["low"] * SLACK) if best["n"] == limit else bounds


def _per_document(plan: Node, found: list[Leaf], parts: list[DataFrame], details: bool) -> DataFrame:
    """(doc_ord, score, leaf, rank, live, words, hits) of the documents that match."""
    fold = _Fold(plan)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums, firsts = [], []
    order = F.struct("kind", F.col("term").alias("t"), "field_id")
    for x in found:
        mine = F.col("leaf") == x.index
        sums.append(F.sum(F.when(mine, F.col("w"))).alias(f"s{x.index}"))
        firsts.append(F.min(F.when(mine, order)).alias(f"r{x.index}"))
    hits = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("leaf", "kind", "term", "field_id"))).alias("hits")
    docs = rows.groupBy("doc_ord").agg(*sums, *firsts, *([hits] if details else []))
    deciding = F.coalesce(*[F.when(fold.first == x.index, F.col(f"r{x.index}")) for x in found])
    docs = docs.where(fold.present).withColumn("live", fold.live)
    quality = F.greatest(F.size(_words(found)), F.lit(1))
    shown = ["doc_ord", (fold.score * quality).alias("score"), fold.first.alias("leaf"), deciding.alias("rank")]
    return docs.select(*shown, *(["live", _words(found).alias("query_terms"), "hits"] if details else []))


def search(index: TextIndex, query: Any, *, details: bool = True, sort: bool = True, limit: int | None = None, df_mode: str = "live", **options: Any) -> DataFrame:
    """Documents that match: id, score, terms, query_terms, match, and the stored fields.

    With a ``limit``, on an index that keeps blocks (``with_blocks``, or one read from disk), postings of windows that cannot
    hold one of the best documents are not ranked; the result is the same.

    ``details=False`` leaves terms, query_terms and match out and spares collecting them.  Ties keep the order of
    arrival: by the deciding leaf, exact before prefix before fuzzy, term, field, then document.  A result filter sees
    the finished row.
    """
    c = index.config
    resolver = Resolver(c.fields, c.analyzer, c.search_options)
    plan = resolver.resolve(query, options)
    found = leaves(plan)
    if index.docs is None or not found:
        return _empty(index, details)
    terms, stars = [x for x in found if x.term is not None], [x for x in found if x.term is None]
    keep = options.get("filter", c.search_options.get("filter"))
    matched = Matched(index, terms) if terms else None
    windows = surviving_windows(index, plan, found, matched, limit) if prunable(index, found, limit, keep) else None
    parts = ([contributions(index, terms, df_mode, matched, windows)] if terms else []) + wildcards(index, stars)
    out = _per_document(plan, found, parts, details)
    if details:
        hit = F.array_sort(F.filter("hits", lambda h: F.array_contains(F.col("live"), h["leaf"])))
        out = out.withColumn("hits", hit).withColumn("terms", F.array_distinct(F.transform("hits", lambda h: h["term"]))).select("doc_ord", "score", "leaf", "rank", "terms", "query_terms", "hits")
    if details:
        fields = F.array(*[F.lit(f) for f in c.fields])
        # of a term that several operands matched, the last one's fields show
        last = lambda t: F.array_max(F.transform(F.filter("hits", lambda h: h["term"] == t), lambda h: h["leaf"]))
        of = lambda t: F.transform(F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: (h["term"] == t) & (h["leaf"] == last(t))), lambda h: h["field_id"]))), lambda i: F.get(fields, i))
        out = out.withColumn("match", F.map_from_arrays("terms", F.transform("terms", of))).drop("hits")
    ordered = [F.col("score").desc(), F.col("leaf"), F.col("rank"), F.col("doc_ord")]
    if len(found) == 1 and stars and stars[0].boost_document is None:
        ordered = [F.col("doc_ord")]
    if limit is not None and keep is None:
        out = out.orderBy(*ordered).limit(limit)  # stored fields of the best rows only
        out = F.broadcast(out) if limit <= BROADCAST_ROWS else out
    joined = index.with_docs(out, "id", "stored")
    stored = [F.col(f"stored.{s}").alias(s) for s in c.store_fields if s != "id"]
    columns = ["id", "score", *(["terms", "query_terms", "match"] if details else []), *stored]
    if keep is not None:
        # the predicate is over the shown columns; what orders the rows stays beside them
        joined = joined.select(*columns, F.struct("doc_ord", "leaf", "rank").alias("_order")).where(keep).withColumns({k: F.col(f"_order.{k}") for k in ("doc_ord", "leaf", "rank")})
        columns = ["id", "score", *(["terms", "query_terms", "match"] if details else []), *[s for s in c.store_fields if s != "id"]]
    if sort or limit is not None:
        joined = joined.orderBy(*ordered)
    return (joined.limit(limit) if limit is not None else joined).select(*columns)


def _empty(index: TextIndex, details: bool) -> DataFrame:
    if index.docs is None:
        return index.spark.createDataFrame([], "id string, score double" + (", terms array<string>, query_terms array<string>, match map<string,array<string>>" if details else ""))
    extra = [F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("query_terms"), F.create_map().cast("map<string,array<string>>").alias("match")] if details else []
    return index.docs.where(F.lit(False)).select("id", F.lit(0.0).alias("score"), *extra, *[F.col(f"stored.{s}").alias(s) for s in index.config.store_fields if s != "id"])


def auto_suggest(index: TextIndex, query: str, *, limit: int | None = None, df_mode: str = "live", **options: Any) -> DataFrame:
    """Phrases that complete a query: (suggestion, terms, score), the mean score of the documents that hold the phrase."""
    settled = {**index.config.auto_suggest_options, **options}
    rows = search(index, query, sort=False, df_mode=df_mode, **settled)
    phrase = F.array_join("terms", " ")
    out = rows.groupBy(phrase.alias("suggestion")).agg(F.first("terms").alias("terms"), F.avg("score").alias("score")).where("suggestion <> ''")
    out = out.orderBy(F.col("score").desc(), "suggestion")
    return out.limit(limit) if limit is not None else out


def near_terms(wanted: DataFrame, lexicon: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """(asked, term, d) for the lexicon's terms within ``k`` edits, d > 0, of each of ``wanted(asked, k)``; equality joins only.

    Short terms with one or two edits meet by a string that both give after as many deletions; the lexicon side is read from
    ``neighbours`` where they are kept, else made for the lengths asked for.  Otherwise an asked term is cut into ``k + 1`` segments, one of which stands in every term within
    ``k`` edits unchanged and at most ``k`` places away: terms meet by length, segment and place.
    """
    size = F.length("asked")
    by_deletion = (F.col("k") <= DELETIONS) & (size <= LONGEST)
    pairs = []
    for n in range(1, DELETIONS + 1):
        left = wanted.where(by_deletion & (F.col("k") == n))
        cut = left.withColumn("cut", F.explode(deletions(F.col("asked"), n)))
        if neighbours is not None:
            right = neighbours.where(F.col("times") <= n).select("term", "cut")
        else:
            lengths = left.select(F.explode(F.sequence(F.greatest(size - n, F.lit(0)), size + n)).alias("n")).distinct()
            right = lexicon.select("term", F.length("term").alias("n")).where(F.col("n") <= LONGEST + n).join(lengths, "n", "left_semi").select("term", F.explode(deletions(F.col("term"), n)).alias("cut"))
        pairs.append(cut.join(right, "cut").select("asked", "term", "k"))
    # segment i of k + 1: characters from 1 + i * size div (k + 1) up to the next one's first
    far = wanted.where(~by_deletion)
    first = lambda i: F.expr(f"CAST(1 + ({i}) * length(asked) div (k + 1) AS INT)")
    cut = far.select("asked", "k", F.posexplode(F.sequence(F.lit(0), F.col("k")))).drop("col").withColumnRenamed("pos", "i")
    cut = cut.withColumns({"at": first("i"), "width": first("i + 1") - first("i")}).withColumn("piece", F.expr("substring(asked, at, width)"))
    cut = cut.withColumn("n", F.explode(F.sequence(F.greatest(size - F.col("k"), F.lit(0)), size + F.col("k"))))
    shapes = cut.select("n", "at", "width", "k").distinct()
    place = F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("k")), F.least(F.col("at") + F.col("k"), F.greatest(F.lit(1), F.col("n") - F.col("width") + 1))))
    pieces = lexicon.select("term", F.length("term").alias("n")).join(shapes, "n").withColumn("place", place).where("place + width <= n + 1 OR width = 0")
    pieces = pieces.select("term", "n", "at", "width", "k", F.expr("substring(term, place, width)").alias("piece")).distinct()
    pairs.append(cut.join(pieces, ["n", "at", "width", "k", "piece"]).select("asked", "term", "k"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("d", F.expr("levenshtein(asked, term, k)")).where("d > 0").select("asked", "term", "d")


def expand_batch(asked: DataFrame, lexicon: DataFrame, prefix: bool, fuzzy: float, weights: dict[str, float], max_fuzzy: int = 6, neighbours: DataFrame | None = None) -> DataFrame:
    """(asked, term, weight): the lexicon's terms that each of ``asked(asked)`` means; equality joins only."""
    size, own = F.length("term").cast("double"), F.length("asked").cast("double")
    parts = [asked.join(lexicon.select("term"), F.col("asked") == F.col("term")).select("asked", "term", F.lit(1.0).alias("weight"))]
    if prefix:
        # a term meets the asked ones by its beginnings, of the lengths that are asked for
        lengths = asked.select(F.length("asked").alias("n")).distinct()
        longest = asked.agg(F.max(F.length("asked"))).first()[0] or 0
        heads = lexicon.select("term", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("term") - 1, F.lit(longest))))).alias("n")).where("n < length(term)")
        heads = heads.join(F.broadcast(lengths), "n", "left_semi").select("term", F.expr("substring(term, 1, n)").alias("asked"))
        parts.append(heads.join(asked, "asked").select("asked", "term", (F.lit(float(weights["prefix"])) * size / (size + F.lit(0.3) * (size - own))).alias("weight")))
    if fuzzy:
        k = F.least(F.lit(max_fuzzy), F.floor(F.length("asked") * F.lit(float(fuzzy)) + 0.5)).cast("int") if fuzzy < 1 else F.lit(int(fuzzy))
        pairs = near_terms(asked.withColumn("k", k).where("k > 0"), lexicon, neighbours)
        if prefix:
            pairs = pairs.where(~F.col("term").startswith(F.col("asked")))
        parts.append(pairs.select("asked", "term", (F.lit(float(weights["fuzzy"])) * size / (size + F.col("d"))).alias("weight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_batch(index: TextIndex, queries: DataFrame, query_id: str = "query_id", text: str = "text", k: int | None = 10, combine_with: str = "OR", bm25_options: dict | None = None, prefix: bool = False, fuzzy: float | bool = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """A whole DataFrame of queries in one plan: (query_id, id, score, rank), the best ``k`` of each.

    Query terms are analysed by the document analyzer and met with the postings by one equi-join on the term, after
    prefix and fuzzy terms were expanded over the lexicon.  The expansion is evaluated once, and queries of the same terms are
    ranked once.  With a ``k``, on an index that
    keeps blocks, a query meets only the windows of documents that may hold one of its best.
    """
    how = combinator(combine_with)
    if how == "and_not":
        raise SearchError("a batch combines with AND or OR")
    c, b = index.config, {**BM25, **(bm25_options or {})}
    tokens = c.analyzer.tokenize_column(F.col(text), c.fields[0])
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(c.analyzer.terms_column(tokens, c.fields[0])).alias("asked"))
    asked = asked.groupBy("query_id", "asked").agg(F.count("*").alias("times"))
    asked, sharers, n = _shared(index, asked)
    need = asked.groupBy("query_id").agg(F.count("*").alias("need"))
    postings = index.postings
    if index.dirt_count:
        postings = postings.join(index.docs.select("doc_ord"), "doc_ord", "left_semi")
    words = asked.select("asked").distinct()
    if prefix or fuzzy:
        means_of = expand_batch(words, index.lexicon(), prefix, FUZZY_SHARE if fuzzy is True else float(fuzzy), {**WEIGHTS, **(weights or {})}, neighbours=index._neighbours)
        means_of = kept(means_of, "expanded")
    else:
        means_of = words.select("asked", F.col("asked").alias("term"), F.lit(1.0).alias("weight"))
    met = means_of.select("term").distinct()
    some = [r["term"] for r in met.limit(LITERALS + 1).collect()]
    few = len(some) <= LITERALS
    small = few or met.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    # terms reach the scans as literals, or are sent to the postings, which are not moved for them
    held = lambda rows: rows.where(F.col("term").isin(some)) if few else rows.join(F.broadcast(met) if small else met, "term", "left_semi")
    if index.dirt_count:
        postings = held(postings)
        counts = postings.groupBy("term", "field_id").agg(F.count("*").cast("double").alias("m"))
    else:
        postings = held(postings) if few else postings
        counts = held(index.terms).select("term", "field_id", F.col("df").cast("double").alias("m"))
    counts = F.broadcast(counts) if small else counts
    means = F.create_map(*[F.lit(y) for f, mean in index.means.items() for y in (f, float(mean))])
    rank = lambda tf, length: bm25(F.col(tf).cast("double"), index.document_count, F.col("m"), F.col(length).cast("double"), F.element_at(means, F.col("field_id")), F.lit(float(b["k"])), F.lit(float(b["b"])), F.lit(float(b["d"])))
    expanded = bool(prefix or fuzzy)

    def summed(rows: DataFrame, w: Column, unit: str) -> DataFrame:
        """(asked, unit, w): the weights of ``rows(term, field_id, unit, ...)`` by query term; terms meet no queries yet."""
        per_term = rows.join(counts, ["term", "field_id"]).groupBy("term", unit).agg(F.sum(w).alias("w"))
        if not expanded:
            return per_term.withColumnRenamed("term", "asked")
        return per_term.join(means_of, "term").groupBy("asked", unit).agg(F.sum(F.col("w") * F.col("weight")).alias("w"))

    def weighed(rows: DataFrame, w: Column, unit: str) -> DataFrame:
        """(asked, doc_ord, w) of the same, not added up: ``unit`` stands for the document."""
        rows = rows.join(counts, ["term", "field_id"]).withColumn("w", w)
        rows = rows.join(F.broadcast(means_of) if small else means_of, "term").withColumn("w", F.col("w") * F.col("weight")) if expanded else rows.withColumnRenamed("term", "asked")
        return rows.select("asked", F.col(unit).alias("doc_ord"), "w")

    def scored(rows: DataFrame, *unit: str) -> DataFrame:
        """(query_id, unit, score) of ``rows(query_id, times, unit, w)``."""
        rows = rows.groupBy("query_id", *unit).agg(F.sum(F.col("w") * F.col("times")).alias("w"), F.count("*").alias("met"))
        if how == "and":
            rows = rows.join(need, "query_id").where("met = need")
        return rows.select("query_id", *unit, (F.col("w") * F.greatest(F.col("met"), F.lit(1))).alias("score"))

    def to_each(rows: DataFrame) -> DataFrame:
        """(query_id, id, score, rank) of every query from the ``rows`` of those that were ranked."""
        few_rows = k is not None and n * k <= BROADCAST_ROWS
        rows = F.broadcast(rows).join(index.docs.select("doc_ord", "id"), "doc_ord") if few_rows else index.with_docs(rows, "id")
        rows = rows.select(F.col("query_id").alias("group"), "id", "score", "rank")
        return rows.join(sharers, "group").select("query_id", "id", "score", "rank")

    # sums of doubles depend on the order of addition, so scores that agree to nine places are ties
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_ord")
    if index.buckets is not None and not index.dirt_count:
        rows = _by_buckets(index, asked, means_of, rank("tf", "len"), lambda rows: scored(rows, "doc_ord"), expanded, k, how == "and").withColumn("rank", F.row_number().over(best))
        rows = rows.where(F.col("rank") <= k) if k is not None else rows
        return to_each(rows)
    sound = min(b.values()) >= 0 and b["b"] <= 1 and min({**WEIGHTS, **(weights or {})}.values()) >= 0
    if k is None or index._blocks is None or index.dirt_count or not sound:
        rows = None
        if k is not None:
            sent_pairs = sent_terms(asked)
            rows = best_in_windows(weighed(postings, rank("tf", "len"), "doc_ord"), sent_pairs, k, how == "and") if sent_pairs is not None else None
        if rows is None:
            rows = scored(summed(postings, rank("tf", "len"), "doc_ord").join(asked, "asked"), "doc_ord")
    else:
        # only blocks of the terms that are asked for are put together
        blocks = held(index._blocks).groupBy("term", "field_id", "window").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        sent_pairs = sent_terms(asked)
        if sent_pairs is not None:
            rows = _by_windows(index, weighed, rank, blocks, postings, asked, sent_pairs, means_of if expanded else None, k, how == "and", best)
        else:
            rows = _by_pairs(index, summed, scored, rank, blocks, postings, asked, means_of if expanded else None, k, best)
    rows = rows.withColumn("rank", F.row_number().over(best))
    if k is not None:
        rows = rows.where(F.col("rank") <= k)
    return to_each(rows)


def _by_windows(index: TextIndex, weighed: Callable, rank: Callable, blocks: DataFrame, postings: DataFrame, asked: DataFrame, pairs: list, means_of: DataFrame | None, k: int, every: bool, best: Any) -> DataFrame:
    """(query_id, doc_ord, score): the best of each query by bounds of blocks, without rows for pairs of queries and documents.

    The most promising blocks are ranked first, then those whose bound reaches the k-th score there, less the ones ranked already.
    """
    bits = topk.WINDOW.bit_length() - 1
    # as many blocks lie in a group as make one window of documents
    bounds = best_in_windows(weighed(blocks, rank("max_tf", "min_len"), "window"), pairs, None, every, max(batch.WINDOW_BITS - bits, 0))
    bounds = kept(bounds.select("query_id", F.col("doc_ord").alias("window"), F.col("score").alias("bound")), "bounds")
    index._scratch.append(bounds)

    def exact(chosen: DataFrame, tag: str) -> DataFrame:
        """The best documents of each query in its blocks ``chosen(query_id, window)``; postings of other blocks are left out beforehand."""
        chosen = kept(chosen.select("query_id", F.col("window").alias("block")), tag)
        index._scratch.append(chosen)
        needed = asked.select("query_id", F.col("asked").alias("term")) if means_of is None else asked.join(means_of, "asked").select("query_id", "term")
        rows = postings.withColumn("block", window_of(F.col("doc_ord")))
        cells = chosen.join(needed.distinct(), "query_id").select("term", "block").distinct()
        # a query has few promising blocks; where most blocks stay, their numbers alone are sent
        if chosen.limit(BROADCAST_WINDOWS // 32 + 1).count() <= BROADCAST_WINDOWS // 32 and cells.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            rows = rows.join(F.broadcast(cells), ["term", "block"], "left_semi")
        else:
            blocks = chosen.select("block").distinct()
            rows = rows.join(F.broadcast(blocks) if blocks.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS else blocks, "block", "left_semi")
        return best_in_windows(weighed(rows, rank("tf", "len"), "doc_ord"), pairs, k, every, max(batch.WINDOW_BITS, bits), chosen, bits)

    likely = promising_of_each(bounds, k)
    first = kept(exact(likely, "likely"), "first")
    index._scratch.append(first)
    low = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("low"))  # a row for each query that has k documents there
    rest = bounds.join(low, "query_id", "left").where((F.col("bound") >= F.col("low") * SLACK - 1e-8) | F.col("low").isNull())
    rest = rest.select("query_id", "window").join(likely.select("query_id", "window"), ["query_id", "window"], "left_anti")
    return first.unionByName(exact(rest, "rest"))


def _by_pairs(index: TextIndex, summed: Callable, scored: Callable, rank: Callable, blocks: DataFrame, postings: DataFrame, asked: DataFrame, means_of: DataFrame | None, k: int, best: Any) -> DataFrame:
    """The same by joins, for more terms of queries than are sent to the tasks."""
    bounds = scored(summed(blocks, rank("max_tf", "min_len"), "window").join(asked, "asked"), "window").withColumnRenamed("score", "bound")
    bounds = kept(bounds, "bounds")
    index._scratch.append(bounds)

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores of the documents of each query's windows; postings that no query needs there are not weighed."""
        wanted = asked.join(pairs.select("query_id", "window"), "query_id")
        terms = wanted.select("asked", "window").distinct()
        terms = (terms.join(means_of, "asked").select("term", "window").distinct() if means_of is not None else terms.withColumnRenamed("asked", "term"))
        placed = postings.withColumn("window", window_of(F.col("doc_ord"))).join(terms, ["term", "window"], "left_semi")
        rows = summed(placed, rank("tf", "len"), "doc_ord").withColumn("window", window_of(F.col("doc_ord")))
        return scored(rows.join(wanted, ["asked", "window"]), "doc_ord")

    first = exact(promising_of_each(bounds, k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    low = first.select("query_id", F.col("score").alias("low"))  # a row for each query that has k documents there
    return exact(bounds.join(low, "query_id", "left").where((F.col("bound") >= F.col("low") * SLACK - 1e-8) | F.col("low").isNull()))


def _shared(index: TextIndex, asked: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``asked(query_id, asked, times)`` with one query for each set of terms, (group, query_id) of all that share it, and how many
    sets there are, counted to ``BROADCAST_ROWS`` and one more.

    Queries of the same terms have the same answers, so one of them is ranked and its best rows go to each.
    """
    bags = kept(asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("asked", "times"))).alias("terms")), "bags")
    groups = kept(bags.select("terms").distinct().select("terms", F.monotonically_increasing_id().alias("group")), "groups")
    index._scratch += [bags, groups]
    n = groups.limit(BROADCAST_ROWS + 1).count()
    sharers = bags.join(F.broadcast(groups) if n <= BROADCAST_ROWS else groups, "terms").select("group", "query_id")
    return groups.select(F.col("group").alias("query_id"), F.explode("terms").alias("term")).select("query_id", "term.asked", "term.times"), sharers, n


def _by_buckets(index: TextIndex, asked: DataFrame, means_of: DataFrame, rank: Column, scored: Callable[[DataFrame], DataFrame], expanded: bool, k: int | None, every: bool) -> DataFrame:
    """Scores from buckets: terms that are asked for are sent to the buckets of counts, and those meet their postings in place."""
    postings, counts = index.buckets
    terms = asked.join(means_of, "asked") if expanded else asked.select("*", F.col("asked").alias("term"), F.lit(1.0).alias("weight"))
    small = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    words = terms.select("term").distinct()
    counts = counts.join(F.broadcast(words) if small else words, "term", "left_semi")
    met = postings.join(counts.hint("merge"), ["term", "part"]).withColumn("m", F.element_at("counts", F.col("field_id")).cast("double"))
    if k is not None:
        weights = met.withColumn("w", rank).drop("part")
        weights = weights.join(F.broadcast(means_of) if small else means_of, "term").withColumn("w", F.col("w") * F.col("weight")) if expanded else weights.withColumnRenamed("term", "asked")
        pairs = sent_terms(asked)
        if pairs is not None:
            return best_in_windows(weights.select("asked", "doc_ord", "w"), pairs, k, every)
    per_term = met.groupBy("term", "part", "doc_ord").agg(F.sum(rank).alias("w"))
    rows = per_term.join(F.broadcast(terms) if small else terms, "term").withColumn("w", F.col("w") * F.col("weight"))
    if expanded:
        rows = rows.groupBy("query_id", "asked", "times", "doc_ord").agg(F.sum("w").alias("w"))
    return scored(rows)
