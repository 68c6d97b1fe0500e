"""SQL of the catalog's queries, for DuckDB on the same tables.

``ranked`` writes the ranking from the tables up: tokens, lengths, postings, expansion, scores; each query states its leaves
and how they combine.
"""

from __future__ import annotations

from lodestone.functions.analysis import SEPARATORS

#: Letters beyond ASCII in the tables, and stand-ins: the SQL engine's edit distance counts bytes.
LETTERS, STAND_INS = "ßäçèéêíñóöü", "ABCDEFGHIJK"


def _folded(x: str) -> str:
    return f"translate({x}, '{LETTERS}', '{STAND_INS}')"


def tokens(x: str) -> str:
    return f"regexp_split_to_array({x}, '{SEPARATORS}')"


def base(source: str, ident: str, fields: list[str], toks=tokens, terms: str = "lower(unnest(toks))", where: str = "true", gone: str = "false") -> str:
    """CTEs src, fl, lens, avgs, post, n of an index over ``source`` without the rows ``gone``."""
    each = " UNION ALL ".join(f"SELECT id, {i} AS f, {toks(f'f{i}')} AS toks FROM src WHERE f{i} IS NOT NULL" for i in range(len(fields)))
    names = ", ".join(f"{name} AS f{i}" for i, name in enumerate(fields))
    return f"""src AS (SELECT {ident} AS id, {names} FROM {source} WHERE {where} AND NOT ({gone})),
fl AS ({each}),
lens AS (SELECT id, f, len(list_distinct(toks)) AS len FROM fl),
avgs AS (SELECT f, avg(len) AS avg_len FROM lens GROUP BY f),
post AS (SELECT term, f, id, count(*) AS tf FROM (SELECT id, f, {terms} AS term FROM fl) WHERE term <> '' GROUP BY term, f, id),
n AS (SELECT count(*)::double AS n FROM src)"""


def leaf(i: int, term: str, prefix: bool = False, k: int = 0, wp: float = 0.375, wf: float = 0.45, boost: float = 1.0) -> str:
    """Rows (leaf, q, term, weight) of a query term."""
    q, size = f"'{term}'", "length(term)::double"
    whens = [f"WHEN term = {q} THEN 1.0::double"]
    if prefix:
        whens.append(f"WHEN starts_with(term, {q}) THEN {wp}::double * {size} / ({size} + 0.3::double * ({size} - {len(term)}))")
    if k:
        lev = f"levenshtein({_folded('term')}, {_folded(q)})"
        whens.append(f"WHEN abs(length(term) - {len(term)}) <= {k} AND {lev} <= {k} THEN {wf}::double * {size} / ({size} + {lev})")
    return f"SELECT {i} AS leaf, {q} AS q, term, {boost}::double * CASE {' '.join(whens)} END AS weight FROM (SELECT DISTINCT term FROM post)"


def hits(leaves: list[str], bm25=(1.2, 0.7, 0.5), boosts: dict[int, float] | None = None, fields: list[int] | None = None, document: str = "1.0::double") -> str:
    """CTEs expanded, hit(id, leaf, q, term, f, w), leafed(id, leaf, q, s)."""
    k, b, d = (f"{x}::double" for x in bm25)
    field = "1.0::double" if not boosts else "CASE f " + " ".join(f"WHEN {f} THEN {x}::double" for f, x in boosts.items()) + " ELSE 1.0::double END"
    only = "true" if fields is None else f"f IN ({', '.join(map(str, fields))})"
    return f"""expanded AS (SELECT * FROM ({' UNION ALL '.join(leaves)}) WHERE weight IS NOT NULL),
dfs AS (SELECT term, f, count(*)::double AS m FROM post GROUP BY term, f),
hit AS (SELECT p.id, e.leaf, e.q, p.term, p.f, e.weight * {field} * {document} * ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * ({d} + tf * ({k} + 1) / (tf + {k} * (1 - {b} + {b} * l.len / avg_len))) AS w
  FROM expanded e JOIN post p USING (term) JOIN dfs USING (term, f) JOIN lens l USING (id, f) JOIN avgs USING (f) CROSS JOIN n WHERE {only}),
leafed AS (SELECT id, leaf, q, sum(w) AS s FROM hit WHERE w IS NOT NULL GROUP BY id, leaf, q)"""


DOCS = base("documents", "doc_id", ["text"])
PARTS = base("part", "p_partkey", ["p_name", "p_brand", "p_type"])
NAMES = lambda **o: base("part", "p_partkey", ["p_name"], **o)


def ranked(over: str, leaves: list[str], ident: str = "doc_id", having: str = "true", **options) -> str:
    return f"WITH {over}, {hits(leaves, **options)} SELECT id AS {ident}, round(sum(s) * count(DISTINCT q), 6) AS score FROM leafed GROUP BY id HAVING {having}"


def _exact(*terms: str) -> list[str]:
    return [leaf(i, t) for i, t in enumerate(terms)]


_LANGS = "(CASE (SELECT lang FROM documents d WHERE d.doc_id = p.id) WHEN 'en' THEN 2.0 WHEN 'fr' THEN 0.5 END)::double"

SQL: dict[str, str] = {
    "tokenize_default": f"SELECT doc_id, len({tokens('text')}) AS n_tokens, md5(array_to_string({tokens('text')}, chr(31))) AS tokens_md5 FROM documents",
    "token_counts": f"WITH {DOCS} SELECT term, sum(tf)::bigint AS occurrences, count(*) AS documents FROM post GROUP BY term",
    "field_lengths": f"WITH {PARTS} SELECT id AS p_partkey, f AS field_id, len FROM lens",
    "postings_build": f"WITH {DOCS} SELECT term, id AS doc_id, tf, len FROM post JOIN lens USING (id, f)",
    "lexicon": f"WITH {DOCS} SELECT DISTINCT term, length(term) AS term_len FROM post",
    "term_df": f"WITH {PARTS} SELECT term, f AS field_id, count(*) AS documents FROM post GROUP BY term, f",
    "avg_field_length": f"WITH {PARTS} SELECT f AS field_id, round(avg_len, 9) AS avg_len FROM avgs",
    "index_counters": f"WITH {DOCS} SELECT (SELECT count(*) FROM src) AS document_count, (SELECT count(DISTINCT term) FROM post) AS term_count, 0::bigint AS dirt_count, 0.0::double AS dirt_factor",
    "search_exact_or": ranked(DOCS, _exact("the", "nation", "erst")),
    "search_duplicate_terms": ranked(DOCS, _exact("erst", "the", "erst")),
    "search_and": ranked(DOCS, _exact("the", "of", "and"), having="count(DISTINCT leaf) = 3"),
    "search_and_not": ranked(DOCS, _exact("the", "nation", "erst"), having="count(DISTINCT leaf) = 1 AND min(leaf) = 0"),
    "search_tree": f"""WITH {DOCS}, {hits(_exact('the', 'of', 'der', 'und', 'erst'))},
per AS (SELECT id, leaf, q, s, count(*) FILTER (leaf IN (0, 1)) OVER (PARTITION BY id) AS a, count(*) FILTER (leaf IN (2, 3)) OVER (PARTITION BY id) AS b FROM leafed)
SELECT id AS doc_id, round(sum(s) * count(DISTINCT q), 6) AS score FROM per WHERE (leaf IN (0, 1) AND a = 2) OR (leaf IN (2, 3) AND b = 2) OR leaf = 4 GROUP BY id""",
    "search_multifield": ranked(PARTS, _exact("red", "ring", "economy", "brand"), "p_partkey"),
    "search_boost": ranked(PARTS, _exact("red", "economy"), "p_partkey", boosts={0: 3, 2: 0.5}),
    "search_fields": ranked(PARTS, _exact("red", "economy", "small"), "p_partkey", fields=[2]),
    "search_prefix": ranked(DOCS, [leaf(0, "thati", True), leaf(1, "erst", True)]),
    "search_fuzzy": ranked(DOCS, [leaf(0, "nation", k=1), leaf(1, "thand", k=1)]),
    "search_prefix_fuzzy": ranked(DOCS, [leaf(0, "erst", True, 1), leaf(1, "thand", True, 1), leaf(2, "whouther", True, 2)]),
    "search_fuzzy_two": ranked(DOCS, [leaf(0, "erstha", k=2)]),
    "search_bm25_params": ranked(DOCS, _exact("the", "nation", "erst"), bm25=(2.0, 0.3, 0.1)),
    "search_weights": ranked(DOCS, [leaf(0, "erst", True, 1, 0.9, 0.1), leaf(1, "thand", True, 1, 0.9, 0.1)]),
    "search_filter": f"SELECT r.doc_id, r.score, lang FROM ({ranked(DOCS, _exact('the', 'nation'))}) r JOIN documents d ON r.doc_id = d.doc_id WHERE lang = 'en' AND r.score > 1",
    "search_boost_document": ranked(DOCS, _exact("de", "the"), document=_LANGS),
    "search_boost_term": ranked(DOCS, [leaf(0, "the"), leaf(1, "erst", boost=3)]),
    "search_wildcard": "SELECT doc_id, 1.0::double AS score, lang FROM documents",
    "wildcard_and_not": f"WITH {DOCS} SELECT id AS doc_id, 1.0::double AS score FROM src WHERE id NOT IN (SELECT id FROM post WHERE term = 'the')",
    "search_topk": f"SELECT doc_id, score FROM ({ranked(DOCS, _exact('the', 'of', 'and')).replace('round(sum(s) * count(DISTINCT q), 6) AS score', 'round(sum(s) * count(DISTINCT q), 6) AS score, sum(s) * count(DISTINCT q) AS exact, min(leaf) AS first')}) ORDER BY exact DESC, first, doc_id LIMIT 20",
    "search_batch": f"""WITH {DOCS}, dfs AS (SELECT term, f, count(*)::double AS m FROM post GROUP BY term, f),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, lower(unnest({tokens('text')})) AS term FROM benchmark) WHERE term <> '' GROUP BY item_id, term),
per AS (SELECT item_id, id, sum(times * ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * len / avg_len)))) * count(*) AS score
  FROM asked JOIN post USING (term) JOIN dfs USING (term, f) JOIN lens USING (id, f) JOIN avgs USING (f) CROSS JOIN n GROUP BY item_id, id),
placed AS (SELECT item_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS rank FROM per)
SELECT item_id, id AS doc_id, round(score, 6) AS score, rank FROM placed WHERE rank <= 5""",
    "match_terms": f"""WITH {PARTS}, {hits([leaf(0, 're', True, 1), leaf(1, 'go', True, 1), leaf(2, 'economy', True, 1)])},
top AS (SELECT id, term, max(leaf) AS leaf FROM hit GROUP BY id, term),
names AS (SELECT id, string_agg(DISTINCT term || ':' || CASE f WHEN 0 THEN 'p_name' WHEN 1 THEN 'p_brand' ELSE 'p_type' END, ',' ORDER BY term || ':' || CASE f WHEN 0 THEN 'p_name' WHEN 1 THEN 'p_brand' ELSE 'p_type' END) AS matches FROM hit JOIN top USING (id, term, leaf) GROUP BY id),
words AS (SELECT id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, string_agg(DISTINCT q, ',' ORDER BY q) AS query_terms FROM hit GROUP BY id)
SELECT id AS p_partkey, round(sum(s) * count(DISTINCT q), 6) AS score, any_value(terms) AS terms, any_value(query_terms) AS query_terms, any_value(matches) AS matches FROM leafed JOIN words USING (id) JOIN names USING (id) GROUP BY id""",
    "suggest_prefix": f"""WITH {PARTS}, {hits([leaf(0, 'red'), leaf(1, 'w', True)], fields=[0])},
per AS (SELECT id, sum(s) * count(DISTINCT q) AS score FROM leafed GROUP BY id HAVING count(DISTINCT leaf) = 2),
phrases AS (SELECT id, string_agg(term, ' ' ORDER BY leaf, term) AS suggestion FROM (SELECT DISTINCT id, leaf, term FROM hit) GROUP BY id)
SELECT suggestion, round(avg(score), 6) AS score FROM per JOIN phrases USING (id) GROUP BY suggestion""",
    "stopwords": ranked(NAMES(terms="unnest(list_filter(list_transform(toks, lambda t: lower(t)), lambda t: t NOT IN ('red', 'blue', 'old')))"), _exact("ring"), "p_partkey"),
    "synonyms": ranked(NAMES(terms="unnest(list_concat(list_transform(toks, lambda t: lower(t)), list_transform(list_filter(toks, lambda t: t = 'ring'), lambda t: 'circle')))"), _exact("circle"), "p_partkey"),
    "hash_tokenizer": ranked(base("part", "p_partkey", ["p_brand"], toks=lambda x: f"string_split({x}, '#')"), _exact("brand", "7"), "p_partkey"),
    "nullable_field_mean": f"""WITH RECURSIVE {base('(SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS p_name, p_type FROM part)', 'p_partkey', ['p_name', 'p_type'])},
placed AS (SELECT f, row_number() OVER (PARTITION BY f ORDER BY id) AS j, len FROM (SELECT s.id, x.f, len FROM src s CROSS JOIN (SELECT DISTINCT f FROM lens) x LEFT JOIN lens l ON l.id = s.id AND l.f = x.f)),
run AS (SELECT f, 0::bigint AS j, 0.0::double AS mean FROM (SELECT DISTINCT f FROM lens) UNION ALL
  SELECT run.f, run.j + 1, CASE WHEN len IS NULL THEN mean ELSE (mean * run.j + len) / (run.j + 1) END FROM run JOIN placed ON placed.f = run.f AND placed.j = run.j + 1)
SELECT f AS field_id, round(mean, 9) AS avg_len FROM run WHERE j = (SELECT count(*) FROM src)""",
    "discard_search": ranked(NAMES(gone="p_partkey < 50"), _exact("red", "ring"), "p_partkey"),
    "vacuum_stats": f"WITH {NAMES()} SELECT (SELECT count(*) FROM post) AS postings_before, 50::bigint AS dirt_count, round(50 / (1 + count(*))::double, 9) AS dirt_factor, (SELECT count(*) FROM post WHERE id >= 50) AS postings_after, 0::bigint AS dirt_after, count(*) - 50 AS document_count FROM src",
    "replace_search": ranked(base("(SELECT p_partkey, CASE WHEN p_partkey = 3 THEN 'red unicorn' ELSE p_name END AS p_name FROM part)", "p_partkey", ["p_name"]), _exact("unicorn", "red"), "p_partkey"),
    "remove_search": ranked(NAMES(gone="p_partkey < 30"), _exact("hot", "anvil"), "p_partkey", having="count(DISTINCT leaf) = 2"),
    "json_roundtrip": f"SELECT r.p_partkey, score, p_brand FROM ({ranked(NAMES(), _exact('small', 'gear'), 'p_partkey')}) r JOIN part p ON p.p_partkey = r.p_partkey",
    "saved_search": ranked(PARTS, _exact("cold", "plate"), "p_partkey"),
    "json_version_1": ranked(NAMES(), _exact("small", "gear"), "p_partkey"),
    "emptied_and_filled": f"SELECT *, 0::bigint AS documents_before, 0::bigint AS terms_before, 0::bigint AS dirt_before FROM ({ranked(NAMES(), _exact('red', 'ring'), 'p_partkey')})",
    "has_and_stored_fields": "SELECT i::bigint AS p_partkey, i IN (SELECT p_partkey FROM part) AS present, p_brand FROM (SELECT unnest([0, 1, 17, 19, -1, 1000000000000]) AS i) LEFT JOIN part ON p_partkey = i",
    "snapshot_search": f"""WITH {NAMES()}, gone AS (SELECT unnest(range(3, 150, 7)) AS id),
counted AS (SELECT *, id IN (SELECT id FROM gone) AS stale FROM post),
met AS (SELECT *, count(*) OVER (PARTITION BY term, f) - coalesce(sum(stale::int) OVER (PARTITION BY term, f ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM counted WHERE term IN ('red', 'ring')),
live AS (SELECT count(*)::double AS n, (SELECT avg(len) FROM lens WHERE id NOT IN (SELECT id FROM gone)) AS avg_len FROM src WHERE id NOT IN (SELECT id FROM gone))
SELECT id AS p_partkey, round(sum(ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * len / avg_len)))) * count(*), 6) AS score
FROM met JOIN lens USING (id, f) CROSS JOIN live WHERE NOT stale GROUP BY id""",
    "auto_vacuum": f"WITH {NAMES()} SELECT (SELECT count(*) FROM post) AS postings_before, 11::bigint AS dirt_before, (SELECT count(*) FROM post WHERE id >= 12) AS postings_after, 0::bigint AS dirt_after, count(*) - 12 AS document_count FROM src",
    "stringify_hook": ranked(base("(SELECT p_partkey, p_name, 'size ' || p_size AS p_size FROM part)", "p_partkey", ["p_name", "p_size"]), _exact("size", "7", "ring"), "p_partkey"),
    "discards_with_missing_fields": f"""WITH RECURSIVE {base('(SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_name END AS p_name, p_type FROM part)', 'p_partkey', ['p_name', 'p_type'])},
placed AS (SELECT s.id, x.f, row_number() OVER (PARTITION BY x.f ORDER BY s.id) AS j, len FROM src s CROSS JOIN (SELECT DISTINCT f FROM lens) x LEFT JOIN lens l ON l.id = s.id AND l.f = x.f),
run AS (SELECT f, 0::bigint AS j, 0.0::double AS mean FROM (SELECT DISTINCT f FROM lens) UNION ALL
  SELECT run.f, run.j + 1, CASE WHEN len IS NULL THEN mean ELSE (mean * run.j + len) / (run.j + 1) END FROM run JOIN placed ON placed.f = run.f AND placed.j = run.j + 1),
leaving AS (SELECT f, len, row_number() OVER (PARTITION BY f ORDER BY id) AS j FROM placed WHERE id % 4 = 1),
back AS (SELECT f, 0::bigint AS j, mean FROM run WHERE j = (SELECT count(*) FROM src) UNION ALL
  SELECT back.f, back.j + 1, CASE WHEN len IS NULL THEN mean ELSE (mean * ((SELECT count(*) FROM src) - back.j) - len) / ((SELECT count(*) FROM src) - back.j - 1) END FROM back JOIN leaving ON leaving.f = back.f AND leaving.j = back.j + 1)
SELECT f AS field_id, round(mean, 9) AS avg_len FROM back WHERE j = (SELECT count(*) FROM src WHERE id % 4 = 1)""",
    "search_fuzzy_callable": ranked(DOCS, [leaf(0, "nation", k=1), leaf(1, "erst"), leaf(2, "thand", k=1)]),
    "search_fuzzy_three": ranked(DOCS, [leaf(0, "ertheation", k=3)]),
    "search_max_fuzzy": ranked(DOCS, [leaf(0, "whoutherthand", k=1), leaf(1, "nation", k=1)]),
    "search_no_fuzzy": ranked(DOCS, _exact("erst", "nation", "the")),
    "stream_ingest": ranked(PARTS, _exact("cold", "plate"), "p_partkey"),
    "map_changes": "SELECT p_name AS key, count(*) AS value FROM part WHERE p_name <> 'red ring' GROUP BY p_name UNION ALL SELECT 'zebra', 6 UNION ALL SELECT 'newcomer', 9",
    "map_lookups": """WITH n AS (SELECT p_name AS key, count(*) AS value FROM part GROUP BY p_name)
SELECT count(*) AS size, (SELECT count(*) > 0 FROM n WHERE key = 'red ring') AS has_one, false AS has_none, (SELECT value FROM n WHERE key = 'red ring') AS value_of, NULL::bigint AS value_of_none,
min(key) AS first_key, sum(value)::bigint AS total, (SELECT count(*) FROM n WHERE levenshtein(key, 'cold ring') <= 2) AS near, 0::bigint AS cleared FROM n""",
    "prefix_map": "SELECT p_name AS key, count(*) AS value FROM part WHERE starts_with(p_name, 'red ') GROUP BY p_name",
    "fuzzy_map": "SELECT p_name AS key, count(*) AS value, levenshtein(p_name, 'cold ring') AS distance FROM part WHERE levenshtein(p_name, 'cold ring') <= 3 GROUP BY p_name",
}
#: The best rows with their places, and documents in their own order.
SQL["result_order"] = SQL["search_topk"].replace("SELECT doc_id, score FROM", "SELECT doc_id, score, row_number() OVER (ORDER BY exact DESC, first, doc_id) - 1 AS place FROM", 1).replace("LIMIT 20", "LIMIT 40")
SQL["wildcard_order"] = "SELECT doc_id, 1.0::double AS score, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents ORDER BY doc_id LIMIT 40"


def _best(leaves: list[str], limit: int, having: str = "true") -> str:
    """The best documents in order: by score, deciding leaf, kind and term of its match, document."""
    rows = ranked(DOCS, leaves, having=having).replace("round(sum(s) * count(DISTINCT q), 6) AS score", "round(sum(s) * count(DISTINCT q), 6) AS score, sum(s) * count(DISTINCT q) AS exact, min(leaf) AS first")
    return f"SELECT doc_id, score, row_number() OVER (ORDER BY exact DESC, first, doc_id) - 1 AS place FROM ({rows}) ORDER BY exact DESC, first, doc_id LIMIT {limit}"


SQL["topk_by_blocks"] = _best(_exact("the", "of", "and"), 40)
SQL["topk_rare_by_blocks"] = _best(_exact("the", "erst", "nation"), 10)
SQL["topk_and_by_blocks"] = _best(_exact("the", "of", "and"), 15, having="count(DISTINCT leaf) = 3")
SQL["topk_tree_by_blocks"] = _best(_exact("the", "of", "nation"), 15, having="count(*) FILTER (leaf < 2) = 2 AND count(*) FILTER (leaf = 2) = 0")
SQL["batch_by_blocks"] = SQL["batch_by_buckets"] = SQL["search_batch"]
_RENEWED = "(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name || ' renewed ring' ELSE p_name END AS p_name FROM part)"
SQL["segmented_search"] = ranked(base(_RENEWED, "p_partkey", ["p_name"]), _exact("red", "ring", "renewed"), "p_partkey")
SQL["segmented_topk"] = f"SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS place FROM ({SQL['segmented_search']}) ORDER BY score DESC LIMIT 25"
SQL["segment_stats"] = f"""WITH old AS (SELECT p_partkey AS id, len(list_distinct(list_transform({tokens('p_name')}, lambda t: lower(t)))) AS n FROM part),
rows AS (SELECT CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END AS seg, n, id % 5 = 0 OR id % 4 = 0 AS dead FROM old
  UNION ALL SELECT 2, (SELECT len(list_distinct(list_transform({tokens("p_name || ' renewed ring'")}, lambda t: lower(t)))) FROM part WHERE p_partkey = id), id % 4 = 0 FROM old WHERE id % 5 = 0),
per AS (SELECT seg, count(*) AS docs, count(*) FILTER (dead) AS dead, sum(n) AS n, sum(n) FILTER (NOT dead) AS live, count(*) FILTER (dead) / count(*)::double >= 0.3 AS worn FROM rows GROUP BY seg)
SELECT count(*) AS segments, sum(dead)::bigint AS dirt, sum(n)::bigint AS postings, count(*) FILTER (worn) AS rewritten, count(*) AS segments_after, coalesce(sum(dead) FILTER (NOT worn), 0)::bigint AS dirt_after,
  sum(CASE WHEN worn THEN live ELSE n END)::bigint AS postings_after, (sum(docs) - sum(dead))::bigint AS document_count FROM per"""
SQL["removals_in_order"] = SQL["discards_with_missing_fields"].replace("row_number() OVER (PARTITION BY f ORDER BY id) AS j FROM placed WHERE id % 4 = 1", "row_number() OVER (PARTITION BY f ORDER BY p_size DESC, id DESC) AS j FROM placed JOIN part ON p_partkey = id WHERE id % 2 = 1").replace("FROM src WHERE id % 4 = 1", "FROM src WHERE id % 2 = 1")
SQL["snapshot_overlap"] = f"""WITH {base("(SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_name ELSE p_name END AS p_name FROM part)", "p_partkey", ["p_name"])},
live AS (SELECT count(*)::double AS n, (SELECT avg(len) FROM lens WHERE id % 6 <> 1) AS avg_len FROM src WHERE id % 6 <> 1),
expanded AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY leaf) - 1 AS turn FROM ({' UNION ALL '.join([leaf(0, 'red', True, 1), leaf(1, 're', True, 1), leaf(2, 'rid', True, 1)])}) WHERE weight IS NOT NULL),
met AS (SELECT e.*, p.id, p.tf, p.id % 6 = 1 AS stale, (SELECT count(*) FROM post a WHERE a.term = e.term)
  - (SELECT count(*) FROM post a WHERE a.term = e.term AND a.id % 6 = 1 AND a.tf <= e.turn)
  - coalesce(sum((p.id % 6 = 1 AND p.tf > e.turn)::int) OVER (PARTITION BY e.term, e.leaf ORDER BY p.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM expanded e JOIN post p USING (term))
SELECT id AS p_partkey, round(sum(weight * ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * len / avg_len)))) * count(DISTINCT q), 6) AS score
FROM met JOIN lens USING (id) CROSS JOIN live WHERE NOT stale GROUP BY id"""
_HALVES = lambda x: f"flatten(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: [w[1:len(w) // 2], w[len(w) // 2 + 1:]]))"
SQL["python_analyzer"] = ranked(base("part", "p_partkey", ["p_name"], toks=_HALVES, terms="unnest(list_transform(list_filter(toks, lambda t: len(t) > 1), lambda t: lower(reverse(t))))"), _exact("ir", "gn", "na", "liv"), "p_partkey")
SQL["extract_hook"] = f"SELECT r.p_partkey, score, p_brand || ' - ' || p_name AS label FROM ({ranked(base('part', 'p_partkey', ['concat(p_brand, chr(32), chr(45), chr(32), p_name)']), _exact('7', 'ring'), 'p_partkey', boosts={0: 2})}) r JOIN part p ON p.p_partkey = r.p_partkey"
SQL["search_time_analysis"] = SQL["default_options"] = ranked(PARTS, _exact("ring", "red"), "p_partkey")
SQL["changed_documents"] = f"""SELECT 'warn' AS level, 'version_conflict' AS code, sum((NOT list_contains(t, 'altered'))::int + (NOT list_contains(t, 'since'))::int)::bigint AS times, (SELECT count(*) FROM part WHERE p_partkey % 10 <> 3) AS document_count
FROM (SELECT list_transform({tokens('p_name')}, lambda x: lower(x)) AS t FROM part WHERE p_partkey % 10 = 3)"""
SQL["refusals"] = "SELECT request, true AS refused, (SELECT count(*) FROM part) AS documents FROM (VALUES ('id is there'), ('id twice'), ('no id'), ('absent'), ('nothing to remove'), ('unknown option'), ('unknown combination'), ('no fields'), ('unknown default')) t(request)"
SQL["fuzzy_by_neighbours"] = ranked(PARTS, [leaf(0, "rde", True, 2), leaf(1, "ecanomy", True, 2)], "p_partkey")
SQL["batch_by_neighbours"] = f"""WITH {NAMES()}, dfs AS (SELECT term, f, count(*)::double AS m FROM post GROUP BY term, f),
asked AS (SELECT query_id, asked, count(*) AS times FROM (SELECT p_partkey AS query_id, lower(unnest({tokens('substr(p_name, 2)')})) AS asked FROM part) WHERE asked <> '' GROUP BY query_id, asked),
meant AS (SELECT asked, term, CASE WHEN asked = term THEN 1.0::double ELSE 0.45::double * length(term) / (length(term) + levenshtein(asked, term)) END AS weight FROM (SELECT DISTINCT asked FROM asked), (SELECT DISTINCT term FROM post)
  WHERE levenshtein(asked, term) <= least(6, floor(length(asked) * 0.3::double + 0.5::double))),
per AS (SELECT query_id, asked, id, any_value(times) AS times, sum(weight * ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * len / avg_len)))) AS w
  FROM asked JOIN meant USING (asked) JOIN post USING (term) JOIN dfs USING (term, f) JOIN lens USING (id, f) JOIN avgs USING (f) CROSS JOIN n GROUP BY query_id, asked, id),
placed AS (SELECT query_id, id, sum(w * times) * count(*) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(w * times) * count(*), 9) DESC, id) AS rank FROM per GROUP BY query_id, id)
SELECT query_id, id AS p_partkey, round(score, 6) AS score, rank FROM placed WHERE rank <= 3"""
SQL["suggestions_beforehand"] = f"""WITH {PARTS}, dfs AS (SELECT term, f, count(*)::double AS m FROM post GROUP BY term, f),
w AS (SELECT id, term, sum(CASE f WHEN 0 THEN 2.0::double ELSE 1.0::double END * ln(1 + (n - m + 0.5::double) / (m + 0.5::double)) * (0.5::double + tf * 2.2::double / (tf + 1.2::double * (0.3::double + 0.7::double * len / avg_len)))) AS w
  FROM post JOIN dfs USING (term, f) JOIN lens USING (id, f) JOIN avgs USING (f) CROSS JOIN n GROUP BY id, term),
begun AS (SELECT id, term, w, substr(term, 1, k) AS prefix, k, length(term)::double AS size FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= length(term)),
docs AS (SELECT prefix, id, sum(w * CASE WHEN size = k THEN 1.0::double ELSE 0.375::double * size / (size + 0.3::double * (size - k)) END) AS score, string_agg(term, ' ' ORDER BY size > k, term) AS suggestion FROM begun GROUP BY prefix, id),
phrases AS (SELECT prefix, suggestion, avg(score) AS score FROM docs GROUP BY prefix, suggestion),
placed AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY round(score, 9) DESC, suggestion) AS place FROM phrases)
SELECT prefix, suggestion, round(score, 6) AS score, place FROM placed WHERE place <= 5"""
