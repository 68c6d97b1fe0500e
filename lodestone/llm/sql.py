"""SQL of those operators' queries that SQL can express, for DuckDB on the same tables."""

_REACH = """reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
low AS (SELECT a AS id, least(a, min(b)) AS low FROM reach GROUP BY a)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
both_ways AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_REACH}
SELECT vec_id, (SELECT count(*) FROM both_ways WHERE a = vec_id) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN low ON id = vec_id"""

OP4 = """WITH per AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM per) / (SELECT count(*) FROM per)::double / n AS rate FROM per),
steps AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM rates CROSS JOIN (SELECT unnest(range(0, 100)) AS k)),
drawn AS (SELECT d.*, (('0x' || substr(md5('11:' || d.doc_id || ':0'), 1, 13))::BIGINT + 0.5::double) / 4503599627370496::double AS u FROM documents d),
counted AS (SELECT * EXCLUDE (u), (SELECT count(*) FROM steps s WHERE s.source = drawn.source AND s.cdf < u) AS copies FROM drawn)
SELECT * EXCLUDE (copies, copy), copy::int AS copy, md5('11:order:' || doc_id || ':' || copy) AS order_key FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted)"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
pairs AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS both_n, any_value(p.n) AS na, any_value(q.n) AS nb FROM x p JOIN x q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
both_ways AS (SELECT a, b FROM pairs WHERE 100 * both_n >= 80 * (na + nb - both_n)),
{_REACH}
SELECT doc_id, len(sh) AS n_shingles, coalesce(low, doc_id) AS component_id FROM s LEFT JOIN low ON id = doc_id"""

_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11 = f"""WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents),
q AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY item_id, term),
total AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
words AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
post AS (SELECT doc_id, term, any_value(n)::BIGINT AS n, count(*) AS tf FROM words GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM post, total GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score FROM asked JOIN post USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM s WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20"""

OP13 = f"""WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_TERMS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
hit AS (SELECT doc_id, p, n, item_id FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM spots, (SELECT DISTINCT n FROM win) WHERE p + n - 1 <= len(w)) JOIN win USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)"""

SQL = {"op1_embedding_dedup": OP1, "op4_source_mix": OP4, "op10_jaccard_join": OP10, "op11_lexical_search": OP11, "op13_decontaminate": OP13}
