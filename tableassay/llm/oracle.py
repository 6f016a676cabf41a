"""The same results as plain SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = """
docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
"""

OP2 = f"""
WITH {_WORDS},
starts AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS v FROM starts),
sizes AS (SELECT DISTINCT len(v) AS n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
runs AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS v FROM places),
hits AS (SELECT r, n, i, item_id FROM runs JOIN windows USING (v)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""

OP8 = """
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT r, list_slice(w, i, i + 3) AS s FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN docs ON docs.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN least USING (r) LEFT JOIN sizes USING (r)
"""

OP9 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r) AS rank FROM scores)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _seats(name: str, votes: str, group: str, vote: str, total: str, order: str) -> str:
    """Highest quotients among the seats near each share, as exact as the full list."""
    return f"""
{name}_n AS (SELECT *, count(*) OVER ({group}) AS pn, sum({vote}) OVER ({group}) AS pv FROM {votes}),
{name}_b AS (SELECT *, CASE WHEN {vote} > 0 THEN greatest(floor({vote} * ({total} - pn / 2) / pv + 0.5) - 1, 0) ELSE 0 END::BIGINT AS lo,
  CASE WHEN {vote} > 0 THEN greatest(floor({vote} * ({total} + pn / 2) / pv + 0.5) + 1, 0) ELSE 0 END::BIGINT AS hi FROM {name}_n),
{name}_l AS (SELECT *, {total} - sum(lo) OVER ({group}) AS open_seats FROM {name}_b),
{name}_k AS (SELECT *, unnest(range(lo + 1, hi + 1)) AS k FROM {name}_l),
{name}_r AS (SELECT *, row_number() OVER ({group} ORDER BY {vote} / (2 * k - 1) DESC, {order}, k) AS place_k FROM {name}_k),
{name} AS (SELECT l.*, lo + (SELECT count(*) FROM {name}_r x WHERE x.place_k <= x.open_seats AND x.{order} = l.{order}{" AND x.place = l.place" if "PARTITION" in group else ""}) AS seats FROM {name}_l l)"""


OP10 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, sha256(coalesce(text, '')) AS digest,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
per AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT] AS weight FROM per),
opened AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS full_size, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight, sum(source_size) OVER () AS total
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - full_size::DOUBLE * 2) / open_weight::DOUBLE AS level FROM opened),
level AS (SELECT first(level ORDER BY full_size, place) AS level FROM levels WHERE level * weight <= source_size * 2),
targets AS (SELECT place, source, docs, source_size, least((source_size * 2)::DOUBLE, coalesce((SELECT level FROM level) * weight, (source_size * 2)::DOUBLE)) AS target FROM levels),
asked AS (SELECT *, round(sum(target) OVER () / 16)::BIGINT AS wanted FROM targets),
{_seats("bysource", "asked", "", "target", "wanted", "place")},
placed AS (SELECT d.*, s.place, s.source_size, s.target, s.seats AS source_seats, (('0x' || substr(draw, 20, 12))::BIGINT % ceil(sqrt(s.docs))::BIGINT) AS shard
  FROM docs d JOIN bysource s ON d.source IS NOT DISTINCT FROM s.source),
cells AS (SELECT place, shard, sum(size)::BIGINT AS shard_size, first(source_seats) AS source_seats FROM placed GROUP BY place, shard),
{_seats("byshard", "cells", "PARTITION BY place", "shard_size", "source_seats", "shard")},
ring AS (SELECT p.*, c.shard_size, least(c.seats * 16, c.shard_size * 2) AS words,
  coalesce(sum(size) OVER (PARTITION BY p.place, p.shard ORDER BY draw, size, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  ('0x' || substr(md5('mix-1:' || p.place || ':' || p.shard), 1, 12))::BIGINT AS off FROM placed p JOIN byshard c ON c.place = p.place AND c.shard = p.shard),
turned AS (SELECT *, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds, CASE WHEN shard_size > 0 THEN off % shard_size ELSE 0 END AS o FROM ring),
rested AS (SELECT *, words - rounds * shard_size AS rest FROM turned)
SELECT doc_id, size, source_size, target, (rounds * size
  + greatest(0, least(a + size, least(o + rest, shard_size)) - greatest(a, o)) + greatest(0, least(a + size, o + rest - shard_size) - greatest(a, 0)))::BIGINT AS taken
FROM rested
"""

OP11 = """
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
seqs AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM seqs WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
starts AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS d FROM places),
grams AS (SELECT lang, list_slice(w, i, i + d - 1) AS g, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1),
scored AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang) JOIN grams x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN grams y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_runs AS (SELECT lang, a, g, i, unnest(range(2, len(g))) AS d FROM (SELECT lang, a, g, unnest(range(1, len(g))) AS i FROM grams WHERE len(g) > 2)),
covered AS (SELECT lang, list_slice(g, i, i + d - 1) AS g, max(a) AS most FROM inner_runs WHERE i + d - 1 <= len(g) GROUP BY ALL),
open_phrases AS (SELECT x.*, array_to_string(x.g, ' ') AS phrase FROM lowest x LEFT JOIN covered c USING (lang, g) WHERE c.most IS NULL OR 100 * c.most < 100 * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open_phrases)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000
"""

OP12 = """
WITH RECURSIVE steps AS (SELECT i, 0 AS k, i::UINTEGER AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 16)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::UINTEGER)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS text_crc32,
  coalesce('=' || source, '') AS source, ('0x' || substr(md5('shard-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw FROM documents, crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id NULLS FIRST, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n,
  ('0x' || substr(md5('shard-1:of:' || source), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS shift FROM docs),
line AS (SELECT *, row_number() OVER (ORDER BY (r - shift) / n, source, r) - 1 AS p, count(*) OVER () AS total FROM ranked),
dealt AS (SELECT *, p * 40 // total AS shard FROM line)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (p - (shard * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM dealt
"""

OP13 = """
WITH RECURSIVE known AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM docs),
masks AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS m FROM words LEFT JOIN known USING (doc_id)),
counts AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM masks GROUP BY part, m),
orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE NOT contains(o, f)),
steps AS (SELECT o, s, (1 << (ord(substr(o, s, 1)) - 65))::INT AS bit, coalesce(list_sum(list_transform(range(1, s), lambda i: (1 << (ord(substr(o, i, 1)) - 65))::INT)), 0)::INT AS earlier
  FROM (SELECT o, unnest(range(1, 6)) AS s FROM orders WHERE len(o) = 5)),
steps_of AS (SELECT part, o, s, bit,
  sum(n) FILTER (m & (earlier | bit) = 0) AS kept, sum(n) FILTER (m & earlier = 0 AND m & bit > 0) AS removed, sum(n) FILTER (m & earlier > 0 AND m & bit > 0) AS redundant,
  sum(n) FILTER (m = bit) AS unique_fails, sum(g) FILTER (m & earlier = 0 AND m & bit > 0) AS good_lost, sum(x) FILTER (m & earlier = 0 AND m & bit > 0) AS toxic_lost
  FROM counts, steps GROUP BY part, o, s, bit)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM steps_of
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op8_near_dedup": OP8, "op9_topk": OP9, "op10_mixing": OP10, "op11_phrases": OP11, "op12_sharding": OP12, "op13_filter_audit": OP13}
