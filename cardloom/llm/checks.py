"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM r),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w) x),
a AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) x WHERE c > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM a, (SELECT unnest([0, 1, 2]) AS k) z GROUP BY 1),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM r),
m AS (SELECT r.doc_id, r.source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM r JOIN w ON r.rid = w.rid JOIN l ON r.rid = l.rid LEFT JOIN p ON r.rid = p.rid),
f AS (SELECT *, coalesce('=' || source, '') AS host, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n_texts, count(*) FILTER (WHERE base_failed) / count(*) AS b, count(*) FILTER (WHERE 10 * n_symbols > word_chars) / count(*) AS s,
  count(*) FILTER (WHERE 3 * n_dup_lines > n_words) / count(*) AS d FROM f GROUP BY 1),
pr AS (SELECT avg(b) AS bm, avg(s) AS sm, avg(d) AS dm, """ + ", ".join(
    f"greatest(1.0, CASE WHEN var_pop({x}) > 0 THEN avg({x}) * (1 - avg({x})) / var_pop({x}) - 1 ELSE avg(n_texts) END) AS {x}k" for x in "bsd") + """ FROM h),
v AS (SELECT host, n_texts, """ + ", ".join(f"({x} * n_texts + {x}m * {x}k) / (n_texts + {x}k) AS {n}_rate" for x, n in (("b", "base"), ("s", "symbols"), ("d", "dup_lines"))) + """ FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_texts, round(base_rate, 6) AS base_rate, round(symbols_rate, 6) AS symbols_rate,
  round(dup_lines_rate, 6) AS dup_lines_rate, base_rate > 0.5 OR symbols_rate > 0.5 OR dup_lines_rate > 0.5 AS host_failed,
  NOT base_failed AND NOT (base_rate > 0.5 OR symbols_rate > 0.5 OR dup_lines_rate > 0.5) AS kept FROM f JOIN v ON f.host = v.host"""

OP5 = rf"""WITH r AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
x AS (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM r),
ln AS (SELECT rid, doc_id, pos, line, list_transform(regexp_extract_all(line, '{_WORD}'), lambda y: CASE WHEN regexp_matches(y, '[0-9]') THEN '<*>' ELSE y END) AS tk FROM x),
kn AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, tk, [CAST(len(tk) AS VARCHAR), tk[1], tk[2], tk[3]] AS leaf FROM ln WHERE len(tk) >= 4),
lf AS (SELECT leaf FROM kn GROUP BY 1 HAVING count(DISTINCT doc) >= 8),
c AS (SELECT doc, tk, leaf, unnest(tk) AS tok, generate_subscripts(tk, 1) AS place FROM kn WHERE leaf IN (SELECT leaf FROM lf)),
sn AS (SELECT leaf, place, tok FROM c WHERE tok <> '<*>' GROUP BY 1, 2, 3 HAVING count(DISTINCT doc) >= 8),
td AS (SELECT c.tk, avg(CASE WHEN sn.tok IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share,
   string_agg(coalesce(sn.tok, '<*>'), ' ' ORDER BY c.place) AS template FROM (SELECT DISTINCT tk, leaf, tok, place FROM c) c LEFT JOIN sn ON c.leaf = sn.leaf AND c.place = sn.place AND c.tok = sn.tok GROUP BY 1),
rc AS (SELECT tk FROM td WHERE share >= 0.6 AND template IN (SELECT template FROM td JOIN kn ON td.tk = kn.tk WHERE share >= 0.6 GROUP BY 1 HAVING count(DISTINCT doc) >= 8)),
k AS (SELECT ln.*, rc.tk IS NOT NULL AS gone, len(regexp_extract_all(line, '{_WORD}')) AS w FROM ln LEFT JOIN rc ON ln.tk = rc.tk),
s AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE gone) AS g, coalesce(sum(w) FILTER (WHERE gone), 0) AS gw, sum(w) AS aw,
   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS rest FROM k GROUP BY 1)
SELECT doc_id, CASE WHEN gw > 0 AND gw <= 0.5 * aw THEN rest ELSE text END AS text, CASE WHEN text IS NULL THEN 0 ELSE n END AS n_lines,
  CASE WHEN gw > 0 AND gw <= 0.5 * aw THEN g ELSE 0 END AS n_dropped, CAST(CASE WHEN gw > 0 AND gw <= 0.5 * aw THEN gw ELSE 0 END AS BIGINT) AS words_dropped FROM r JOIN s ON r.rid = s.rid"""

OP8 = rf"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
   md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mark FROM documents),
e AS (SELECT *, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % greatest(1, CAST(ceil(count(*) OVER () / 1024) AS BIGINT)) AS shard FROM d),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY key = '', key) - 1) % 3]::DOUBLE AS w FROM d GROUP BY 1),
o AS (SELECT *, 2.0 * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / w, key) AS k FROM s),
lv AS (SELECT k, 2.0 * source_size / w AS r, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
t AS (SELECT key, source_size, least(cap, w * (SELECT level FROM lv WHERE level <= r ORDER BY k LIMIT 1)) AS target FROM o),
q AS (SELECT key, target / (2 * unnest(range(CAST(source_size / 4 + 2 AS BIGINT))) + 1) AS q FROM t),
b AS (SELECT key, count(*) AS blocks FROM (SELECT key, row_number() OVER (ORDER BY q DESC, key) AS n FROM q WHERE q > 0) x
   WHERE n <= (SELECT floor(sum(target) / 8 + 0.53125) FROM t) GROUP BY 1),
h AS (SELECT key, shard, sum(size) AS words FROM e GROUP BY 1, 2),
hq AS (SELECT h.key, shard, coalesce(blocks, 0) AS blocks, words / (2 * unnest(range(coalesce(blocks, 0))) + 1) AS q FROM h JOIN b ON h.key = b.key),
hb AS (SELECT key, shard, count(*) * 8 AS quota FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q DESC, shard) AS n FROM hq) x WHERE n <= blocks GROUP BY 1, 2),
p AS (SELECT e.*, h.words, coalesce(hb.quota, 0) AS quota, coalesce(sum(size) OVER (PARTITION BY e.key, e.shard ORDER BY mark, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM e JOIN h ON e.key = h.key AND e.shard = h.shard LEFT JOIN hb ON e.key = hb.key AND e.shard = hb.shard)
SELECT doc_id, size, t.source_size, round(t.target, 6) AS target,
  CAST(greatest(0, least(size, quota - before)) + greatest(0, least(size, quota - words - before)) AS BIGINT) AS taken FROM p JOIN t ON p.key = t.key"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, min(v) AS v FROM v GROUP BY 1),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""


#: crc32 of the decimal digits of a number, from the table of the reflected polynomial 0xEDB88320.
_CRC = """t32 AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
   lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def _crc(number: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
   lambda c, x: xor(c >> 8, t[1 + CAST(xor(c, x) & 255 AS INT)])))"""


def _told(*columns: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


OP12 = f"""WITH RECURSIVE {_CRC},
d AS (SELECT row_number() OVER () AS rid, *, CASE WHEN {_crc("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents, t32),
l AS (SELECT rid, doc_id, source, {_told("doc_id", "source", "lang", "n_chars", "text")} AS leaf, {_told("doc_id", "source", "lang", "n_chars", "told")} AS seen FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos FROM l),
lo(source, level, pos, h, n) AS (SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM p
   UNION ALL SELECT source, any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 2) // 3 FROM lo WHERE n > 1 GROUP BY source, pos // 3),
s AS (SELECT source, h AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM lo WHERE n = 1),
up(level, pos, h, n) AS (SELECT 0, tree, subroot, n FROM s
   UNION ALL SELECT any_value(level) + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value(n + 2) // 3 FROM up WHERE n > 1 GROUP BY pos // 3),
a AS (SELECT coalesce('=' || source, '') AS k, level, pos, h, n FROM lo UNION ALL SELECT '^', level, pos, h, n FROM up),
b AS (SELECT x.k, x.level, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lt, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rt
   FROM a x JOIN a y ON x.k = y.k AND x.level = y.level AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY 1, 2, 3),
f(rid, k, level, pos, h, proof) AS (SELECT rid, coalesce('=' || source, ''), 0, pos, seen, '' FROM p
   UNION ALL SELECT f.rid, CASE WHEN b.k IS NULL THEN '^' ELSE f.k END, CASE WHEN b.k IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN b.k IS NULL THEN s.tree ELSE f.pos // 3 END,
      CASE WHEN b.k IS NULL THEN f.h ELSE sha256(b.lt || f.h || b.rt) END, f.proof || coalesce(b.lt || b.rt, '')
   FROM f LEFT JOIN b ON f.k = b.k AND f.level = b.level AND f.pos = b.pos LEFT JOIN s ON f.k = coalesce('=' || s.source, '') WHERE b.k IS NOT NULL OR f.k <> '^'),
r AS (SELECT rid, arg_max(h, length(proof)) AS h, max(proof) AS proof FROM (SELECT * FROM f WHERE k = '^' AND level = (SELECT max(level) FROM up)) x GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(r.proof) AS proof_sha256, r.h AS folded_root, r.h = root AS verified
FROM p JOIN r ON p.rid = r.rid JOIN s ON p.source IS NOT DISTINCT FROM s.source, (SELECT h AS root FROM up WHERE n = 1) x"""


OP13 = f"""WITH {_CRC},
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id")} % 9 AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1) x, t32),
m AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
w AS (SELECT m.conv_id, i AS depth, r, x, base AS ref_conv_id, i AS ref_at FROM m JOIN t ON t.conv_id = base AND i <= k
   UNION ALL SELECT m.conv_id, k + i - h, r, x, m.conv_id, i FROM m JOIN t ON t.conv_id = m.conv_id AND i > h
   UNION ALL SELECT conv_id, 0, '', '', NULL, NULL FROM m),
p AS (SELECT *, string_agg(sha256(strlen(r) || ':' || r || x), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, max(depth) OVER (PARTITION BY conv_id) AS top FROM w),
n AS (SELECT key, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(strlen(x)) AS b, arg_min(ref_conv_id, conv_id) AS ref_conv_id, arg_min(ref_at, conv_id) AS ref_at,
   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = top), '')) AS ends_sha256 FROM p GROUP BY 1),
k AS (SELECT left(key, length(key) - 64) AS key, count(*) AS n FROM n GROUP BY 1),
z AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON n.key = k.key),
s AS (SELECT a.key, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.b) AS saved FROM z a JOIN z b ON starts_with(b.key, a.key) GROUP BY 1)
SELECT z.conv_id, z.depth, u.conv_id AS parent_conv_id, z.n_convs, z.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, z.ends_sha256, z.ref_conv_id, z.ref_at
FROM z JOIN s ON z.key = s.key LEFT JOIN z u ON u.key = left(z.key, length(z.key) - 64)"""
