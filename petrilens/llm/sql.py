"""SQL for the same rows as the queries, where SQL can express them."""

from __future__ import annotations


def _apportion(name: str, source: str, group: str, weight: str, seats: str, tie: str, out: str) -> str:
    """CTEs that add ``out`` to ``source``: seats by highest quotients."""
    g = f"PARTITION BY {group}"
    return f"""{name}_a AS (SELECT *, {seats} AS seats, sum({weight}) OVER ({g})::DOUBLE AS total, count(*) OVER ({g}) AS n_rows FROM {source}),
{name}_b AS (SELECT *, CASE WHEN total > 0 THEN {weight}::DOUBLE / total ELSE 0 END AS part FROM {name}_a),
{name}_c AS (SELECT *, floor(part * seats + 0.5)::BIGINT AS base, floor(part * n_rows / 2)::BIGINT + 2 AS tries FROM {name}_b),
{name}_d AS (SELECT *, (seats - sum(base) OVER ({g}))::BIGINT AS miss FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN miss > 0 THEN base + j ELSE base + 1 - j END AS seat FROM {name}_d, unnest(generate_series(1, tries)) AS u(j) WHERE miss <> 0),
{name}_f AS (SELECT *, {weight}::DOUBLE / (2 * seat - 1) AS q FROM {name}_e WHERE seat > 0),
{name}_g AS (SELECT *, row_number() OVER ({g} ORDER BY CASE WHEN miss > 0 THEN -q ELSE q END, CASE WHEN miss > 0 THEN {tie} ELSE -{tie} END, CASE WHEN miss > 0 THEN seat ELSE -seat END) AS nth FROM {name}_f),
{name}_h AS (SELECT {group} AS mg, {tie} AS mt, count(*) AS moved FROM {name}_g WHERE nth <= abs(miss) GROUP BY 1, 2),
{name} AS (SELECT {name}_d.*, base + sign(miss)::BIGINT * coalesce(moved, 0) AS {out} FROM {name}_d LEFT JOIN {name}_h ON {group} = mg AND {tie} = mt)"""


MIX = rf"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents),
s1 AS (SELECT source, sum(size)::BIGINT AS source_size, 1 AS one FROM sized GROUP BY 1),
s2 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS source_no FROM s1),
s3 AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap, 3 * sum(source_size) OVER () AS t2 FROM s2),
s4 AS (SELECT *, row_number() OVER (ORDER BY cap / w, source_no) AS rk, t2 - 2 * coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s3),
lv AS (SELECT min(rk) AS rk FROM s4 WHERE w * rest <= 2 * ws * cap),
l2 AS (SELECT s4.rk, rest, ws FROM s4 JOIN lv ON s4.rk = lv.rk),
s5 AS (SELECT source, source_size, source_no, one, CASE WHEN s4.rk >= l2.rk THEN (w * l2.rest)::DOUBLE / (2 * l2.ws)::DOUBLE ELSE cap::DOUBLE END AS target, sum(CASE WHEN s4.rk >= l2.rk THEN (w * l2.rest)::DOUBLE / (2 * l2.ws)::DOUBLE ELSE cap::DOUBLE END) OVER () AS all_target FROM s4 LEFT JOIN l2 ON TRUE),
{_apportion("src", "s5", "one", "target", "floor(all_target / 64 + 0.5)::BIGINT", "source_no", "source_blocks")},
placed AS (SELECT d.doc_id, d.size, d.key, src.source_no, src.source_size, src.target, src.source_blocks, ('0x' || substr(d.key, 1, 8))::BIGINT % least(8192, greatest(1, ceil(src.source_size / 262144)))::BIGINT AS shard FROM sized d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
sh1 AS (SELECT source_no, shard, sum(size)::BIGINT AS shard_size, any_value(source_blocks) AS source_blocks FROM placed GROUP BY 1, 2),
{_apportion("sh", "sh1", "source_no", "shard_size", "source_blocks", "shard", "quota")},
q1 AS (SELECT source_no, shard, quota, greatest(1, ceil(shard_size / 64))::BIGINT AS n FROM sh),
q2 AS (SELECT source_no, shard, n, least(quota, 2 * n) AS quota, ('0x' || substr(md5('mix|' || source_no || '|' || shard), 1, 8))::BIGINT % n AS start FROM q1),
q3 AS (SELECT source_no, shard, quota // n AS passes, start * 64 AS a, least(start + quota % n, n) * 64 AS b, greatest(start + quota % n - n, 0) * 64 AS w FROM q2),
run AS (SELECT *, sum(size) OVER (PARTITION BY source_no, shard ORDER BY substr(key, 9, 24), doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM placed)
SELECT doc_id, size, source_size, target, (passes * size + greatest(least(e, w) - greatest(e - size, 0), 0) + greatest(least(e, b) - greatest(e - size, a), 0))::BIGINT AS taken FROM run JOIN q3 USING (source_no, shard)"""

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

LEAKS = f"""WITH i AS (SELECT item_id, w, least(5, len(w))::BIGINT AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
ish AS (SELECT item_id, k, len(w) - k + 1 AS n, p, array_to_string(w[p + 1 : p + k], ' ') AS sh FROM i, unnest(generate_series(0, len(w) - k)) AS u(p)),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
dsh AS (SELECT doc_id, k, len(w) - k + 1 AS nd, p, array_to_string(w[p + 1 : p + k], ' ') AS sh FROM (SELECT doc_id, w, k FROM dw JOIN (SELECT DISTINCT k FROM i) ON len(w) >= k), unnest(generate_series(0, len(w) - k)) AS u(p)),
met AS (SELECT DISTINCT d.doc_id, d.k, x.item_id, x.n, least(x.n, d.nd) AS m, d.nd, d.p FROM dsh d JOIN ish x ON d.k = x.k AND d.sh = x.sh),
cand AS (SELECT DISTINCT doc_id, k, item_id, n, m, u.start FROM met, unnest(generate_series(greatest(0, p - m + 1), least(p, nd - m))) AS u(start)),
wc AS (SELECT c.doc_id, c.item_id, c.k, c.n, c.m, c.start, d.sh, count(*) AS cnt FROM cand c JOIN dsh d ON c.doc_id = d.doc_id AND c.k = d.k AND d.p BETWEEN c.start AND c.start + c.m - 1 GROUP BY 1, 2, 3, 4, 5, 6, 7),
ic AS (SELECT item_id, sh, count(*) AS cnt FROM ish GROUP BY 1, 2),
sc AS (SELECT wc.doc_id, wc.item_id, wc.k, wc.n, wc.m, wc.start, sum(least(wc.cnt, ic.cnt)) AS same FROM wc JOIN ic ON wc.item_id = ic.item_id AND wc.sh = ic.sh GROUP BY 1, 2, 3, 4, 5, 6),
sim AS (SELECT *, same / (m + n - same) AS similarity FROM sc)
SELECT doc_id, item_id, start, (m + k - 1)::BIGINT AS n_words, similarity::DOUBLE AS similarity FROM sim WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""

_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1))"
_DIGIT = "('0x' || substr(md5(pattern), {}, {}))::INT"

URLS = rf"""WITH cap AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INT AS fetched_on, {_HOST} AS host FROM pages),
raw AS (SELECT host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]+)/', 1) AS part FROM cap WHERE host <> ''),
names AS (SELECT DISTINCT list, pattern FROM (SELECT 'hosts' AS list, host AS pattern FROM raw UNION ALL SELECT 'domains', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM raw UNION ALL SELECT 'paths', host || '/' || part || '/' FROM raw WHERE part <> '') WHERE pattern <> ''),
dated AS (SELECT *, DATE '2024-01-01' + {_DIGIT.format(2, 2)} AS d, {_DIGIT.format(4, 1)} AS h4, {_DIGIT.format(5, 1)} AS h5 FROM names WHERE {_DIGIT.format(1, 1)} < 4),
turns AS (SELECT list, pattern, d AS dated, 'add' AS action FROM dated UNION ALL SELECT list, pattern, d + h4 + 1, 'remove' FROM dated WHERE h5 < 10 UNION ALL SELECT list, pattern, d + h4 + 30, 'add' FROM dated WHERE h5 < 5),
days AS (SELECT list, pattern, dated, min(action) AS action FROM turns GROUP BY 1, 2, 3),
chg AS (SELECT *, lag(action) OVER (PARTITION BY list, pattern ORDER BY dated) AS was FROM days),
spans AS (SELECT *, lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated) AS valid_to FROM chg WHERE was IS NULL OR was <> action),
act AS (SELECT url, fetched_on, s.list, s.pattern, s.dated AS listed_on FROM (SELECT DISTINCT url, fetched_on, host FROM cap WHERE host <> '') c JOIN spans s ON s.action = 'add' AND s.dated <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to)
 AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern) OR (s.list = 'paths' AND starts_with(s.pattern, c.host || '/') AND starts_with(regexp_extract(c.url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), substr(s.pattern, len(c.host) + 1))))
 QUALIFY row_number() OVER (PARTITION BY url, fetched_on ORDER BY len(s.pattern) DESC, s.list, s.dated) = 1)
SELECT cap.page_id, cap.url, cap.fetched_on::VARCHAR AS fetched_on, act.pattern IS NOT NULL AS blocked, act.list, act.pattern, act.listed_on::VARCHAR AS listed_on FROM cap LEFT JOIN act ON cap.url = act.url AND cap.fetched_on = act.fetched_on"""

TOPK = """WITH v AS (SELECT vec_id, p, floor(64 * x::DOUBLE)::BIGINT AS q FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.q * b.q)::BIGINT AS score FROM v a JOIN v b ON a.p = b.p AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

SQL = {"op1_mix_sources": MIX, "op5_decontamination": LEAKS, "op7_url_filter": URLS, "op9_topk": TOPK}
