"""DuckDB SQL for op1, op2, op3, op4, op8, op9 and op13: plain joins over all pairs or all substrings, which
only small tables bear.

For op1, op2, op3, op8 and op13 the SQL is the contract alone. What a contract leaves to the method (op4's verdicts
without a rule, op9's words taken) the SQL computes by the method's definition, constants included,
in other steps than the operator's.
"""


def _merged(level: int) -> str:
    """The tree of op4 with one more level merged: each template's branch so far, from b{level - 1}."""
    return f"""
), c{level} AS (SELECT host, branch, tmpl[{level}] AS name, coalesce(tmpl[{level + 1}], '') AS after, count(*)::DOUBLE AS c, count(ruled) AS labels, count(*) FILTER (ruled = 'block') AS bad FROM b{level - 1} WHERE len(tmpl) >= {level} GROUP BY ALL
), k{level} AS (SELECT c.host, c.branch, c.name, sum(c.c) AS n, sum(c.labels) AS labels, sum(c.bad) AS bad, count(*) AS ways, 0.5 * (sum(abs(c.c / o.n - a.c / h.n)) + 1 - sum(a.c / h.n)) AS distance
  FROM c{level} c JOIN (SELECT host, branch, name, sum(c) AS n FROM c{level} GROUP BY ALL) o USING (host, branch, name) JOIN (SELECT host, branch, after, sum(c) AS c FROM c{level} GROUP BY ALL) a USING (host, branch, after)
  JOIN (SELECT host, branch, sum(c) AS n FROM c{level} GROUP BY ALL) h USING (host, branch) GROUP BY c.host, c.branch, c.name
), f{level} AS (SELECT *, n >= 5 AND distance <= 0.1 + 0.98 * sqrt(ways / n) AS shaped FROM k{level}
), r{level} AS (SELECT host, branch, sum(bad) / sum(labels) AS rate FROM f{level} WHERE shaped GROUP BY ALL
), a{level} AS (SELECT f.host, f.branch, f.name FROM f{level} f JOIN r{level} r USING (host, branch) WHERE f.shaped AND (f.labels = 0 OR abs(f.bad / f.labels - rate) <= 1.96 * sqrt(greatest(rate * (1 - rate), 1e-9) / f.labels))
), m{level} AS (SELECT host, branch, name FROM a{level} JOIN (SELECT host, branch FROM a{level} GROUP BY ALL HAVING count(*) > 1) USING (host, branch)
), b{level} AS (SELECT b.* EXCLUDE (branch, nodes), CASE WHEN len(tmpl) < {level} THEN b.branch ELSE b.branch || '/' || CASE WHEN m.name IS NULL THEN tmpl[{level}] ELSE '<like>' END END AS branch,
    CASE WHEN len(tmpl) < {level} THEN nodes ELSE list_append(nodes, b.branch || '/' || CASE WHEN m.name IS NULL THEN tmpl[{level}] ELSE '<like>' END) END AS nodes
  FROM b{level - 1} b LEFT JOIN m{level} m ON m.host = b.host AND m.branch = b.branch AND m.name = tmpl[{level}] AND len(tmpl) >= {level}"""


ORACLES: dict[str, str] = {
    "op1_top_k": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op2_near_dup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT e.y, r.reached FROM r JOIN e ON e.x = r.node
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
""",
    "op3_embed_dup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT e.y, r.reached FROM r JOIN e ON e.x = r.node
), c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node
), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, m.vec_id = c.component_id AS kept
FROM embeddings m LEFT JOIN n ON n.x = m.vec_id LEFT JOIN c ON c.node = m.vec_id
""",
    "op4_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS ruled FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), g AS (SELECT u.*, rule, ruled, list_filter(string_split(path, '/'), lambda x: x <> '') AS every FROM u LEFT JOIN hit USING (page_id)
), seg AS (SELECT page_id, host, generate_subscripts(every[1:8], 1) AS level, unnest(every[1:8]) AS seg FROM g
), kept AS (SELECT host, level, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, level) AS of_ FROM (SELECT host, level, seg, count(*) AS n FROM seg GROUP BY 1, 2, 3)) WHERE n >= 5 AND n >= of_ * 0.02 AND NOT regexp_matches(seg, '^[0-9]')
), named AS (SELECT s.page_id, s.level, CASE WHEN k.seg IS NOT NULL THEN s.seg WHEN regexp_matches(s.seg, '^[0-9]+$') THEN '<num>' WHEN regexp_matches(s.seg, '^[0-9]+\.[A-Za-z0-9]+$') THEN '<num.ext>'
    WHEN regexp_matches(s.seg, '^[0-9a-fA-F-]{16,}$') THEN '<hex>' ELSE '<any>' END AS name FROM seg s LEFT JOIN kept k ON s.host = k.host AND s.level = k.level AND s.seg = k.seg
), t AS (SELECT g.*, coalesce(n.names, []) || CASE WHEN len(every) > 8 THEN ['**'] ELSE []::VARCHAR[] END AS tmpl FROM g LEFT JOIN (SELECT page_id, list(name ORDER BY level) AS names FROM named GROUP BY page_id) n USING (page_id)
), b0 AS (SELECT *, '' AS branch, []::VARCHAR[] AS nodes FROM t""" + "".join(map(_merged, range(1, 10))) + r"""
), node AS (SELECT host, unnest(nodes) AS node, ruled FROM b9 WHERE ruled IS NOT NULL
), prior AS (SELECT (count(*) FILTER (ruled = 'block') + 1) / (count(ruled) + 2) AS p FROM t
), purity AS (SELECT host, node, (count(*) FILTER (ruled = 'block') + 5 * (SELECT p FROM prior)) / (count(*) + 5) AS purity FROM node GROUP BY ALL HAVING count(*) >= 5
), best AS (SELECT page_id, arg_max(purity, level) AS purity FROM (SELECT page_id, host, unnest(nodes) AS node, generate_subscripts(nodes, 1) AS level FROM b9) JOIN purity USING (host, node) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict
FROM b9 LEFT JOIN best USING (page_id)
""",
    "op8_passage_dup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS part FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS i FROM d)
), f AS (SELECT part, min(doc_id) AS least FROM s GROUP BY part HAVING min(doc_id) <> max(doc_id)
), hit AS (SELECT s.doc_id, s.i FROM s JOIN f USING (part) WHERE s.doc_id > least
), b AS (SELECT x.doc_id, p, c, coalesce(max(i) OVER (PARTITION BY x.doc_id ORDER BY p) >= p - 49, FALSE) AS gone
  FROM (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(n)) AS p FROM d)) x LEFT JOIN hit ON hit.doc_id = x.doc_id AND hit.i = p
), r AS (SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY p) AS starts FROM b
), k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(c, '' ORDER BY p) FILTER (NOT gone), '') AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
""",
    "op9_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s1 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM sized GROUP BY source
), s2 AS (SELECT *, source_size * 2 AS cap, CASE (rn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w FROM s1
), s3 AS (SELECT *, cap / w AS ratio FROM s2
), s4 AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s3
), s5 AS (SELECT *, least(cap::DOUBLE, (SELECT arg_min(level, (ratio, rn)) FROM s4 WHERE level <= ratio) * w) AS target FROM s4
), size_ AS (SELECT greatest(1, least(256, floor(sum(target) / 20000)))::BIGINT AS block, sum(target) AS total FROM s5
), quotas AS (SELECT rn, count(*) AS quota FROM (
    SELECT rn, row_number() OVER (ORDER BY target / (k + 0.5) DESC, rn) AS place FROM s5, size_, range((SELECT round(total / block)::BIGINT FROM size_)) seat(k) WHERE target > 0)
  WHERE place <= (SELECT round(total / block)::BIGINT FROM size_) GROUP BY rn
), spread AS (SELECT *, greatest(1, least(4096, ceil(source_size / 262144.0)))::BIGINT AS shards FROM s5
), placed AS (SELECT d.*, s.rn, s.source_size, s.target, ('0x' || substr(md5(concat('7:', coalesce(d.doc_id::VARCHAR, '-'))), 1, 8))::BIGINT % s.shards AS shard
  FROM sized d JOIN spread s ON d.source IS NOT DISTINCT FROM s.source
), spans AS (SELECT *, (sum(size) OVER p - size)::BIGINT AS a, row_number() OVER p AS at_ FROM placed WINDOW p AS (PARTITION BY rn, shard ORDER BY doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING)
), shard1 AS (SELECT rn, shard, sum(size)::BIGINT AS words, CASE WHEN sum(size) > 0 THEN greatest(1, round(sum(size) / (SELECT block FROM size_)))::BIGINT ELSE 0 END AS blocks FROM spans GROUP BY rn, shard
), wins AS (SELECT rn, shard, count(*) AS won FROM (
    SELECT s.rn, s.shard, q.quota, row_number() OVER (PARTITION BY s.rn ORDER BY s.blocks / (seat.k + 0.5) DESC, s.shard) AS place
    FROM shard1 s JOIN quotas q ON q.rn = s.rn, LATERAL (SELECT unnest(range(q.quota)) AS k) seat WHERE s.blocks > 0)
  WHERE place <= quota GROUP BY rn, shard
), shard2 AS (SELECT s.*, least(coalesce(w.won, 0), 2 * s.blocks) AS won FROM shard1 s LEFT JOIN wins w USING (rn, shard) WHERE s.blocks > 0
), drawn AS (SELECT rn, shard, block, (block * words) // blocks AS lo, ((block + 1) * words) // blocks AS hi FROM (
    SELECT *, row_number() OVER (PARTITION BY rn, shard ORDER BY ('0x' || substr(md5(concat_ws(':', 7, rn, shard, block)), 1, 8))::BIGINT, block) AS place
    FROM (SELECT *, unnest(range(blocks)) AS block FROM shard2)) WHERE place <= won % blocks
), part AS (SELECT d.rn, d.shard, d.at_, sum(least(d.a + d.size, b.hi) - greatest(d.a, b.lo)) AS part FROM spans d JOIN drawn b ON d.rn = b.rn AND d.shard = b.shard AND b.lo < d.a + d.size AND b.hi > d.a WHERE d.size > 0 GROUP BY ALL)
SELECT d.doc_id, d.size, d.source_size, d.target, (coalesce(s.won // s.blocks, 0) * d.size + coalesce(p.part, 0))::BIGINT AS taken
FROM spans d LEFT JOIN shard2 s USING (rn, shard) LEFT JOIN part p USING (rn, shard, at_)
""",
    "op13_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 3 * length(s) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(s, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(w.doc_id) OVER (PARTITION BY s) < w.doc_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), p AS (SELECT c.*, filter_order, coalesce(list_min(list_transform(string_split(fails, ''), lambda x: CASE WHEN x = '' THEN 6 ELSE instr(filter_order, x) END)), 6) AS at_ FROM c, o
), r AS (
  SELECT part, filter_order, step, filter_order[step] AS x, coalesce(sum(n) FILTER (at_ > step), 0) AS kept, coalesce(sum(n) FILTER (at_ = step), 0) AS removed,
    coalesce(sum(n) FILTER (at_ < step AND contains(fails, filter_order[step])), 0) AS redundant, coalesce(sum(n) FILTER (fails = filter_order[step]), 0) AS unique_fails,
    coalesce(sum(good) FILTER (at_ = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (at_ = step), 0) AS toxic_lost
  FROM p, range(1, 6) steps(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM r
""",
}
