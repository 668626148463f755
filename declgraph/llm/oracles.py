"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[i:i + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, n, i, w[i:i + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(win) AS n FROM windows))),
hits AS (SELECT r, n, i, item_id FROM places JOIN windows USING (win)),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP5 = f"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_LOWER}) AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (r)
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _rounds(n: int, k: int = 16) -> str:
    """Centroids and assignments of op12, one pair of tables for each round and an assignment at the end."""
    out = [f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v QUALIFY k < {k})"]
    near = "SELECT v.r, v.vec_id, v.x, c.k, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{0} c"
    for i in range(n + 1):
        out.append(f"a{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS at_ FROM ({near.format(i)})) WHERE at_ = 1)")
        if i < n:
            cell = f"SELECT k, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM a{i}, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2"
            out.append(f"c{i + 1} AS (SELECT k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(m::HUGEINT ORDER BY i) AS x FROM ({cell}) GROUP BY 1) m USING (k))")
    return ", ".join(out)


OP12 = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
{_rounds(3)}
SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.k = c.k
"""


OP13 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY 1),
f AS (SELECT lang, p, k, count(*)::HUGEINT AS f FROM (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))) GROUP BY ALL HAVING f >= 100),
cuts AS (SELECT c.lang, c.p, c.k, c.f AS a, n, x.f AS l, y.f AS r, (1000 * c.f * n) // (x.f * y.f) AS score, x.k AS cut
  FROM f c JOIN n USING (lang) JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.p = c.p[1:x.k] JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.p = c.p[x.k + 1:c.k] WHERE c.k > 1),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inside AS (SELECT DISTINCT lang, p[i:i + m - 1] AS p, f FROM (SELECT lang, p, k, f, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k)),
kept AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, n, score FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = b.lang AND x.p = b.p AND x.f >= b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op10_neighbours": OP10, "op12_centroids": OP12, "op13_collocations": OP13, "op4_wu_manber": OP4, "op5_url_rules": OP5}
