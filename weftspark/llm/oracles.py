"""SQL that DuckDB runs on the same tables, for the operators that SQL can express."""

from __future__ import annotations

_BITS = " + ".join(f"CAST(substr(bits, CAST(5 * i + {k + 1} AS BIGINT), 1) AS INTEGER) * {16 >> k}" for k in range(5))

#: Payload sizes, base32 SHA-1 digests, and which record the others of its payload revisit.
WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS original,
    array_to_string(list_transform(string_split(sha1(payload), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM d"""

#: Links by counting common shingles; components by reachability.
JACCARD = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.a = w.doc_id"""

#: Cosines of all pairs of a label.
VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS length FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.length * b.length) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
out AS (SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id
  FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM out"""

#: All products of the queries.
TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

def _codes(rounds: int = 4) -> str:
    """Rounds of assignment and means, one after another; whole numbers below 2^53 are exact in doubles."""
    nearest = """SELECT rid, part, min({{'d': d, 'e': entry}}) AS best FROM (SELECT q.rid, q.part, b.entry,
      list_inner_product(q.xs, q.xs) - 2 * list_inner_product(q.xs, b.c) + list_inner_product(b.c, b.c) AS d FROM q JOIN b{k} b ON b.part = q.part) GROUP BY rid, part"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        steps.append(f"""m{k} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM (SELECT a.part, a.best.e AS entry, i, floor(sum(q.xs[i]) / count(*)) AS x
      FROM a{k} a JOIN q ON q.rid = a.rid AND q.part = a.part, unnest(range(1, len(q.xs) + 1)) AS t(i) GROUP BY ALL) GROUP BY part, entry)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT rid, part, list_slice(x, part * (len(x) // 4) + 1, (part + 1) * (len(x) // 4)) AS xs FROM v, unnest(range(0, 4)) AS t(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, xs AS c FROM q WHERE rid <= 256),
{", ".join(steps)},
f AS ({nearest.format(k=rounds)}),
coded AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM f GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS sha FROM b{rounds})
SELECT v.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM coded JOIN v ON v.rid = coded.rid, books"""


CODES = _codes()

_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR z IN range(0, 8)]), lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d // 2, 3988292384) ELSE d // 2 END)), 4294967295)"""

#: Lags at which four words in a row of the lag's multiples are equal, then stretches between words that differ.
PERIODIC = f"""
WITH o AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS own FROM documents),
g AS (SELECT rid, doc_id, own, len(own) AS n, h % 10 = 0 AND len(own) > 0 AS again, CASE WHEN len(own) > 0 THEN (h // 10) % len(own) END AS a, h // 10 AS g FROM o),
w AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN again THEN list_transform(range(0, n), lambda i: own[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE own END AS words FROM g),
lags AS MATERIALIZED (SELECT rid, n, words, unnest(list_filter(range(1, n // 4 + 1), lambda q: len(list_filter(range(0, greatest((n - 1) // q - 2, 0)),
  lambda k: words[k * q + 1] = words[(k + 1) * q + 1] AND words[k * q + 1] = words[(k + 2) * q + 1] AND words[k * q + 1] = words[(k + 3) * q + 1])) > 0)) AS q FROM w),
ends AS (SELECT rid, q, list_concat([-1], list_filter(range(0, n - q), lambda i: words[i + 1] <> words[i + q + 1]), [n - q]) AS b FROM lags),
stretches AS (SELECT rid, q, unnest(list_transform(range(1, len(b)), lambda j: {{'s': b[j] + 1, 'l': b[j + 1] - b[j] - 1 + q}})) AS x FROM ends),
long AS MATERIALIZED (SELECT rid, x.s AS s, x.l AS l, q FROM stretches WHERE x.l >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long k WHERE k.rid = r.rid AND k.q < r.q AND r.q % k.q = 0 AND k.s <= r.s AND k.s + k.l >= r.s + r.l)),
best AS (SELECT rid, s, l, q FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY l / q DESC, s, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY rid),
gone AS (SELECT rid, list(DISTINCT i) AS drops FROM (SELECT rid, unnest(range(s + q, s + l)) AS i FROM runs) GROUP BY rid)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS "start", CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(array_to_string(CASE WHEN drops IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(drops, i - 1)) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN listed ON listed.rid = w.rid LEFT JOIN best ON best.rid = w.rid LEFT JOIN gone ON gone.rid = w.rid"""

ORACLES = {"op2_warc_salvage": WARC, "op6_jaccard_join": JACCARD, "op9_vector_near_dup": VECTORS, "op10_exact_top_k": TOP_K, "op11_vector_codes": CODES, "op13_periodic_runs": PERIODIC}
