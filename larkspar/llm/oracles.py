"""DuckDB forms of the operators that SQL can state, over whole tables and by brute force.

Vectors: every pair of a label, then reachability. Repeats: the digest of every 200-byte string at every place, where
the digest stands for the string. Secrets: places from running lengths between marks; every pair of parts of a text.
The other operators (alignment, sketches, packing, segmentation, a fitted model, an approximate search) are no SQL.
"""

from __future__ import annotations

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings
), usable AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e) THEN list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93 ELSE false END
), reach AS (
  SELECT vec_id AS node, vec_id AS met FROM v
  UNION
  SELECT node, w FROM reach JOIN links ON met = u
), component AS (
  SELECT node, min(met) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN component ON vec_id = node LEFT JOIN degree ON vec_id = u
"""

REPEATS = """
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (
  SELECT rid, c, substr(h, 2000 * c + 1, 2398) AS part FROM (SELECT rid, h, unnest(range(0, length(h) // 2000 + 1)) AS c FROM t)
), places AS (
  SELECT rid, 1000 * c + i AS i, md5_number(substr(part, 2 * i + 1, 400)) AS w
  FROM (SELECT rid, c, part, unnest(range(0, least(1000, length(part) // 2 - 199))) AS i FROM chunks)
), twice AS (
  SELECT w FROM places GROUP BY w HAVING count(*) > 1
), starts AS (
  SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS step FROM places SEMI JOIN twice USING (w)
), numbered AS (
  SELECT rid, i, count(*) FILTER (step IS NULL OR step > 200) OVER (PARTITION BY rid ORDER BY i) AS run FROM starts
), runs AS (
  SELECT rid, run, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY rid, run
), gaps AS (
  SELECT rid, run, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY run), 0) AS since FROM runs
), cut AS (
  SELECT rid, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last,
         string_agg(substr(h, 2 * since + 1, 2 * (s - since)), '' ORDER BY run) AS head
  FROM gaps JOIN t USING (rid) GROUP BY rid
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut USING (rid)
"""


def _either(words: str) -> str:
    """ASCII letters in either case; the flag of the pattern engine would also fold other letters."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# The patterns of the kinds.
_HEAD = "(?:" + _either("password|passwd|secret|token|api_?key") + r""")["'']?\x20*[:=]\x20*["'']?"""
_KINDS = [
    ("assign", _HEAD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(p, '^{_HEAD}', '')) >= 8"),
    ("access", "AKIA[A-Z0-9]+", "length(p) >= 16"),
    ("hex", "[0-9a-f]+", "length(p) >= 32"),
    ("weak_key", "[A-Za-z0-9+/]+", "length(p) >= 40 AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[A-Z]')"),
    ("weak_id", "(?:" + _either("client_id|access_id|account_id|username|login") + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}""", "true"),
    ("endpoint", "(?:" + "|".join(["[hH][tT][tT][pP][sS]?", "[jJ][dD][bB][cC]:[A-Za-z]+", _either("ftp|postgres|postgresql|mysql|mongodb|redis|amqp")]) + ")://[A-Za-z0-9._~:/?#@%&=+-]+", "true"),
]

SECRETS = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents
), marked AS (
  {" UNION ALL ".join(f"SELECT rid, {k} AS k, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM t" for k, (_, pattern, _) in enumerate(_KINDS))}
), parts AS (
  SELECT rid, k, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM marked WHERE len(parts) > 1
), placed AS (
  SELECT rid, k, p, i, sum(length(p)) OVER (PARTITION BY rid, k ORDER BY i)::BIGINT AS e FROM parts
), hits AS (
  SELECT rid, k, e - length(p) AS s, e, ['secret', 'id', 'secret', 'secret', 'id', 'endpoint'][k + 1] AS part FROM placed
  WHERE i % 2 = 0 AND CASE k {" ".join(f"WHEN {k} THEN {test}" for k, (_, _, test) in enumerate(_KINDS))} END
), found AS (
  SELECT rid, k, s, e FROM hits WHERE k < 3
  UNION
  SELECT a.rid, a.k, a.s, a.e FROM hits a JOIN hits b ON a.rid = b.rid AND b.s <= a.e + 200 AND b.e >= a.s - 200
  WHERE a.k = 3 AND b.part IN ('id', 'endpoint') OR a.k IN (4, 5) AND b.part = 'secret'
), labelled AS (
  SELECT rid, k, s, {[name for name, _, _ in _KINDS]}[k + 1] || ':' || s || ':' || e AS span FROM found
), joined AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM labelled GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN joined USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": VECTORS, "op6_suffix_array_dedup": REPEATS, "op9_secret_scan": SECRETS}
