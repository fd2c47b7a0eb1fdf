"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


#: Every 50-byte window by the digest of its hex text; runs of removed bytes; what is left between them.
OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, unnest(generate_series(0, length(h) // 2 - 50)) AS k,
         unnest(list_transform(generate_series(0, length(h) // 2 - 50), lambda k: md5_number(substr(h, 2 * k + 1, 100)))) AS s FROM d),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, k FROM w JOIN first USING (s) WHERE least < doc_id),
marked AS (SELECT *, k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS step FROM gone),
grouped AS (SELECT *, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM marked),
spans AS (SELECT doc_id, min(k) AS lo, max(k) + 50 AS hi FROM grouped GROUP BY doc_id, run),
parts AS (
  SELECT doc_id, lo, substr(h, 2 * before + 1, 2 * (lo - before)) AS piece
  FROM (SELECT s.doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) AS before, h FROM spans s JOIN d USING (doc_id))
  UNION ALL
  SELECT doc_id, length(h), substr(h, 2 * last + 1) FROM (SELECT d.doc_id, h, coalesce(max(hi), 0) AS last FROM d LEFT JOIN spans USING (doc_id) GROUP BY ALL)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY lo) AS h FROM parts GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, (length(d.h) - length(k.h)) // 2 AS n_removed, (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_spans,
       sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k USING (doc_id)"""

#: Occurrences of item windows as joins of word n-grams, by their length.
OP8 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_lowered("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS g
  FROM bw, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) AS u(k)),
hit AS (SELECT doc_id, k, occ.n, item_id FROM occ JOIN win ON occ.n = win.n AND occ.g = win.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, k, n FROM hit), unnest(generate_series(k, k + n - 1)) AS u(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Overlaps by a join of shingles; components by a walk over links.
OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_lowered("text")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS u(k) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp USING (doc_id) LEFT JOIN size USING (doc_id)"""

_EITHER = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN = f"""({_EITHER})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SAME = "|".join(f"[{c}]{{6}}" for c in _LOWER + "0123456789_+/.=-")
_HINT = f"(?i)example|sample|dummy|change.?me|placeholder|your|redacted|x{{5}}|12345|abcdef|{_SAME}"
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, generate_subscripts(regexp_extract_all(text, '{p}'), 1) AS k, string_split_regex(text, '{p}') AS b FROM d"
    for k, p in enumerate((_ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9_+/.=-]{20,}"))
)

#: Places as running sums of lengths, candidates outside base spans, and owners of each value.
OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '?') AS source, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, kind, k, m, length(b[k]) AS gap FROM ({_MATCHES})),
p AS (SELECT doc_id, kind, m, sum(gap + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS e FROM m),
v AS (SELECT doc_id, kind, e - length(m) AS s, e, CASE kind WHEN 0 THEN regexp_extract(m, '{_ASSIGN}', 2) ELSE m END AS v FROM p),
t AS (SELECT doc_id, kind, v, CASE WHEN kind = 3 THEN s + length(v) - length(ltrim(v, '+/_.=-')) ELSE s END AS s,
             CASE WHEN kind = 3 THEN e - (length(v) - length(rtrim(v, '+/_.=-'))) ELSE e END AS e, trim(v, '+/_.=-') AS w FROM v WHERE kind > 0 OR length(v) >= 6),
c AS (SELECT * FROM t WHERE kind < 3 OR length(w) >= 20 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = t.doc_id AND b.kind < 3 AND b.s < t.e AND b.e > t.s)),
f AS (
  SELECT *, length(w) AS n, length(regexp_replace(w, '[^0-9]', '', 'g')) AS digits, regexp_matches(w, '{_HINT}') AS hint,
         coalesce(round(list_sum(list_transform(list_distinct(string_split(w, '')), lambda x: -(n - length(replace(w, x, ''))) / n * log2((n - length(replace(w, x, ''))) / n))), 9), 0) AS bits FROM c),
g AS (SELECT *, digits > 0 AND digits < n AND NOT hint AND n >= 12 AND bits >= 2.8 AS live FROM f),
a AS (SELECT *, live AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[/.]') AND digits >= 3 AND n >= 24 AND bits >= 3.8 AS alone FROM g),
o AS (SELECT w, count(DISTINCT source) AS owners, bool_or(kind < 3) AS labelled, bool_or(hint) AS hint, bool_or(live) AS live FROM a JOIN d USING (doc_id) GROUP BY w),
j AS (
  SELECT doc_id, kind, s, e, kind < 3 AS base, CASE WHEN o.hint OR owners >= 3 THEN 'example' WHEN o.live AND owners = 1 THEN 'live' ELSE 'unclear' END AS verdict, labelled, alone
  FROM a JOIN o USING (w)),
r AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS span FROM j WHERE base OR verdict = 'live' AND (labelled OR alone)),
x AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS h, string_agg(span, ',' ORDER BY s, kind) FILTER (base) AS base,
         string_agg(span, ',' ORDER BY s, kind) AS spans, count(*) FILTER (verdict = 'live') AS l, count(*) FILTER (verdict = 'example') AS y, count(*) FILTER (verdict = 'unclear') AS u
  FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(l, 0) AS n_live, coalesce(y, 0) AS n_example, coalesce(u, 0) AS n_unclear
FROM d LEFT JOIN x USING (doc_id)"""

ORACLES = {"op5_suffix": OP5, "op8_decontamination": OP8, "op10_neardup": OP10, "op11_secrets": OP11}
