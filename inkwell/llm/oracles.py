"""DuckDB SQL of the operators that SQL can express.

The others have none: tokenizers (2, 3), boosted trees (4), a trained model
(5), license templates by relative position (6), base 32 (7) and XXH64 (9)
are outside of SQL; their tests compare with brute force.
"""

from __future__ import annotations

# Fixed patterns: kind, pattern, and the condition on a match x.
_SECRETS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "len(regexp_extract(x, {p}, 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "len(x) >= 20"),
    ("hex", r"[0-9a-f]{24,}", "TRUE"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "TRUE"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "TRUE"),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", "TRUE"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", "TRUE"),
)


def _secrets() -> str:
    found = "\nUNION ALL\n".join(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, x, start FROM (
  SELECT doc_id, m[i] AS x, CAST(list_sum(list_transform(g[1:i], lambda y: len(y)))
    + COALESCE(list_sum(list_transform(m[1:i - 1], lambda y: len(y))), 0) AS BIGINT) AS start
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM texts) f,
    unnest(range(1, len(m) + 1)) AS u(i)) WHERE {ok.format(p=f"'{p}'")}""" for rank, (kind, p, ok) in enumerate(_SECRETS))
    spans = "string_agg(kind || ':' || start || ':' || (start + len(x)), ',' ORDER BY start, rank)"
    return f"""WITH texts AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
found AS ({found}),
per AS (SELECT doc_id, COUNT(*) FILTER (WHERE rank = 0) AS a, COUNT(*) FILTER (WHERE rank = 1) AS b,
  COUNT(*) FILTER (WHERE rank = 2) AS c, {spans} FILTER (WHERE rank < 3) AS base, {spans} AS spans FROM found GROUP BY doc_id)
SELECT doc_id, COALESCE(a, 0) AS n_assign, COALESCE(b, 0) AS n_access, COALESCE(c, 0) AS n_hex,
  sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM texts LEFT JOIN per USING (doc_id)"""


_QUALITY = r"""WITH d AS (SELECT doc_id, COALESCE('=' || lang, 'null') AS stratum, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tokens AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w),
threes AS (SELECT doc_id, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM tokens WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM threes WHERE c IS NOT NULL),
repeats AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM windows, unnest([0, 1, 2]) AS v(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, stratum, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    COALESCE(repeats.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '!')) AS n_bangs, len(l) AS n_lines
  FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN repeats USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [
    n_symbols / greatest(n_words, 1), n_bangs / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1),
    n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1), -(word_chars / greatest(n_words, 1))] AS metric FROM m),
grid AS (SELECT rule, CAST(cut AS DOUBLE) AS cut, row_number() OVER (PARTITION BY rule ORDER BY cut DESC) AS g FROM (VALUES
    (1, [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12]), (2, [2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12]),
    (3, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35]), (4, [0.45, 0.4, 0.35, 0.3, 0.25, 0.2]),
    (5, [20.0, 15.0, 12.0, 10.0, 9.0]), (6, [-2.0, -2.5, -3.0, -3.5])) AS t(rule, cuts), unnest(cuts) AS c(cut)),
truth AS (SELECT doc_id, MIN(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING MIN(quality) = MAX(quality)),
labelled AS (SELECT stratum, metric, good = 1 AS good FROM r JOIN truth USING (doc_id) WHERE NOT base_failed),
counts AS (SELECT stratum, rule, cut, g, COUNT(*) FILTER (WHERE good) AS n_good, COUNT(*) FILTER (WHERE NOT good) AS n_bad,
    COUNT(*) FILTER (WHERE good AND metric[rule] > cut) AS k, COUNT(*) FILTER (WHERE NOT good AND metric[rule] > cut) AS bad
  FROM labelled, grid GROUP BY ALL),
proven AS (SELECT * FROM counts WHERE k < 0.02 / 6 * n_good AND bad * n_good > k * n_bad
  AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1)
    + i * ln(0.02 / 6) + (n_good - i) * ln(1 - 0.02 / 6)))) <= 0.05 / (SELECT COUNT(*) FROM counts)),
chosen AS (SELECT stratum, rule, cut FROM proven QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad DESC, g) = 1),
rejected AS (SELECT DISTINCT doc_id FROM r JOIN chosen USING (stratum) WHERE metric[rule] > cut)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rejected.doc_id IS NULL AS kept
FROM r LEFT JOIN rejected ON rejected.doc_id = r.doc_id"""

_EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT vec_id, MIN(other) AS component_id FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, COALESCE(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degree USING (vec_id)"""

SQL: dict[str, str] = {
    "op1_secret_scan": _secrets(),
    "op8_embedding_dedup": _EMBEDDINGS,
    "op10_quality_rules": _QUALITY,
}
