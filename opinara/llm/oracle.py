"""SQL for the queries that SQL can express.

Not here: encoding and packing (public tokenizers), toxicity and licences
(trained models), sharding and SimHash (hash functions that the SQL engine
lacks).  Their tests hold them against plain Python.
"""

from __future__ import annotations

from opinara.llm import quality, url_filter

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

EXACT_DEDUP = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def url_sql(rules=url_filter.RULES, damping=url_filter.DAMPING, rounds=60) -> str:
    """A fixed number of rounds that leaves nothing to change: the query itself stops by growth."""
    whens, verdicts = [], []
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        whens.append(f"WHEN {fits} THEN '{host}{path}'")
        verdicts.append(f"WHEN {fits} THEN '{verdict}'")
    text = rf"""
WITH p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, html, lower(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p
), j AS (
  SELECT *, CASE {" ".join(whens)} END AS rule, CASE {" ".join(verdicts)} END AS ruled FROM q
), hosts AS (
  SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS trust, count(*) FILTER (ruled = 'block') / count(*) AS distrust
  FROM j WHERE host <> '' GROUP BY host
), found AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(https?://[^"''\s<>]+)', 1)) AS url FROM j
), links AS (
  SELECT src, lower(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*')) AS dst FROM found
), up AS (
  SELECT host, regexp_extract(host, '^[^.]+\.(.+)$', 1) AS parent FROM hosts
), edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT src, dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst
    UNION ALL SELECT host, parent FROM up WHERE contains(parent, '.')
    UNION ALL SELECT parent, host FROM up WHERE contains(parent, '.')) GROUP BY src, dst
), flows AS (
  SELECT kind, f, t, n / sum(n) OVER (PARTITION BY kind, f) AS share FROM (
    SELECT 'trust' AS kind, src AS f, dst AS t, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges)
), m0 AS MATERIALIZED (
  SELECT 'trust' AS kind, host, {1 - damping} * trust AS mass FROM hosts WHERE trust > 0
  UNION ALL SELECT 'distrust', host, {1 - damping} * distrust FROM hosts WHERE distrust > 0
)"""
    for i in range(1, rounds + 1):
        text += f""", m{i} AS MATERIALIZED (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT kind, host, mass FROM m0
    UNION ALL SELECT m.kind, t, mass * share * {damping} FROM m{i - 1} m JOIN flows ON m.kind = flows.kind AND host = f)
  GROUP BY kind, host
)"""
    return text + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (
    SELECT host FROM m{rounds} GROUP BY host
    HAVING coalesce(sum(mass) FILTER (kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (kind = 'trust'), 0) * {1 + url_filter.MARGIN}
  ) THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


def quality_sql(columns: str, limits: quality.Limits | None = None) -> str:
    """Base measures and verdict of every row of ``documents``; ``columns`` is the select list."""
    limits = limits or quality.Limits()
    bins = max(len(w) for w in limits.common_words.values())
    languages = ", ".join(f"'{name}'" for name in limits.common_words)
    counts = []
    for i in range(bins):
        whens = " ".join(f"WHEN '{name}' THEN '{words[i]}'" for name, words in limits.common_words.items())
        counts.append(f"len([x FOR x IN ws IF x = CASE language {whens} END]) / greatest(len(ws), 1) AS w{i}")

    def distance(names):
        def part(v, m):
            return f"CASE WHEN {v} > 0 THEN {v} * log2({v} / {m}) ELSE 0 END"

        terms = [f"({part('h.' + n, f'((h.{n} + r.{n}) / 2)')} + {part('r.' + n, f'((h.{n} + r.{n}) / 2)')}) / 2" for n in names]
        return f"coalesce(sqrt(greatest({' + '.join(terms)}, 0)), 0)"

    classes, words = [f"c{i}" for i in range(6)], [f"w{i}" for i in range(bins + 1)]
    (a, b), (c, e) = limits.class_distance, limits.word_distance
    return rf"""
WITH d AS (
  SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, CASE WHEN lang IN ({languages}) THEN lang ELSE '' END AS language
  FROM documents
), s AS (
  SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws FROM d
), b AS (
  SELECT *, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')])
           - len(list_distinct([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{_WORD}')])) AS n_dup_lines,
         {", ".join(counts)}
  FROM s
), win AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM s)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT rid, sum(k) AS n FROM (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS k FROM rep) GROUP BY rid
), marks AS (
  SELECT *, greatest(length(t), 1) AS n, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS capitals,
         length(regexp_replace(t, '[^\p{{N}}]', '', 'g')) AS digits,
         length(regexp_replace(t, '[^\p{{P}}\p{{S}}]', '', 'g')) - n_symbols AS others
  FROM b
), h AS (
  SELECT *, capitals / n AS c0, digits / n AS c1, n_symbols / n AS c2, others / n AS c3, (length(t) - word_chars) / n AS c4,
         (word_chars - capitals - digits - n_symbols - others) / n AS c5,
         1 - ({" + ".join(words[:-1])}) AS w{bins}
  FROM marks
), r AS (
  SELECT language, {", ".join(f"avg({x}) AS {x}" for x in classes + words)} FROM h WHERE n_words >= {limits.guard_words} GROUP BY language
), v AS (
  SELECT h.* EXCLUDE (n), coalesce(covered.n, 0)::BIGINT AS n_repeat_words, {distance(classes)} AS class_distance,
         CASE WHEN h.language = '' THEN 0 ELSE {distance(words)} END AS word_distance
  FROM h LEFT JOIN r ON h.language = r.language LEFT JOIN covered ON h.rid = covered.rid
), u AS (
  SELECT *, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.repeated_percent} * n_words AS base_failed FROM v
), judged AS (
  SELECT *, NOT base_failed AND (n_words < {limits.guard_words} OR (class_distance < {a} + {b} / sqrt(n_words)
         AND word_distance < {c} + {e} / sqrt(n_words))) AS kept
  FROM u
)
SELECT {columns} FROM judged
"""


CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(regexp_replace(role, '<(\\*)\|(role|turn|end)\|>', '<\\\1|\2|>', 'g')) AS role_chars,
         length(regexp_replace(text, '<(\\*)\|(role|turn|end)\|>', '<\\\1|\2|>', 'g')) AS text_chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(text_chars + CASE WHEN before IS NULL THEN 16 + role_chars WHEN before = role THEN 8 ELSE 23 + role_chars END)::BIGINT + 7 AS formatted_chars
FROM e GROUP BY conv_id
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""

ORACLE: dict[str, str] = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_url_filter": url_sql(),
    "op9_quality": quality_sql("doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"),
    "op10_chat": CHAT,
    "op11_hard_negatives": HARD_NEGATIVES,
}
