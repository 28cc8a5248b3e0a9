"""DuckDB SQL for the operators that SQL can state."""

from __future__ import annotations

from marketlens.llm import licences, mixing


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOP_K = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.r AS query, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM good q JOIN good c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def licence_scan(least: float = licences.LEAST) -> str:
    values = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(licences.TEMPLATES))

    def pairs(text: str) -> str:
        ws = f"list_filter(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
        return f"""(SELECT CASE WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)),
            lambda i: ws[i] || ' ' || ws[i + 1])) END FROM (SELECT {ws} AS ws))"""

    return f"""
WITH t AS (SELECT licence, {pairs('text')} AS tp FROM (VALUES {values}) v(template, licence, text)),
u AS (SELECT DISTINCT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'),
        string_split(text, chr(10)))) AS unit FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unit, {pairs('unit')} AS up FROM u WHERE length(unit) < 4000),
s AS (SELECT doc_id, licence, unit, 2 * len(list_intersect(up, tp)) / (len(up) + len(tp))::DOUBLE AS score
      FROM p JOIN t ON len(up) >= len(tp) * {least} / (2 - {least}) AND len(up) <= len(tp) * (2 - {least}) / {least}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, licence ORDER BY score DESC, unit) AS n FROM s WHERE score >= {least})
SELECT doc_id, licence, round(score, 6) AS score, unit FROM r WHERE n = 1
"""


def mixture(targets: mixing.Targets = mixing.Targets(), rounds: int = 24) -> str:
    dims = mixing.DIMENSIONS
    count = lambda pattern: f"len(regexp_extract_all(text, '{pattern}'))"
    steps = []
    for d, power in zip(dims, targets.exponents):
        steps.append(
            f"""own_{d} AS (SELECT {d}, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM cells) AS own FROM cells GROUP BY {d}),
            raw_{d} AS (SELECT {d}, least(pow(own, {power}) / (SELECT sum(pow(own, {power})) FROM own_{d}), own * {targets.boost}) AS raw FROM own_{d}),
            goal_{d} AS (SELECT {d}, raw / (SELECT sum(raw) FROM raw_{d}) AS goal_{d} FROM raw_{d})"""
        )
    goals = " ".join(f"JOIN goal_{d} ON cells.{d} IS NOT DISTINCT FROM goal_{d}.{d}" for d in dims)
    columns = ", ".join(f"goal_{d}" for d in dims)
    steps.append(
        f"start AS (SELECT cells.*, {columns}, tokens::DOUBLE / (SELECT sum(tokens) FROM cells) AS w FROM cells {goals})"
    )
    last = "start"
    for i in range(rounds):
        for d in dims:
            name = f"r{i}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (w * goal_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM {last})")
            last = name
    return f"""
WITH m AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, source, lang, CASE
    WHEN {count('[0-9]')} / greatest(length(text), 1)::DOUBLE >= 0.03 THEN 'figures'
    WHEN {count('[#$%&*=<>{}|_]')} / greatest(length(text), 1)::DOUBLE >= 0.03 THEN 'symbols'
    WHEN length(text) < 600 THEN 'brief' ELSE 'prose' END AS topic,
    {count('[^ \\t\\n\\r]+')} AS n_tokens FROM m),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{', '.join(steps)},
p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS probability FROM {last})
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(probability, 1.0), 6) AS probability,
  CASE WHEN coalesce(probability, 1.0) >= 1.0 THEN 1 WHEN
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{targets.seed}'), 1, 13) AS BIGINT) / 4503599627370496.0
      < probability THEN 1 ELSE 0 END AS copies, copies = 1 AS kept
FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang
  AND d.topic IS NOT DISTINCT FROM p.topic
"""
