"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under the name of its function."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def he(a: str, b: str) -> str:
    """Half-even a / b in the SQL of the oracle."""
    q = f"(({a}) // ({b}))"
    r = f"(({a}) - {q} * ({b}))"
    return f"({q} + CASE WHEN 2 * {r} > ({b}) OR (2 * {r} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


#: The derived words, regions and their assignment, as the oracle states them.
WORDS = f"""
lines0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM lines0 WHERE trim(line) <> ''),
lists AS (SELECT doc_id, line_no, n, list_filter(string_split(line, ' '), lambda x: x <> '') AS ts FROM lines),
toks0 AS (SELECT doc_id, line_no, n, len(ts) AS m, length(array_to_string(ts, ' ')) AS total, unnest(ts) AS text, generate_subscripts(ts, 1) - 1 AS tok_no FROM lists),
toks AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM toks0),
words AS (SELECT doc_id, line_no, tok_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, tok_no) - 1 AS word_id, text,
  CASE WHEN m = 1 THEN 200 ELSE 200 + {he("2080 * pos", "total")} END AS x0, 200 + {he("3108 * line_no", "n")} AS y0,
  CASE WHEN m = 1 THEN 2280 ELSE greatest(200 + {he("2080 * (pos + length(text))", "total")}, 200 + {he("2080 * pos", "total")} + 1) END AS x1, 200 + {he("3108 * (line_no + 1)", "n")} AS y1,
  CAST(40 + (doc_id * 7919 + line_no * 104729 + tok_no * 1299709) % 61 AS DOUBLE) AS confidence,
  CAST(40 + (doc_id * 6151 + line_no * 49157 + tok_no * 786433) % 61 AS DOUBLE) AS confidence2 FROM toks)"""
REGIONS = """
kinds(region_id, kind, rx0, ry0, rx1, ry1) AS (VALUES (0, 'margin_numbers', 0, 0, 297, 3508), (1, 'title', 200, 200, 2280, 1236), (2, 'column', 200, 1236, 2280, 2272),
  (3, 'table', 1200, 1800, 2280, 2400), (4, 'column', 200, 2272, 2280, 3000), (5, 'figure', 1500, 3000, 2280, 3250)),
regs AS (SELECT doc_id, lang, source, kinds.* FROM documents, kinds)"""
ASSIGNED = (
    WORDS
    + ","
    + REGIONS
    + """,
hits AS (SELECT w.doc_id, w.word_id, k.region_id, (x0 + x1 BETWEEN 2 * rx0 AND 2 * rx1 AND y0 + y1 BETWEEN 2 * ry0 AND 2 * ry1) AS inside,
  greatest(0, least(x1, rx1) - greatest(x0, rx0)) * greatest(0, least(y1, ry1) - greatest(y0, ry0)) AS area FROM words w, kinds k),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, word_id ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE -area END, region_id) AS r FROM hits WHERE inside OR area > 0),
asg AS (SELECT w.*, b.region_id, b.inside FROM words w JOIN best b USING (doc_id, word_id) WHERE r = 1)"""
)
#: Reconciled regions with the summary of the winner's words.
RECONCILED = (
    ASSIGNED
    + """,
rec AS (SELECT doc_id, region_id, count(*) AS n, avg(confidence) AS mean1, avg(confidence2) AS mean2, CASE WHEN avg(confidence2) > avg(confidence) THEN 'secondary' ELSE 'primary' END AS winner FROM asg GROUP BY doc_id, region_id),
won AS (SELECT a.*, r.winner, CASE WHEN winner = 'secondary' THEN confidence2 ELSE confidence END AS c FROM asg a JOIN rec r USING (doc_id, region_id)),
regqc AS (SELECT g.doc_id, g.lang, g.source, g.region_id, g.kind, CASE WHEN g.kind = 'figure' THEN NULL WHEN any_value(w.winner) IS NULL THEN 'primary' ELSE any_value(w.winner) END AS winner,
  CASE WHEN g.kind = 'figure' THEN NULL ELSE coalesce(avg(w.c), 0.0) END AS mean, CASE WHEN g.kind = 'figure' THEN NULL ELSE coalesce(min(w.c), 0.0) END AS lowest,
  count(w.c) AS n_words, CASE WHEN g.kind = 'figure' THEN NULL ELSE coalesce(avg(CASE WHEN w.c < 45 THEN 1.0 WHEN w.c IS NOT NULL THEN 0.0 END), 1.0) END AS low_fraction, g.kind = 'figure' AS skipped
  FROM regs g LEFT JOIN won w ON g.doc_id = w.doc_id AND g.region_id = w.region_id GROUP BY g.doc_id, g.lang, g.source, g.region_id, g.kind),
pageqc AS (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE 'deu,eng,fra' END AS languages,
  CASE WHEN bool_or(kind = 'margin_numbers' AND n_words > 0) THEN 'two_column_margin' WHEN count(*) FILTER (WHERE n_words > 0) <= 1 THEN 'single_column' ELSE 'other' END AS layout_type,
  count(*) AS n_regions, sum(n_words) AS n_words, bool_or(NOT skipped AND n_words > 0 AND low_fraction >= 0.15) AS flagged, avg(mean) AS mean_confidence
  FROM regqc GROUP BY doc_id, lang, source)"""
)
