"""Proportional splitting of recognized lines and blocks into word boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import half_even


#: Tokens of a line, and the line as they make it up; both within rows, so nothing is sorted, shuffled or held beyond a page.
_TOKENS = r"filter(split({0}, '[\\x09-\\x0d\\x20]+'), t -> t <> '')"
_STARTS = "concat(array(0), filter(transform(split({0}, ''), (c, i) -> IF(c = ' ', i + 1, -1)), p -> p >= 0))"


def _boxed(ts: str, starts: str, total: str, box: str = "") -> str:
    """Words (tok_no, text, x0, y0, x1, y1) of tokens that start at ``starts`` of ``total`` characters, in a box whose edges ``box`` qualifies."""
    x0, y0, x1, y1 = (f"{box}{c}" for c in ("x0", "y0", "x1", "y1"))
    at = f"CAST(get({starts}, i) AS BIGINT)"
    # Half-even a / b is (2 a + b) div 2 b, less one where that is exact and odd; twice a plus b is worked out once.
    twice = f"transform({ts}, (t, i) -> struct(t AS t, 2 * ({x1} - {x0}) * {at} + {total} AS a, 2 * ({x1} - {x0}) * ({at} + length(t)) + {total} AS b))"
    even = lambda m: f"(e.{m} div (2 * {total}) - IF(e.{m} % (2 * {total}) = 0 AND e.{m} div (2 * {total}) % 2 = 1, 1, 0))"
    edges = f"transform({twice}, e -> struct(e.t AS t, {even('a')} AS a, {even('b')} AS b))"
    whole = f"(size({ts}) = 1 OR {x1} <= {x0})"
    return f"transform({edges}, (e, i) -> struct(i AS tok_no, e.t AS text, CAST(IF({whole}, {x0}, {x0} + e.a) AS INT) AS x0, {y0} AS y0, CAST(IF({whole}, {x1}, {x0} + greatest(e.b, e.a + 1)) AS INT) AS x1, {y1} AS y1))"


def split_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Words of lines (keys, text, x0, y0, x1, y1): tok_no, text and a box whose width follows the characters.

    Spaces count as one character.  A single token, or a line of no width, keeps the whole box; every
    word is one pixel wide at least.  A word's offset is the place of the space before it in the line.
    """
    cut = lines.withColumn("_ts", F.expr(_TOKENS.format("text"))).withColumn("_s", F.array_join("_ts", " "))
    cut = cut.withColumns({"_total": F.length("_s").cast("long"), "_at": F.expr(_STARTS.format("_s"))})
    each = cut.select(*keys, F.explode_outer(F.expr(_boxed("_ts", "_at", "_total"))).alias("w")).where("w IS NOT NULL")
    return each.select(*keys, "w.*")


def line_words(blocks: DataFrame) -> DataFrame:
    """``blocks`` (text, x0, y0, x1, y1, ...) with ``ls``, their lines with a word as (line_no, ws) of words; text and box go.

    Blank lines go, the others become strips of equal height.
    """
    edge = lambda i: f"CAST(y0 + {half_even(f'(y1 - y0) * CAST({i} AS BIGINT)', '_n')} AS INT)"
    cut = blocks.withColumn("_lines", F.expr("filter(split(text, '\n'), x -> trim(x) <> '')")).withColumn("_n", F.size("_lines").cast("long"))
    steps = (
        "transform(_lines, (x, n) -> struct(n AS line_no, " + _TOKENS.format("x") + f" AS ts, x0 AS x0, {edge('n')} AS y0, x1 AS x1, {edge('n + 1')} AS y1))",
        "transform(_ls, l -> struct(l AS l, array_join(l.ts, ' ') AS s))",
        "transform(_ls, l -> struct(l.l AS l, CAST(length(l.s) AS BIGINT) AS total, " + _STARTS.format("l.s") + " AS starts))",
        "transform(_ls, l -> struct(l.l.line_no AS line_no, " + _boxed("l.l.ts", "l.starts", "l.total", "l.l.") + " AS ws))",
    )
    for step in steps:
        cut = cut.withColumn("_ls", F.expr(step))
    rest = [c for c in blocks.columns if c not in ("text", "x0", "y0", "x1", "y1")]
    return cut.select(*rest, F.expr("filter(_ls, l -> size(l.ws) > 0)").alias("ls"))


def split_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Words of blocks: lines first, then words."""
    each = line_words(blocks).select(key, F.explode_outer("ls").alias("l")).where("l IS NOT NULL").select(key, "l.line_no", F.explode_outer("l.ws").alias("w"))
    return each.select(key, "line_no", "w.*")
