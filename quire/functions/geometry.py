"""Box arithmetic as SQL expressions and columns.  Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(a: str, b: str) -> str:
    """a / b rounded half to even, for whole a >= 0 and b > 0, without floating point."""
    q = f"(({a}) div ({b}))"
    r = f"(({a}) - {q} * ({b}))"
    return f"({q} + CASE WHEN 2 * {r} > ({b}) OR (2 * {r} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def contains(region: str, word: str) -> str:
    """Whether the centre of a word box lies in a region box, edges included."""
    return f"({word}.x0 + {word}.x1 BETWEEN 2 * {region}.x0 AND 2 * {region}.x1 AND {word}.y0 + {word}.y1 BETWEEN 2 * {region}.y0 AND 2 * {region}.y1)"


def overlap_area(a: str, b: str) -> str:
    """The area that two boxes share."""
    side = lambda lo, hi: f"greatest(0, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}))"
    return f"CAST({side('x0', 'x1')} AS BIGINT) * {side('y0', 'y1')}"


def rescaled(df: DataFrame, factor: Column) -> DataFrame:
    """Boxes times a factor, half to even."""
    return df.withColumns({c: F.bround(F.col(c) * factor).cast("int") for c in ("x0", "y0", "x1", "y1")})


def shifted(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Boxes moved by the origin of a region."""
    return df.withColumns({"x0": F.col("x0") + x, "x1": F.col("x1") + x, "y0": F.col("y0") + y, "y1": F.col("y1") + y})


def page_scale(df: DataFrame, megapixels: float = 40.0, max_side: int = 4000) -> DataFrame:
    """(width, height) rows with scale, new_w, new_h.

    A page over the pixel limit shrinks by the root of the excess; if its longer side is then still
    over ``max_side`` (0: no limit), that limit replaces the scale.
    """
    pixels, longer = F.col("width") * F.col("height"), F.greatest("width", "height")
    by_area = F.when(pixels > megapixels * 1e6, F.sqrt(F.lit(megapixels * 1e6) / pixels)).otherwise(F.lit(1.0))
    scale = F.when((F.lit(max_side) > 0) & (longer * by_area > max_side), F.lit(float(max_side)) / longer).otherwise(by_area)
    small = scale < 1
    size = lambda c: F.when(small, F.greatest(F.lit(1), F.floor(F.col(c) * scale).cast("int"))).otherwise(F.col(c))
    return df.withColumns({"new_w": size("width"), "new_h": size("height"), "scale": F.when(small, size("width") / F.col("width")).otherwise(F.lit(1.0))})


def quad_box(points: Column) -> Column:
    """The box around the points of a polygon."""
    side = lambda f, i: f(F.transform(points, lambda p: p[i]))
    return F.struct(side(F.array_min, 0).alias("x0"), side(F.array_min, 1).alias("y0"), side(F.array_max, 0).alias("x1"), side(F.array_max, 1).alias("y1"))


def clipped(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut at the edges of the page."""
    cut = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), most)
    return df.withColumns({"x0": cut("x0", width), "x1": cut("x1", width), "y0": cut("y0", height), "y1": cut("y1", height)})
