"""Spatial joins of words and regions, ink profiles, bands, and margin line numbers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains, overlap_area
from ..schema import LABEL_KINDS

WORD_COLUMNS = ["doc_id", "word_id", "text", "x0", "y0", "x1", "y1"]


def label_kind(label: Column) -> Column:
    """Region kind of a layout label."""
    kinds = F.create_map(*[F.lit(x) for x in chain.from_iterable(LABEL_KINDS.items())])
    return F.coalesce(F.element_at(kinds, label), F.lit("other"))


def sound_boxes(df: DataFrame) -> DataFrame:
    return df.where("x1 > x0 AND y1 > y0")


def page_boxes(regions: DataFrame, *more: str) -> DataFrame:
    """(doc_id, boxes): the sound regions of each page as one array in order of region_id."""
    return sound_boxes(regions).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("region_id", "x0", "y0", "x1", "y1", *more))).alias("boxes"))


#: The first region of ``boxes`` that holds the centre of the row's box, and the one that shares most area with it.
_HELD = f"array_min(transform(boxes, r -> CASE WHEN {contains('r', 'w')} THEN r.region_id END))".replace("w.", "")
_NEAR = f"array_min(filter(transform(boxes, r -> struct(-({overlap_area('r', 'w')}) AS far, r.region_id AS region_id)), s -> s.far < 0)).region_id".replace("w.", "")


def met(words: DataFrame, boxes: DataFrame, how: str) -> DataFrame:
    """``words`` with ``boxes`` of their page, and ``_held``, the region that holds their centre, worked out once.

    It passes through an outer explode of one item, below which no filter or projection of what is found can
    move: else each would scan the boxes again.
    """
    return words.join(boxes, "doc_id", how).select(*words.columns, "boxes", F.explode_outer(F.array(F.expr(_HELD))).alias("_held"))


def assign_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """``words`` with region_id and method: the first region that holds the word's centre, else the one of greatest overlap.

    The regions of a page come as one array, so each word meets them within its row: nothing is
    multiplied or grouped, and the partitioning of the words stays.  Only words that no region holds
    are compared by area.  Words that meet no region are left out.
    """
    near = F.explode_outer(F.array(F.expr(f"CASE WHEN _held IS NULL THEN {_NEAR} ELSE _held END")))
    hit = met(words, page_boxes(regions), "inner").select(*words.columns, "_held", near.alias("region_id")).where("region_id IS NOT NULL")
    return hit.select(*words.columns, "region_id", F.when(F.col("_held").isNull(), "overlap").otherwise("contains").alias("method"))


def claim_words(words: DataFrame, regions: DataFrame) -> DataFrame:
    """``words`` with region_id: the first region, figures aside, that holds the word's centre; null where none does."""
    return met(words, page_boxes(regions.where("kind <> 'figure'")), "left").drop("boxes").withColumnRenamed("_held", "region_id")


def placed(pages: DataFrame) -> DataFrame:
    """``pages``, rows (ws, boxes, ...) of whole pages, with ``placed``: words that meet a region as (w, held, region_id), by the rule of ``assign_words``.

    ``held`` is the region that holds the word's centre, null where area decides.
    """
    held = f"array_min(transform(boxes, r -> CASE WHEN {contains('r', 'w')} THEN r.region_id END))"
    near = f"array_min(filter(transform(boxes, r -> struct(-({overlap_area('r', 'p.w')}) AS far, r.region_id AS region_id)), s -> s.far < 0)).region_id"
    steps = f"transform(ws, w -> struct(w AS w, {held} AS held))", f"transform(placed, p -> struct(p.w AS w, p.held AS held, coalesce(p.held, {near}) AS region_id))", "filter(placed, p -> p.region_id IS NOT NULL)"
    for step in steps:
        pages = pages.withColumn("placed", F.expr(step))
    return pages


def claims(pages: DataFrame) -> DataFrame:
    """``pages`` with ``placed``: every word as (w, region_id), by the rule of ``claim_words``."""
    held = f"array_min(transform(boxes, r -> CASE WHEN r.kind <> 'figure' AND {contains('r', 'w')} THEN r.region_id END))"
    return pages.withColumn("placed", F.expr(f"transform(ws, w -> struct(w AS w, {held} AS region_id))"))


def placed_words(pages: DataFrame) -> DataFrame:
    """The words of ``placed`` a row each."""
    return pages.select("doc_id", F.explode_outer("placed").alias("p")).where("p IS NOT NULL").select("doc_id", "p.w.*", "p.region_id")


def region_words(pages: DataFrame) -> DataFrame:
    """``pages`` with ``rs``: regions as (r, own), each with its words of ``placed``."""
    return pages.withColumn("rs", F.expr("transform(boxes, r -> struct(r AS r, transform(filter(placed, p -> p.region_id = r.region_id), p -> p.w) AS own))"))


def may_be_line_number(page_width: int, max_width_fraction: float = 0.12) -> Column:
    return (F.col("x1") <= max_width_fraction * page_width) & F.trim("text").rlike("^[0-9]{1,4}$")


def line_number_run(words: DataFrame, page_width: int, max_width_fraction: float = 0.12, min_run: int = 3, edge_tolerance_fraction: float = 0.015) -> DataFrame:
    """(doc_id, word_id, value, step, y0): the words of each page's margin line-number run, if it has one.

    Candidates are ASCII numbers of up to 4 digits that end within the margin.  The edge of least
    spread (the right one on ties) aligns them; the first largest group within the tolerance of one of
    its members must hold ``min_run`` words, rise from top to bottom, and have steps that the least
    step divides.
    """
    tol = max(4, int(edge_tolerance_fraction * page_width))
    page = Window.partitionBy("doc_id")
    c = words.where(may_be_line_number(page_width, max_width_fraction))
    right, left = F.max("x1").over(page) - F.min("x1").over(page), F.max("x0").over(page) - F.min("x0").over(page)
    c = c.withColumns({"_edge": F.when(right <= left, F.col("x1")).otherwise(F.col("x0")), "_n": F.count(F.lit(1)).over(page)}).where(F.col("_n") >= min_run)
    c = c.withColumn("_near", F.count(F.lit(1)).over(page.orderBy("_edge").rangeBetween(-tol, tol)))
    anchor = F.max(F.struct(F.col("_near"), -F.col("word_id"), F.col("_edge"))).over(page)
    c = c.withColumn("_anchor", anchor).where((F.abs(F.col("_edge") - F.col("_anchor._edge")) <= tol) & (F.col("_anchor._near") >= min_run))
    order = page.orderBy("y0", "word_id")
    c = c.withColumn("value", F.trim("text").cast("int")).withColumn("_diff", F.col("value") - F.lag("value").over(order))
    c = c.withColumn("step", F.min("_diff").over(page))
    odd = F.max(F.when((F.col("_diff") <= 0) | (F.col("_diff") % F.greatest("step", F.lit(1)) != 0), 1).otherwise(0)).over(page)
    return c.withColumn("_odd", odd).where("step > 0 AND _odd = 0").select("doc_id", "word_id", "value", "step", "y0")


#: Edges of a page that are folded at a time.
_FOLDED = 128


def ink_spans(raster: DataFrame) -> DataFrame:
    """(doc_id, h, w, spans): the ink of each page's columns as a step function, ``spans`` of (x0, x1, ink) over [0, w).

    ``raster`` holds a page a row as (doc_id, h, w, rows), each row the ascending x where ink starts and
    ends by turns.  An edge counts one up or down.  The edges of a page are sorted within its row, and a running sum
    gives the ink: sums within pieces of ``_FOLDED`` edges, and sums of the pieces before.  Edges at the same x have
    empty spans between them, which go.  Nothing moves or waits but the row of a page.
    """
    turns = "flatten(transform(rows, e -> transform(e, (x, i) -> struct(x AS x, 1 - 2 * (i % 2) AS d))))"
    pieces = f"transform(sequence(0, (size(es) - 1) div {_FOLDED}), k -> slice(es, k * {_FOLDED} + 1, {_FOLDED}))"
    sums = f"transform({pieces}, p -> aggregate(p, struct(CAST(array() AS array<bigint>) AS upto, 0L AS total), (a, e) -> struct(concat(a.upto, array(a.total + e.d)) AS upto, a.total + e.d AS total)))"
    before = "aggregate(slice(sums, 1, k), 0L, (a, p) -> a + p.total)"
    pages = raster.withColumn("es", F.sort_array(F.expr(f"concat(array(struct(0 AS x, 0 AS d)), {turns})"))).withColumn("sums", F.expr(sums))
    pages = pages.withColumn("inks", F.expr(f"flatten(transform(transform(sums, (p, k) -> struct(p.upto AS upto, {before} AS before)), p -> transform(p.upto, u -> u + p.before)))"))
    spans = "filter(transform(es, (e, i) -> struct(e.x AS x0, coalesce(get(es, i + 1).x, w) AS x1, get(inks, i) AS ink)), s -> s.x1 > s.x0)"
    # Through an outer explode of one item, below which nothing that uses the spans can move and work them out anew.
    return pages.select("doc_id", "h", "w", F.explode_outer(F.array(F.expr(spans))).alias("spans"))


def ink_profile(raster: DataFrame) -> DataFrame:
    """(doc_id, x, ink): ink of each column of each page, with the empty ones."""
    return ink_spans(raster).select("doc_id", F.explode_outer("spans").alias("s")).where("s IS NOT NULL").select("doc_id", F.explode_outer(F.expr("sequence(s.x0, s.x1 - 1)")).alias("x"), "s.ink")


def with_gaps(pages: DataFrame, threshold: float, least: str) -> DataFrame:
    """``pages`` with ``gaps``: maximal runs of ``spans`` below ``threshold`` of their peak, of ``least`` length or more; none without ink."""
    low = f"s.ink < {threshold} * peak"
    edge = "transform(filter(spans, (s, i) -> {low} AND coalesce(get(spans, i {to}).ink >= {threshold} * peak, true)), s -> s.{at})"
    starts, ends = (F.expr(edge.format(low=low, threshold=threshold, to=to, at=at)) for to, at in (("- 1", "x0"), ("+ 1", "x1")))
    p = pages.withColumn("peak", F.expr("array_max(transform(spans, s -> s.ink))")).withColumn("gaps", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("gstart"), b.alias("gend"))))
    return p.withColumn("gaps", F.expr(f"filter(gaps, g -> g.gend - g.gstart >= {least})")).drop("peak")


def gap_runs(raster: DataFrame, threshold: float = 0.02, min_gap_fraction: float = 0.015) -> DataFrame:
    """(doc_id, gstart, gend): the gaps between columns of each page, ends exclusive."""
    gaps = with_gaps(ink_spans(raster), threshold, f"greatest(1, floor({min_gap_fraction} * w))")
    # Outer, since the filter that a plain explode implies would move below the peak and repeat it for each span.
    return gaps.select("doc_id", F.explode_outer("gaps").alias("g")).where("g IS NOT NULL").select("doc_id", "g.*")


def bands(total: str) -> Column:
    """The parts of [0, total) between and around ``gaps``, as (bstart, bend)."""
    parts = f"transform(sequence(0, size(gaps)), k -> struct(coalesce(get(gaps, k - 1).gend, 0) AS bstart, coalesce(get(gaps, k).gstart, {total}) AS bend))"
    return F.expr(f"filter({parts}, b -> b.bend > b.bstart)")


def page_bands(raster: DataFrame, min_gap_fraction: float = 0.015, threshold: float = 0.02, least_ink: float = 0.001) -> DataFrame:
    """(doc_id, h, w, bands): column bands with ink of each page, as (bstart, bend, ink) from the left."""
    pages = with_gaps(ink_spans(raster), threshold, f"greatest(1, floor({min_gap_fraction} * w))").withColumn("bands", bands("w"))
    ink = "aggregate(spans, 0L, (a, s) -> a + s.ink * greatest(0, least(s.x1, b.bend) - greatest(s.x0, b.bstart)))"
    inked = pages.select("doc_id", "h", "w", F.expr(f"transform(bands, b -> struct(b.bstart AS bstart, b.bend AS bend, {ink} AS ink))").alias("bands"))
    return inked.withColumn("bands", F.expr(f"filter(bands, b -> b.ink / (h * (b.bend - b.bstart)) > {least_ink})"))


def content_bands(raster: DataFrame) -> DataFrame:
    """(doc_id, bstart, bend, ink): column bands with ink, a row each."""
    return page_bands(raster).select("doc_id", F.explode_outer("bands").alias("b")).where("b IS NOT NULL").select("doc_id", "b.*")


def row_bands(columns: DataFrame) -> DataFrame:
    """``columns``, (h, rows, b) of pages, with ``n_lines``: bands of rows with ink within the column band ``b``."""
    cut = "aggregate(e, struct(0 AS ink, -1 AS sign), (a, x) -> struct(a.ink + a.sign * least(greatest(x, b.bstart), b.bend) AS ink, -a.sign AS sign), a -> a.ink)"
    rows = columns.withColumn("spans", F.expr(f"transform(rows, (e, y) -> struct(y AS x0, y + 1 AS x1, {cut} AS ink))"))
    return with_gaps(rows, 0.05, "3").withColumn("n_lines", F.size(bands("h"))).drop("spans", "gaps")


def segment_pages(raster: DataFrame, margin_fraction: float = 0.12) -> DataFrame:
    """(doc_id, order_index, kind, x0, x1, column_index, layout_type): margin, columns from the left, then figures.

    Figures are dense bands or those of few lines; text is four thin lines or more.  A page of one band or
    none is one full page.
    """
    found = page_bands(raster).select("doc_id", F.posexplode_outer(F.expr("CASE WHEN size(bands) > 1 THEN bands END")).alias("at", "b"))
    cols = row_bands(raster.join(found, "doc_id")).withColumn("width", F.expr("b.bend - b.bstart"))
    n = F.col("n_lines")
    margin = (F.col("at") == 0) & (F.col("width") / F.col("w") <= margin_fraction)
    text = (n >= 4) & (F.col("h") / n < 0.15 * F.col("h"))
    figure = (F.col("b.ink") / (F.col("h") * F.col("width")) > 0.12) | (n <= 2)
    cols = cols.withColumn("kind", F.when(F.col("b").isNull(), "full_page").when(margin, "margin_numbers").when(text, "column").when(figure, "figure").otherwise("column"))
    cols = cols.select("doc_id", "kind", F.coalesce("b.bstart", F.lit(0)).alias("x0"), F.coalesce("b.bend", "w").alias("x1"), F.when(F.col("kind") == "margin_numbers", 0).when(F.col("kind") == "column", 1).otherwise(2).alias("place"))
    page = Window.partitionBy("doc_id")
    column = F.when(F.col("kind") == "column", F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("x0")) - 1)
    kind = F.when(F.col("kind") == "full_page", "single_column").when(F.min("place").over(page) == 0, "two_column_margin").otherwise("other")
    return cols.select("doc_id", (F.row_number().over(page.orderBy("place", "x0")) - 1).alias("order_index"), "kind", "x0", "x1", column.alias("column_index"), kind.alias("layout_type"))


def otsu_threshold(pixels: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold): the value that parts a histogram with the greatest between-class variance, the least on ties."""
    w = Window.partitionBy(key)
    h = pixels.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col(value)).over(upto), "nt": F.sum("n").over(w), "st": F.sum(F.col("n") * F.col(value)).over(w)}).where("n0 < nt")
    d = F.col("s0") * F.col("nt") - F.col("st") * F.col("n0")
    score = d.cast("double") * d.cast("double") / (F.col("n0").cast("double") * (F.col("nt") - F.col("n0")).cast("double"))
    return h.groupBy(key).agg(F.max_by(F.col(value), F.struct(F.round(score, 6), -F.col(value))).alias("threshold"))


def reading_order(regions: DataFrame) -> DataFrame:
    """Rows (doc_id, bucket, region_id) numbered 0.. in order: leading 0, regions 1, trailing 2."""
    return regions.withColumn("order_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("bucket", "region_id")) - 1)


def layout_type(kinds: DataFrame) -> DataFrame:
    """(doc_id, layout_type) of region rows (doc_id, kind)."""
    n, margin = F.count(F.lit(1)), F.bool_or(F.col("kind") == "margin_numbers")
    return kinds.groupBy("doc_id").agg(F.when(margin, "two_column_margin").when(n <= 1, "single_column").otherwise("other").alias("layout_type"))
