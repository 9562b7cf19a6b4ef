"""Enumerations and fixed tables of the document model."""

from __future__ import annotations

# Region kinds, layout types, file statuses.
REGION_KINDS = ("margin_numbers", "column", "figure", "formula", "table", "title", "full_page", "other")
LAYOUT_TYPES = ("single_column", "two_column_margin", "other")
STATUSES = ("queued", "processing", "done", "flagged", "failed")
STABLE_STATUSES = ("done", "flagged")

# Layout labels and their region kinds; any other label is "other".
LABEL_KINDS = {
    "text": "column",
    "paragraph_title": "title",
    "doc_title": "title",
    "abstract": "column",
    "content": "column",
    "header": "other",
    "footer": "other",
    "number": "other",
    "footnote": "column",
    "formula": "formula",
    "algorithm": "formula",
    "table": "table",
    "image": "figure",
    "figure": "figure",
    "chart": "figure",
    "figure_title": "title",
    "table_title": "title",
    "seal": "other",
}

# Two-letter language codes and the recognizer's codes.
LANGUAGE_CODES = {"en": "eng", "de": "deu", "fr": "fra"}

WORD = "text STRING, x0 INT, y0 INT, x1 INT, y1 INT, confidence DOUBLE, engine STRING"
PAGE_WIDTH, PAGE_HEIGHT = 2480, 3508
BLOCK = (200, 200, 2280, 3308)
