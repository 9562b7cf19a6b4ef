"""Recognizers as table functions: a page in, positioned words out.

No recognition model is bundled.  A recognizer is a callable over the texts of a batch of pages; one
instance lives in each worker process, for all tasks that it runs.  A failing batch is retried page by page,
and a page that fails alone yields no words.  ``register`` gives SQL the table function
``recognize(TABLE(pages), name, batch_size)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf

Word = tuple[str, int, int, int, int, float]
Recognizer = Callable[[list[str]], list[list[Word]]]
SCHEMA = "page_id long, word_id int, text string, x0 int, y0 int, x1 int, y1 int, confidence double, engine string"


def ruled(texts: list[str]) -> list[list[Word]]:
    """A stand-in: words on a fixed grid with a confidence from their length."""
    return [[(w, 100 * i, 0, 100 * i + 90, 40, float(100 - len(w) % 41)) for i, w in enumerate(t.split())] for t in texts]


def brittle(texts: list[str]) -> list[list[Word]]:
    """The same, but it fails on a batch that holds a text whose length is a multiple of ten, as a model does on a bad page."""
    if any(len(t) % 10 == 0 for t in texts):
        raise RuntimeError("cannot read a page of this batch")
    return ruled(texts)


REGISTRY: dict[str, Callable[[], Recognizer]] = {"ruled": lambda: ruled, "brittle": lambda: brittle}
#: Recognizers of this process by name: what is dear to load is loaded once.
_LOADED: dict[str, Recognizer] = {}


def build(name: str) -> Recognizer:
    if name not in REGISTRY:
        raise ValueError(f"unknown recognizer: {name}")
    return REGISTRY[name]()


def loaded(name: str) -> Recognizer:
    if name not in _LOADED:
        _LOADED[name] = build(name)
    return _LOADED[name]


def attempt(recognizer: Recognizer, texts: list[str]) -> list[list[Word]]:
    """Results padded to the number of pages."""
    try:
        out = recognizer(texts)
    except Exception:  # noqa: BLE001 - any failure of a model is a page without words
        out = []
        for t in texts:
            try:
                out += recognizer([t])[:1] or [[]]
            except Exception:  # noqa: BLE001
                out.append([])
    return (out + [[]] * len(texts))[: len(texts)]


def recognize(pages: DataFrame, name: str, registry: dict[str, Callable[[], Recognizer]] | None = None) -> DataFrame:
    """Words of pages (page_id, text)."""
    make = (registry or REGISTRY).get(name)
    if make is None:
        raise ValueError(f"unknown recognizer: {name}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recognizer = make() if registry else loaded(name)
        for batch in batches:
            rows = [(p, i, *w, name) for p, words in zip(batch.page_id, attempt(recognizer, list(batch.text)), strict=True) for i, w in enumerate(words)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select("page_id", "text").mapInPandas(run, SCHEMA)


@udtf(returnType=SCHEMA)
class RecognizePages:
    """Words of the rows (page_id, text) of a table, ``size`` pages at a time."""

    def __init__(self) -> None:
        self.pages: list[tuple[int, str]] = []
        self.name = ""

    def flush(self) -> Iterator[tuple]:
        pages, self.pages = self.pages, []
        for (page, _), words in zip(pages, attempt(loaded(self.name), [t for _, t in pages]), strict=True):
            for i, w in enumerate(words):
                yield (page, i, *w, self.name)

    def eval(self, page: Row, name: str, size: int) -> Iterator[tuple]:
        self.name = name
        self.pages.append((page["page_id"], page["text"] or ""))
        if len(self.pages) >= size:
            yield from self.flush()

    def terminate(self) -> Iterator[tuple]:
        if self.pages:
            yield from self.flush()


def register(spark: SparkSession, name: str = "recognize") -> None:
    """Makes the table function known to SQL."""
    spark.udtf.register(name, RecognizePages)
