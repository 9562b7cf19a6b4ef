"""Quality rules by compression bands (operator 4).

Each text is compressed by zstandard as a whole and in fixed chunks of its UTF-8 bytes.  The ratio
raw/compressed of the whole text must lie in a band that depends on its length, and no more than
``max_bad_chunks`` of its chunks may leave the chunk band: repetitive text exceeds the upper limit,
incompressible text falls under the lower one.  Every byte is in a chunk, the end in one that reaches back
over its neighbour; a text under one chunk is judged by the whole band of its length alone.

Null, empty and blank texts have no words and are rejected by the base rule.  A ratio on a limit is
within it.  Rows without an id are judged as any other, repeated rows get the same verdict each; extra input columns are ignored by the query and kept by ``filter_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio.  ``whole``: (bytes up to, least, most), ascending; the last holds beyond."""

    whole: tuple[tuple[int, float, float], ...] = field(
        default=(
            (64, 0.0, 1.6),
            (128, 0.7, 2.0),
            (256, 0.9, 2.3),
            (512, 1.1, 2.4),
            (1024, 1.25, 2.6),
            (2048, 1.35, 2.9),
            (4096, 1.4, 3.1),
            (8192, 1.4, 3.3),
            (16384, 1.4, 3.5),
            (65536, 1.4, 3.9),
            (1 << 20, 1.4, 4.6),
            (1 << 62, 1.4, 6.0),
        )
    )
    chunk_bytes: int = 1024
    chunk: tuple[float, float] = (1.15, 2.9)
    max_bad_chunks: float = 0.25
    level: int = 3


def base_counts(b: B.Block) -> dict[str, np.ndarray]:
    """The counts of the base rule for each document of a block."""
    points = (b.data & 0xC0) != 0x80
    newline = np.flatnonzero(b.data == 10)
    starts = np.unique(np.concatenate([b.off[:-1], newline + 1]))
    starts = starts[starts < len(b.data)]
    ends = np.append(starts[1:], len(b.data))
    ends = ends - (b.data[ends - 1] == 10) if len(starts) else ends
    has_word = np.diff(B.prefix_sum(b.inside)[np.stack([starts, ends])], axis=0)[0] > 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[has_word], ends[has_word]
    doc = np.searchsorted(b.off, starts, "right") - 1
    order, _, sizes = B.count_distinct_pairs(doc, B.span_hashes(b.data, starts, ends))
    first = np.cumsum(sizes) - sizes
    again = np.ones(len(order), bool)
    again[first] = False
    n_dup = np.bincount(doc[order[again]], minlength=b.n)
    at, h = b.windows(3)
    order, group, sizes = B.count_distinct_pairs(b.doc[at], h)
    hit = at[order[sizes[group] > 1]]
    covered = np.zeros(len(b.start) + 2, bool)
    for k in range(3):
        covered[hit + k] = True
    return {
        "n_words": b.n_words,
        "word_chars": B.per_doc(points & b.inside, b.off),
        "n_symbols": B.per_doc(SYMBOLS[b.data], b.off),
        "n_dup_lines": n_dup,
        "n_repeat_words": np.diff(B.prefix_sum(covered[: len(b.start)])[b.word_off]),
    }


def chunks(text: bytes, size: int) -> list[bytes]:
    """Fixed chunks of a text of at least one; what is left behind the last is judged with the bytes before it, as the last ``size`` bytes."""
    n = len(text)
    return [text[i : i + size] for i in range(0, n - size + 1, size)] + [text[-size:]] * (n >= size and n % size > 0)


def ratios(text: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, float]:
    """(ratio of the whole text, share of chunks outside the chunk band); a text under one chunk has no chunks."""
    whole = len(text) / len(z.compress(text)) if text else 0.0
    lo, hi = bands.chunk
    each = chunks(text, bands.chunk_bytes)
    bad = sum(not lo <= len(c) / len(z.compress(c)) <= hi for c in each)
    return whole, bad / max(1, len(each))


def verdict(n_bytes: int, whole: float, bad: float, bands: Bands) -> bool:
    lo, hi = next((lo, hi) for most, lo, hi in bands.whole if n_bytes <= most)
    return lo <= whole <= hi and bad <= bands.max_bad_chunks


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def score_batch(ids: pa.Array, texts: pa.Array, bands: Bands) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=bands.level)
    for lo, hi, b in B.blocks(texts):
        c = base_counts(b)
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        both = [ratios(b.text(i), bands, z) for i in range(b.n)]
        size = np.diff(b.off)
        good = np.array([verdict(int(n), w, x, bands) for n, (w, x) in zip(size, both, strict=True)], bool)
        yield pa.RecordBatch.from_arrays(
            [ids.slice(lo, hi - lo), *(pa.array(v.astype(np.int64)) for v in c.values()), pa.array(failed), pa.array(good & ~failed), pa.array([w for w, _ in both], pa.float64()), pa.array([x for _, x in both], pa.float64())],
            NAMES,
        )


def quality_report(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts, ratios and verdict per document; one narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from score_batch(batch.column(0), batch.column(1), bands)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def filter_quality(docs: DataFrame, bands: Bands = Bands(), text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns as they came."""
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(np.arange(batch.num_rows))
            kept = [x.column(7) for x in score_batch(ids, batch.column(at), bands)]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(run, docs.schema)
