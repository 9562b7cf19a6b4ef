"""Substring dedup by difference-cover anchors (operator 7).

A word goes when a window of ``WINDOW`` consecutive words covers it whose word sequence also starts
anywhere else.  Two equal windows that start at words i and j have, for some shift d below
``PERIOD``, both i+d and j+d at cover positions modulo the period, because every residue is a
difference of two members of the cover.  So hashing short windows (``ANCHOR`` words, PERIOD + ANCHOR
- 1 = WINDOW) at cover positions only, less than a quarter of all, finds an anchor that both share.
Around each repeated anchor the windows that hold it are extended to full length, hashed and counted
over the corpus; those found twice are the repeated windows.  No pairs are formed, and a passage in
a third of all documents travels once per chunk.  Anchors are 64-bit hashes, which only choose candidates; the
windows that decide are 64 bits and a mark of 31 more from a second hash.

Null and blank texts have no words.  Texts under WINDOW words lose nothing.  Repeated rows are other
places, so they count.  Windows are judged on the input, and neither text nor repetition is cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # a perfect difference set modulo 21
ANCHOR = WINDOW - PERIOD + 1
SECOND = np.uint64(0x2545F4914F6CDD1D)

REPEATED = "chunk long, bucket long, keys binary, marks binary"


def block_of(t: pa.Table) -> B.Block:
    return B.Block(*B.buffers(t.column("text")))


def anchors(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of the anchors of documents that hold a full window."""
    at, h = b.windows(ANCHOR)
    place = at - b.word_off[b.doc[at]]
    here = np.isin(place % PERIOD, COVER) & (b.n_words[b.doc[at]] >= WINDOW)
    return at[here], h[here]


def flagged(h: np.ndarray, answer: np.ndarray) -> np.ndarray:
    """Whether each hash is repeated in the corpus, from the answers for the sorted distinct ones."""
    keys, _ = X.distinct(h)
    return answer[np.searchsorted(keys, h)] > 0 if len(h) else np.zeros(0, bool)


def marked_windows(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, mark) of the full windows; the mark is 31 bits of a second hash."""
    at, h = b.windows(WINDOW)
    return at, h, (B.window_hashes(B.mix(b.word_hash ^ SECOND), WINDOW)[at] >> np.uint64(33)).astype(np.uint32)


def candidates(b: B.Block, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, mark) of the full windows that hold a repeated anchor."""
    at, h = anchors(b)
    at = at[flagged(h, answer)]
    every, full, mark = marked_windows(b)
    if not len(every):
        return full, mark
    starts = (at[:, None] - np.arange(PERIOD)).ravel()
    near = np.zeros(len(b.start) + 1, bool)
    near[starts[starts >= 0]] = True
    here = near[every]
    return full[here], mark[here]


def groups(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and mark, first of each group of equal ones in that order)."""
    order = np.lexsort((marks, keys))
    k, m = keys[order], marks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    return order, np.flatnonzero(new)


def ask_anchors(chunk: int, h: np.ndarray, n: int) -> pa.Table:
    keys, count = X.distinct(h)
    return X.ask(chunk, keys, np.minimum(count, 2).astype(np.uint8), n)


def ask_windows(chunk: int, h: np.ndarray, mark: np.ndarray, n: int) -> pa.Table:
    """Each distinct window of a chunk once; the lowest bit of its value says that the chunk has it twice or more."""
    order, start = groups(h, mark)
    again = np.diff(np.append(start, len(order))) > 1
    own = order[start]
    return X.ask(chunk, h[own], mark[own] << np.uint32(1) | again.astype(np.uint32), n)


def removal(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) of every document."""
    n_bytes = X.text_bytes(docs)
    texts = X.chunked(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], n_bytes)
    n = X.n_buckets(docs, n_bytes // 24)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text

    def first(t: pa.Table) -> pa.Table:
        return ask_anchors(X.chunk_no(t), anchors(block_of(t))[1], n)

    def second(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.table_of({}, X.ASK)
        return ask_windows(X.chunk_no(t), *candidates(block_of(t), X.answer_of(a, np.uint8)), n)

    def third(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.table_of({}, out)
        b = block_of(t)
        gone = np.zeros(len(b.start) + 1, np.int64)
        if a.num_rows:
            every, full, mark = marked_windows(b)
            start = every[among(full, mark, *windows_of(a))]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
        removed = np.cumsum(gone[:-1]) > 0
        kept = np.flatnonzero(~removed)
        length = (b.end - b.start)[kept]
        at = np.cumsum(length + 1) - length - 1
        joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
        joined[B.ragged(at, length)] = b.data[B.ragged(b.start[kept], length)]
        off = np.append(at, len(joined))[np.searchsorted(kept, b.word_off)]
        pieces = [joined[x : max(x, y - 1)].tobytes() for x, y in zip(off[:-1], off[1:], strict=True)]
        cols = {"doc_id": t.column("doc_id"), "n_words": pa.array(b.n_words), "n_removed": pa.array(np.diff(B.prefix_sum(removed)[b.word_off])), "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string())}
        return pa.table(cols | ({"text": pa.array([p.decode() for p in pieces], pa.string())} if with_text else {}))

    a1 = X.answers(texts.groupBy("chunk").applyInArrow(first, X.ASK), np.uint8, X.is_repeated, np.uint8)
    asked = texts.groupBy("chunk").cogroup(a1.groupBy("chunk")).applyInArrow(second, X.ASK)
    a2 = asked.groupBy("bucket").applyInArrow(repeated, REPEATED)
    return texts.groupBy("chunk").cogroup(a2.groupBy("chunk")).applyInArrow(third, out)


def repeated(t: pa.Table) -> pa.Table:
    """Those windows of each chunk in a bucket that occur twice or more in all chunks."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")])
    vals = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("vals")])
    marks = vals >> np.uint32(1)
    order, start = groups(keys, marks)
    count = np.add.reduceat(1 + (vals[order] & np.uint32(1)).astype(np.int64), start) if len(start) else start
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat(count > 1, np.diff(np.append(start, len(keys))))
    out: dict[str, list] = {"chunk": [], "bucket": [], "keys": [], "marks": []}
    lo = 0
    for c, b, k in zip(t.column("chunk").to_pylist(), t.column("bucket").to_pylist(), t.column("keys"), strict=True):
        own = slice(lo, lo + len(k.as_buffer()) // 8)
        lo = own.stop
        if hit[own].any():
            for name, v in zip(out, (c, b, keys[own][hit[own]].tobytes(), marks[own][hit[own]].tobytes()), strict=True):
                out[name].append(v)
    return X.table_of(out, REPEATED)


def windows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The repeated windows of one chunk, sorted: (hashes, marks)."""
    t = t.sort_by("bucket")
    return tuple(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)]) for name, kind in (("keys", np.uint64), ("marks", np.uint32)))


def among(h: np.ndarray, mark: np.ndarray, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each (hash, mark) is one of the sorted (keys, marks)."""
    at, end = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
    found = np.zeros(len(h), bool)
    for step in range(int((end - at).max(initial=0))):  # one step, but for windows whose hashes alone are equal
        here = np.flatnonzero(at + step < end)
        found[here] |= marks[at[here] + step] == mark[here]
    return found


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
marked AS (SELECT words.doc_id, words.p, word, gone.p IS NOT NULL AS removed FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p),
kept AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS r, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
