"""SentencePiece vocabulary: encoding and decoding by batched Viterbi (operator 9).

A text is read as one space and then its bytes; a unit is a run of spaces with the bytes up to the
next run.  The encoding of a unit is the segmentation into vocabulary pieces of greatest total
weight; a byte that no piece covers costs a byte piece, below every weight.  Distinct units of a block
are taken once and advance together, a byte at a time, units of equal length side by side and shorter
ones dropping out: hashes of the substrings that end at a position probe the sorted hashes of the
pieces, and a vectorised maximum stores the length of the last piece.  Among equal totals the longest
last piece wins.  A unit over ``LONG`` bytes, such as text without spaces, has all its substrings probed
at once; the maxima then run along it, in time in proportion to its length.

The weights of a unigram file are its scores, which are log probabilities.  The scores of a BPE file are
the order of its merges, whose sums mean nothing; a piece of rank r gets the log of 1 / (r + ``OFFSET``).
Such a file's own tokenizer merges pairs, so its ids can differ; the README has the agreement.

Control, unknown and unused pieces take no part; user-defined ones do.  Null and empty texts have no
ids; rows without an id, and repeated rows, are encoded as any other.  The mark U+2581 in a text is
encoded by byte pieces, so decoding gives every text back.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET = 1000
LONG = 96
GROUPS = (8, 16, 32, LONG)
STRETCH = 1 << 18
BLOCK = 3 << 20
_SLOT = np.uint64(44)
_SIZE = 0xD6E8FEB86659FD93


class Vocabulary:
    """Pieces with their bytes (the mark written as a space), log weights and byte pieces."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: np.ndarray, size: int):
        self.ids = np.array([i for i, _, _ in pieces], np.int32)
        weight = log_weights(np.array([s for _, _, s in pieces], np.float64))
        text = [t for _, t, _ in pieces]
        self.longest = max(map(len, text))
        lengths = np.array([len(t) for t in text])
        data = np.frombuffer(b"".join(text), np.uint8)
        ends = np.cumsum(lengths)
        _, ipw = B.powers(len(data) + 1)
        at = sums(data)
        key = spans(at[ends], at[ends - lengths], ipw[ends - lengths], lengths)
        order = np.argsort(key)
        self.key, self.weight, self.sorted_ids = key[order], weight[order], self.ids[order]
        slot = (self.key >> _SLOT).astype(np.int64)
        self.first = np.full(1 << 20, -1, np.int32)  # by the upper bits of a key, the first sorted key that has them
        self.first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.depth = int(np.bincount(slot).max())
        self.sizes = [n for n in range(1, self.longest + 1) if (lengths == n).any()]
        self.byte_ids = byte_ids
        self.byte_weight = float(weight.min()) - 100.0
        self.piece_len = np.zeros(size, np.int64)
        self.piece_len[self.ids] = lengths
        self.piece_len[byte_ids] = 1
        at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_at, self.piece_data = at, np.zeros(int(self.piece_len.sum()), np.uint8)
        self.piece_data[B.ragged(at[self.ids], lengths)] = data
        self.piece_data[at[byte_ids]] = np.arange(256)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the keys that are pieces, the number of each among the sorted pieces)."""
        at = self.first[(keys >> _SLOT).astype(np.int64)]
        some = np.flatnonzero(at >= 0)
        own, at = keys[some], at[some]
        hit = self.key[at] == own
        for _ in range(1, self.depth):
            miss = np.flatnonzero(~hit)
            at[miss] = np.minimum(at[miss] + 1, len(self.key) - 1)
            hit[miss] = self.key[at[miss]] == own[miss]
        return some[hit], at[hit]


def log_weights(score: np.ndarray) -> np.ndarray:
    """Scores that are whole numbers are ranks, from the best: log 1 / (rank + OFFSET); others stay."""
    if not np.array_equal(score, np.rint(score)):
        return score
    rank = np.empty(len(score))
    rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return -np.log(rank + OFFSET)


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``spans`` takes the hash of a substring."""
    pw, _ = B.powers(len(data) + 1)
    return B.prefix_sum(B._BYTE[data] * pw[: len(data)])


def spans(upto: np.ndarray, before: np.ndarray, inverse: np.ndarray | np.uint64, size: np.ndarray | int) -> np.ndarray:
    """Hashes of substrings from the running sums at their ends and starts."""
    step = np.uint64(size * _SIZE & (1 << 64) - 1) if isinstance(size, int) else size.astype(np.uint64) * np.uint64(_SIZE)
    return (upto - before) * inverse + step


@cache
def load(path: str) -> Vocabulary:
    """The vocabulary of a model file."""
    import sentencepiece

    with open(path, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    pieces, byte_ids = [], np.full(256, -1, np.int64)
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces.append((i, sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i)))
    return Vocabulary(pieces, byte_ids, sp.get_piece_size())


@cache
def end_id(path: str) -> int:
    """The id that closes a text."""
    import sentencepiece

    with open(path, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=f.read()).eos_id()


class Batch:
    """Units as columns of bytes, the longest first; ``live(i)`` of them are longer than i."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.order = np.argsort(-length, kind="stable")
        start, self.length = start[self.order], length[self.order]
        self.steps, self.m = int(self.length[0]), len(length)
        self.count = np.searchsorted(-self.length, -np.arange(self.steps), "left")
        pw, self.ipw = B.powers(self.steps + 1)
        self.byte = np.zeros((self.steps, self.m), np.uint8)
        self.sums = np.zeros((self.steps + 1, self.m), np.uint64)
        for i in range(self.steps):
            k = self.count[i]
            self.byte[i, :k] = data[start[:k] + i]
            self.sums[i + 1, :k] = self.sums[i, :k] + B._BYTE[self.byte[i, :k]] * pw[i]

    def arcs(self, v: Vocabulary, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, units, pieces) of the pieces that end behind byte i, by size."""
        k = self.count[i - 1]
        for size in v.sizes:
            if size > i:
                return
            found, at = v.probe(spans(self.sums[i, :k], self.sums[i - size, :k], self.ipw[i - size], size))
            if len(found):
                yield size, found, at


def groups(length: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the units of up to LONG bytes, in batches of like lengths."""
    low = 0
    for high in GROUPS:
        own = np.flatnonzero((length > low) & (length <= high))
        step = max(1, 1_000_000 // high)
        for cut in range(0, len(own), step):
            yield own[cut : cut + step]
        low = high


def stretch_arcs(unit: np.ndarray, v: Vocabulary, lo: int) -> list[list[tuple[int, int]]]:
    """Pieces (size, number) that end behind each byte of the stretch of a long unit that begins at byte ``lo``."""
    back = min(lo, v.longest)
    part = unit[lo - back : lo + STRETCH]
    at, (_, ipw) = sums(part), B.powers(len(part) + 1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(part) - back)]
    for size in v.sizes:
        if size > len(part):
            break
        found, piece = v.probe(spans(at[size:], at[:-size], ipw[: len(part) - size + 1], size))
        found += size - 1 - back
        for i, p in zip(found[found >= 0].tolist(), piece[found >= 0].tolist(), strict=True):
            out[i].append((size, p))
    return out


def long_arcs(unit: np.ndarray, v: Vocabulary) -> Iterator[tuple[int, list[list[tuple[int, int]]]]]:
    """(first byte, pieces (size, number) that end behind each byte) of one long unit, stretch by stretch."""
    for lo in range(0, len(unit), STRETCH):
        yield lo, stretch_arcs(unit, v, lo)


def encode_long(unit: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Ids of one long unit."""
    weight, byte_weight, keep = v.weight.tolist(), v.byte_weight, v.longest
    best, size_of, piece_of = [0.0], array("h"), array("i")
    for _, ends in long_arcs(unit, v):
        best = best[-keep:]
        for arcs in ends:
            top, last, which = best[-1] + byte_weight, 1, -1
            for size, p in arcs:
                total = best[-size] + weight[p]
                if total >= top:
                    top, last, which = total, size, p
            best.append(top), size_of.append(last), piece_of.append(which)
    path, i = [], len(unit)
    while i:
        path.append(i - 1)
        i -= size_of[i - 1]
    at = np.array(path[::-1])
    which = np.frombuffer(piece_of, np.int32)[at]
    return np.where(which >= 0, v.sorted_ids[which], v.byte_ids[unit[at]]).astype(np.int32)


def encode_batch(batch: Batch, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units, one after another in the order of the batch, and how many each has)."""
    n, m = batch.steps, batch.m
    best = np.full((n + 1, m), -np.inf)
    best[0] = 0
    back = np.ones((n + 1, m), np.int8)
    piece = np.zeros((n + 1, m), np.int32)
    for i in range(1, n + 1):
        k = batch.count[i - 1]
        top, last, which = best[i], back[i], piece[i]
        top[:k] = best[i - 1, :k] + v.byte_weight
        which[:k] = v.byte_ids[batch.byte[i - 1, :k]]
        for size, found, at in batch.arcs(v, i):
            total = best[i - size, found] + v.weight[at]
            won = total >= top[found]
            found, at = found[won], at[won]
            top[found] = total[won]
            last[found] = size
            which[found] = v.sorted_ids[at]
    count = np.zeros(m, np.int64)
    pos = batch.length.copy()
    steps = []
    live = np.arange(m)
    while len(live):
        p = pos[live]
        steps.append((live, piece[p, live]))
        count[live] += 1
        pos[live] = p - back[p, live]
        live = live[pos[live] > 0]
    ids = np.zeros(int(count.sum()), np.int32)
    end = np.cumsum(count)
    for k, (live, got) in enumerate(steps, 1):
        ids[end[live] - k] = got
    return ids, count


def encode_units(data: np.ndarray, start: np.ndarray, length: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the units data[start : start + length], one after another, and how many each has)."""
    count = np.zeros(len(start), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for own in groups(length):
        batch = Batch(data, start[own], length[own])
        own = own[batch.order]
        ids, count[own] = encode_batch(batch, v)
        parts.append((own, ids))
    for u in np.flatnonzero(length > LONG):
        ids = encode_long(data[start[u] : start[u] + length[u]], v)
        count[u] = len(ids)
        parts.append((np.array([u]), ids))
    at = np.cumsum(count) - count
    pool = np.zeros(int(count.sum()), np.int32)
    for own, ids in parts:
        pool[B.ragged(at[own], count[own])] = ids
    return pool, count


def encode_block(data: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by document) of texts."""
    n = len(off) - 1
    size = np.diff(off)
    full = np.flatnonzero(size)
    grown = off[:-1] + np.cumsum(size > 0) - (size > 0)
    wide = np.full(len(data) + len(full), 0x20, np.uint8)
    wide[B.ragged(grown[full] + 1, size[full])] = data
    if not len(wide):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    space = wide == 0x20
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[grown[full]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(wide))
    _, index, inverse = np.unique(B.span_hashes(wide, start, end), return_index=True, return_inverse=True)
    pool, count = encode_units(wide, start[index], (end - start)[index], v)
    at = np.cumsum(count) - count
    ids = pool[B.ragged(at[inverse], count[inverse])]
    doc = np.searchsorted(grown[full], start, "right") - 1
    by_doc = np.zeros(n, np.int64)
    by_doc[full] = np.bincount(doc, weights=count[inverse], minlength=len(full)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(by_doc)])


def decode_block(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids, without their first space."""
    size = v.piece_len[ids]
    data = v.piece_data[B.ragged(v.piece_at[ids], size)]
    at = B.prefix_sum(size)[off]
    full = np.diff(off) > 0
    keep = np.ones(len(data), bool)
    keep[at[:-1][full]] = False
    return data[keep], at - np.concatenate([[0], np.cumsum(full)])


SCHEMA = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            for lo, hi in B.slices(off, BLOCK):
                own, own_off = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, at = encode_block(own, own_off, v)
                back, back_off = decode_block(ids, at, v)
                same = np.diff(back_off) == np.diff(own_off)
                if same.all():
                    same = B.per_doc(back != own, own_off) == 0
                else:
                    same = np.array([back[back_off[i] : back_off[i + 1]].tobytes() == own[own_off[i] : own_off[i + 1]].tobytes() for i in range(hi - lo)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(same)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for batch in batches:
            lists = batch.column(1)
            off = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            data, at = decode_block(lists.flatten().to_numpy(zero_copy_only=False), off, v)
            texts = [None if not ok else data[a:b].tobytes().decode() for ok, a, b in zip(lists.is_valid().to_pylist(), at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
