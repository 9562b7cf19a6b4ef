"""Best-fit packing of token sequences with several permitted bin sizes (operator 8).

Texts are encoded by operator 9 and closed by the end id.  A sequence longer than the largest size is
cut into full pieces of that size and a rest.  Pieces go in order of falling length.  A piece takes the
open bin that it leaves fullest.  When no open bin can hold it, a size is opened: for each permitted size
that holds the piece, the room beside it is filled, on paper, with the longest pieces still to come that
fit, by the histogram of what is left; the size of least cost per token of that content is taken.  When
all pieces are placed each bin shrinks to the least permitted size that holds its contents.  A bin of s
tokens costs s * (1 + s / ``ATTENTION``): its tokens and, for attention, their square.

Ties go to the smaller size, the bin opened or used last, and the piece of least hash.  Null and empty texts
are the end id alone.  Rows without an id are packed as any other, and repeated rows are separate
sequences.  Shards of about ``SHARD_BYTES`` of text pack alone; pieces are dealt to them by a hash of id, text,
place in the text and the number of equal rows before them in their partition, so neither a long text nor a row that occurs very
often makes a large shard.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X
from . import pieces as P

SIZES = (512, 1024, 2048, 4096)
SHARD_BYTES = 4_000_000
ATTENTION = 32_768


def cost(size: int, attention: float = ATTENTION) -> float:
    return size * (1 + size / attention)


def content(room: int, lengths: list[int], left: list[int]) -> int:
    """Tokens in a room that takes the longest items that fit, of lengths (ascending) with ``left`` of each."""
    full, most = room, room
    at = bisect_right(lengths, most) - 1
    while at >= 0 and room:
        room -= lengths[at] * min(left[at], room // lengths[at])
        at = min(at, bisect_right(lengths, room)) - 1
    return full - room


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, final size of it) of each item; every length is from 1 to max(sizes)."""
    sizes = tuple(sorted(sizes))
    order = np.argsort(-lengths, kind="stable")
    distinct, counts = (x.tolist() for x in np.unique(lengths, return_counts=True))
    open_bins: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # by the room left
    rooms: list[int] = []  # ascending, those with bins
    fill: list[int] = []
    item_bin, item_off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)

    def opened(n: int) -> int:
        def price(size: int) -> tuple[float, int]:
            used = n + content(size - n, distinct, counts)
            return cost(sizes[bisect_left(sizes, used)], attention) / used, size

        return min((s for s in sizes if s >= n), key=price)

    for i in order.tolist():
        n = int(lengths[i])
        counts[-1] -= 1
        if not counts[-1]:
            distinct.pop(), counts.pop()
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            room, b = opened(n), len(fill)
            fill.append(0)
        item_bin[i], item_off[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room > 0:
            if not open_bins[room]:
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append(b)
    final = np.array(sizes)[np.searchsorted(sizes, np.array(fill, np.int64))] if fill else np.zeros(0, np.int64)
    return item_bin, item_off, final[item_bin] if len(item_bin) else item_bin


CUT = "doc_id long, piece int, piece_start long, h long, tokens binary"


def cut_sequences(docs: DataFrame, most: int, model: str = P.MODEL) -> DataFrame:
    """Pieces of at most ``most`` tokens of the encoded texts, with a hash that tells equal rows of a partition apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, end = P.load(model), P.end_id(model)
        seen: Counter = Counter()
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            for lo, hi in B.slices(off, P.BLOCK):
                own, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                ids, to = P.encode_block(own, at, v)
                doc = batch.column(0).slice(lo, hi - lo)
                key = B.mix(B.span_hashes(own, at[:-1], at[1:]) + B.mix(doc.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)))
                again = np.zeros(hi - lo, np.uint64)
                for i, k in enumerate(key.tolist()):
                    again[i] = seen[k]
                    seen[k] += 1
                whole = np.full(len(ids) + hi - lo, end, np.int32)
                size = np.diff(to) + 1
                start = np.cumsum(size) - size
                whole[B.ragged(start, size - 1)] = ids
                count = -(-size // most)
                row = np.repeat(np.arange(hi - lo), count)
                piece = B.ragged(np.zeros(hi - lo, np.int64), count)
                x = start[row] + piece * most
                y = np.minimum(x + most, (start + size)[row])
                h = B.mix(key[row] + B.mix(piece.astype(np.uint64) + (again[row] << np.uint64(32))))
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * most), pa.array(h.view(np.int64)), pa.array([whole[a:b].tobytes() for a, b in zip(x, y, strict=True)], pa.binary())], [c.split()[0] for c in CUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CUT)


OUT = "doc_id long, piece int, piece_start long, piece_tokens int, shard long, bin long, bin_offset int, bin_size int, bin_used int, ids array<int>"


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard_bytes: int = SHARD_BYTES, model: str = P.MODEL) -> DataFrame:
    """One row per piece of a document: its ids, and its place in a bin."""
    shards = max(1, -(-X.text_bytes(docs) // shard_bytes))

    def run(t: pa.Table) -> pa.Table:
        tokens = t.column("tokens").combine_chunks()
        length = np.array([len(x.as_buffer()) // 4 for x in tokens], np.int64)
        order = np.lexsort((t.column("piece").to_numpy(), t.column("h").to_numpy()))
        t, length, tokens = t.take(pa.array(order)), length[order], tokens.take(pa.array(order))
        b, off, size = pack(length, sizes)
        used = np.bincount(b, weights=length)[b]
        ids = [np.frombuffer(x.as_buffer(), np.int32) for x in tokens]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(np.concatenate(ids)))
        columns = [t.column("doc_id"), t.column("piece"), t.column("piece_start"), length.astype(np.int32), t.column("shard"), b, off.astype(np.int32), size.astype(np.int32), used.astype(np.int32), lists]
        return pa.table(columns, names=[x.split()[0] for x in OUT.split(", ")])

    cut = cut_sequences(docs, max(sizes), model).withColumn("shard", F.pmod("h", F.lit(shards)).cast("long"))
    return cut.groupBy("shard").applyInArrow(run, OUT)


def sequences(packed: DataFrame, pad: int = 0) -> DataFrame:
    """(shard, bin, bin_size, doc_ids, starts, ids): packed pieces put together, filled up to the size with ``pad``."""
    each = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "ids")))
    bins = packed.groupBy("shard", "bin", "bin_size").agg(each.alias("s"), F.sum("piece_tokens").cast("int").alias("used"))
    filled = F.concat(F.flatten("s.ids"), F.array_repeat(F.lit(pad), F.col("bin_size") - F.col("used")))
    return bins.select("shard", "bin", "bin_size", F.col("s.doc_id").alias("doc_ids"), F.col("s.bin_offset").alias("starts"), filled.alias("ids"))
