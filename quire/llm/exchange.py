"""Exact corpus-wide statistics of hashed items, moved as packed arrays.

Texts are dealt into chunks of about ``CHUNK_BYTES`` by a hash of the row and its place.  Each chunk reduces its
items to sorted distinct 64-bit keys with one value each, so a key travels once per chunk however
often it occurs in it: that is the combine before the shuffle, and it bounds what a hot key costs.
Keys are cut by their upper bits into buckets, one packed row per chunk and bucket.  A bucket folds
the values of equal keys and answers every chunk in the order in which its keys came.  Chunks then
meet their answers by a cogroup.  Numbers of chunks and buckets follow the size of the input, so
the memory of a task does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

CHUNK_BYTES = 2_500_000
BUCKET_KEYS = 200_000

#: (keys, values) of a table of texts; keys sorted and distinct.
Items = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]
#: Folds values that are sorted by key: (values, starts of the groups) -> one per group.
Fold = Callable[[np.ndarray, np.ndarray], np.ndarray]

ASK = "bucket long, chunk long, keys binary, vals binary"


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def chunked(docs: DataFrame, columns: list[str | Column], n_bytes: int, text_col: str = "text") -> DataFrame:
    """The columns with a ``chunk`` number in front.

    Rows go by their content and their place in the input, so equal rows, however many, are dealt out too.  The place
    is not the same each time that a table is worked out, so what is dealt is kept.
    """
    n = max(2 * parts(docs), -(-n_bytes // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", text_col, F.monotonically_increasing_id()), F.lit(n))
    return keep(docs.select(chunk.alias("chunk"), *columns), "chunks")


def n_buckets(df: DataFrame, keys: int) -> int:
    return max(2 * parts(df), -(-keys // BUCKET_KEYS))


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    k = np.sort(keys)
    if not len(k):
        return k, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.diff(np.append(at, len(k)))


def table_of(columns: dict, schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
    return pa.table({name: pa.array(columns.get(name, []), kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})


def chunk_no(t: pa.Table) -> int:
    return t.column("chunk")[0].as_py()


def rows_by_bucket(keys: np.ndarray, vals: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted keys."""
    if not len(keys):
        return
    bucket = cuts(keys, n)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for lo, hi in zip(at, np.append(at[1:], len(keys)), strict=True):
        yield int(bucket[lo]), slice(int(lo), int(hi))


def ask(chunk: int, keys: np.ndarray, vals: np.ndarray, n: int) -> pa.Table:
    out: dict[str, list] = {"bucket": [], "chunk": [], "keys": [], "vals": []}
    for b, s in rows_by_bucket(keys, vals, n):
        for k, v in zip(out, (b, chunk, keys[s].tobytes(), vals[s].tobytes()), strict=True):
            out[k].append(v)
    return table_of(out, ASK)


def fold_bucket(t: pa.Table, kind: type, fold: Fold) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, group of each sorted entry, folded value of each group, first entry of each group)."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")])
    vals = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column("vals")])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return order, np.cumsum(new) - 1, fold(vals[order], start), start


def answers(asked: DataFrame, kind: type, fold: Fold, out: type) -> DataFrame:
    """(chunk, bucket, vals): the folded value of each key that the chunk asked about, in its order."""

    def run(t: pa.Table) -> pa.Table:
        order, group, folded, _ = fold_bucket(t, kind, fold)
        answer = np.empty(len(order), out)
        answer[order] = folded[group]
        at = np.cumsum([0, *(len(x.as_buffer()) // 8 for x in t.column("keys"))])
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "vals": pa.array([answer[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, vals binary")


def answer_of(t: pa.Table, kind: type) -> np.ndarray:
    """The answers to one chunk, in the order of its sorted keys."""
    if not t.num_rows:
        return np.zeros(0, kind)
    t = t.sort_by("bucket")
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column("vals")])


def is_repeated(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of counts capped at 2: whether a key occurs twice or more in all chunks."""
    return (np.add.reduceat(values.astype(np.int64), starts) > 1).astype(np.uint8) if len(starts) else np.zeros(0, np.uint8)
