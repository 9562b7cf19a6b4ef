"""Language-model score by subword lattice likelihood (operator 2).

A text is its lower-cased words (A-Z) and one end mark.  A word is a space and its bytes; its
probability is the sum over all segmentations into vocabulary pieces of the product of the pieces'
probabilities, by the forward recursion in log space.  A byte that pieces leave out costs a byte
piece.  ``score`` is the log10 of the product over its words and its end mark.

Probabilities come from the scores of the existing vocabulary file, as ``pieces.log_weights`` reads them;
for a BPE file these are ranks, p ~ 1 / (rank + ``OFFSET``).  A byte piece has a 256th of the least
piece's weight, the end mark ``END`` of all.  ``score`` depends on the text alone.

Training documents are those whose crc32 of the id as text is not 1 modulo 5.  Of N training tokens and T
distinct ones, a token has probability count / N' + T / N' * p by them, where p is its probability by pieces
and N' = N + T.  In ``mixed_score`` p is by the file's weights; in ``learned_score`` the weights of pieces and bytes
are learned over the same lattice, by ``ROUNDS`` of expectation and maximization over every distinct training word of any
length.  A word weighs 1 / count there, as p is for what the counts do not know, and rare words
are most like unknown ones.  ``OLD`` of each weight stays the file's.

Distinct words of a chunk are scored once and advance together, a byte at a time; a word over
``pieces.LONG`` bytes has all its substrings probed at once, and takes time in proportion to its length.
Word counts are exact up to 64-bit hashes and cover all training documents.  Null and blank texts
consist of the end mark.  Rows without an id are training documents.  Repeated rows count and score each.
Without any training document every count is 0 and mixed_score is score.
"""

from __future__ import annotations

import math
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import exchange as X
from . import pieces as P
from .store import keep

END = 0.02
ROUNDS, OLD = 4, 0.01
LN10 = float(np.log(10))


class Lattice:
    """Log probabilities of the sorted pieces, of the bytes, and of the end mark; together they are 1."""

    def __init__(self, v: P.Vocabulary):
        self.v = v
        total = np.logaddexp.reduce(v.weight) + np.log1p(math.exp(v.weight.min() - np.logaddexp.reduce(v.weight)))
        self.end = math.log(END)
        self.piece = v.weight - total + math.log1p(-END)
        self.byte = np.full(256, float(v.weight.min() - math.log(256) - total + math.log1p(-END)))

    def taught(self, expected: np.ndarray) -> Lattice:
        """The lattice with weights in proportion to expected uses of the pieces, then of the bytes; as it is where there are none."""
        out, old = Lattice(self.v), np.exp(np.concatenate([self.piece, self.byte]))
        if expected.sum() > 0:
            new = np.log((1 - OLD) * (1 - END) * expected / expected.sum() + OLD * old)
            out.piece, out.byte = new[: len(self.piece)], new[len(self.piece) :]
        return out

    def batch(self, b: P.Batch) -> np.ndarray:
        """Log probabilities of the units of a batch, in its order."""
        alpha = np.full((b.steps + 1, b.m), -np.inf)
        alpha[0] = 0
        for i in range(1, b.steps + 1):
            k = b.count[i - 1]
            total = alpha[i]
            total[:k] = alpha[i - 1, :k] + self.byte[b.byte[i - 1, :k]]
            for size, found, at in b.arcs(self.v, i):
                total[found] = np.logaddexp(total[found], alpha[i - size, found] + self.piece[at])
        return alpha[b.length, np.arange(b.m)]

    def long(self, unit: np.ndarray) -> float:
        """Log probability of one long unit; sums are kept relative to ``scale``, which takes up what they lose."""
        p, byte, keep_ = np.exp(self.piece).tolist(), np.exp(self.byte).tolist(), self.v.longest
        alpha, scale, values = [1.0], 0.0, iter(unit.tolist())
        for _, ends in P.long_arcs(unit, self.v):
            alpha = alpha[-keep_:]
            for arcs in ends:
                total = alpha[-1] * byte[next(values)]
                for size, at in arcs:
                    total += alpha[-size] * p[at]
                alpha.append(total)
                if total < 1e-100:
                    scale += math.log(total)
                    alpha = [x / total for x in alpha[-keep_:]]
        return math.log(alpha[-1]) + scale

    def uses(self, b: P.Batch, weight: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces, then of the bytes, in the units of a batch, by weights in its order."""
        alpha = np.full((b.steps + 1, b.m), -np.inf)
        alpha[0], arcs = 0, []
        for i in range(1, b.steps + 1):
            k = b.count[i - 1]
            total = alpha[i]
            total[:k] = alpha[i - 1, :k] + self.byte[b.byte[i - 1, :k]]
            arcs.append(list(b.arcs(self.v, i)))
            for size, found, at in arcs[-1]:
                total[found] = np.logaddexp(total[found], alpha[i - size, found] + self.piece[at])
        whole = alpha[b.length, np.arange(b.m)]
        beta = np.full((b.steps + 1, b.m), -np.inf)
        beta[b.length, np.arange(b.m)] = 0
        out, n = np.zeros(len(self.piece) + 256), len(self.piece)
        for i in range(b.steps, 0, -1):
            k = b.count[i - 1]
            own, end = b.byte[i - 1, :k], beta[i, :k] - whole[:k]
            step = self.byte[own] + beta[i, :k]
            out[n:] += np.bincount(own, weight[:k] * np.exp(alpha[i - 1, :k] + self.byte[own] + end), 256)
            beta[i - 1, :k] = np.logaddexp(beta[i - 1, :k], step)
            for size, found, at in arcs[i - 1]:
                np.add.at(out, at, weight[found] * np.exp(alpha[i - size, found] + self.piece[at] + end[found]))
                beta[i - size, found] = np.logaddexp(beta[i - size, found], self.piece[at] + beta[i, found])
        return out

    def long_uses(self, unit: np.ndarray, weight: float, out: np.ndarray) -> None:
        """Adds to ``out`` the expected uses in one long unit; its arcs are found anew on the way back, so what is held beside a stretch is a number a byte."""
        p, byte, keep_, n = np.exp(self.piece).tolist(), np.exp(self.byte).tolist(), self.v.longest, len(self.piece)
        alpha, scale, upto, values = [1.0], 0.0, array("d", [0.0]), unit.tolist()
        for lo, ends in P.long_arcs(unit, self.v):
            for i, arcs in enumerate(ends, lo):
                total = alpha[-1] * byte[values[i]]
                for size, at in arcs:
                    total += alpha[-size] * p[at]
                alpha.append(total)
                if total < 1e-100:
                    scale += math.log(total)
                    alpha = [x / total for x in alpha[-keep_:]]
                upto.append(math.log(alpha[-1]) + scale)
            alpha = alpha[-keep_:]
        # beta[k] is the sum over what follows byte i - k, relative to ``scale``; those before it still grow.
        beta, scale, whole = deque([1.0] + [0.0] * keep_), 0.0, upto[-1]
        for lo in reversed(range(0, len(unit), P.STRETCH)):
            ends = P.stretch_arcs(unit, self.v, lo)
            for i in reversed(range(lo, lo + len(ends))):
                now = beta[0]
                after = weight * now
                left = scale - whole
                own = byte[values[i]]
                out[n + values[i]] += after * own * math.exp(upto[i] + left)
                beta[1] += now * own
                for size, at in ends[i - lo]:
                    out[at] += after * p[at] * math.exp(upto[i + 1 - size] + left)
                    beta[size] += now * p[at]
                beta.popleft()
                beta.append(0.0)
                if beta[0] < 1e-100:
                    scale += math.log(beta[0])
                    beta = deque([x / beta[0] for x in beta])

    def expected(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of the pieces, then of the bytes, in the weighted words data[start:end] behind a space."""
        wide, at, size = spaced(data, start, end)
        out = np.zeros(len(self.piece) + 256)
        for own in P.groups(size):
            b = P.Batch(wide, at[own], size[own])
            out += self.uses(b, weight[own[b.order]])
        for u in np.flatnonzero(size > P.LONG):
            self.long_uses(wide[at[u] : at[u] + size[u]], float(weight[u]), out)
        return out

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word data[start:end] behind a space."""
        out = np.zeros(len(start))
        wide, at, size = spaced(data, start, end)
        for own in P.groups(size):
            b = P.Batch(wide, at[own], size[own])
            out[own[b.order]] = self.batch(b)
        for u in np.flatnonzero(size > P.LONG):
            out[u] = self.long(wide[at[u] : at[u] + size[u]])
        return out


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of the words data[start:end], each behind a space."""
    size = end - start + 1
    at = np.cumsum(size) - size
    wide = np.full(int(size.sum()), 0x20, np.uint8)
    wide[B.ragged(at + 1, size - 1)] = data[B.ragged(start, size - 1)]
    return wide, at, size


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def chunk_words(t: pa.Table) -> tuple[B.Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, sorted distinct word hashes, number in them of each word, a word of each, training count of each)."""
    b = B.Block(*B.buffers(t.column("text")), lower=True)
    keys, index, inverse = np.unique(b.word_hash, return_index=True, return_inverse=True)
    training = ~np.asarray(t.column("held_out").to_numpy(zero_copy_only=False), bool)
    return b, keys, inverse, index, np.bincount(inverse, weights=training[b.doc], minlength=len(keys)).astype(np.int64)


COUNTS = "chunk long, bucket long, vals binary, n_types long, n_tokens long"


def total(t: pa.Table) -> pa.Table:
    """Twice the total counts back to the chunks, one more to the one chunk that teaches the word; the first row has the number of distinct training words and of all."""
    order, group, folded, first = X.fold_bucket(t, np.int64, np.add.reduceat)
    answer = np.empty(len(order), np.int64)
    answer[order] = 2 * folded[group]
    answer[order[first]] += folded > 0
    at = np.cumsum([0, *(len(x.as_buffer()) // 8 for x in t.column("keys"))])
    rest = [0] * (t.num_rows - 1)
    return X.table_of(
        {
            "chunk": t.column("chunk").to_pylist(),
            "bucket": t.column("bucket").to_pylist(),
            "vals": [answer[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)],
            "n_types": [int((folded > 0).sum()), *rest],
            "n_tokens": [int(folded.sum()), *rest],
        },
        COUNTS,
    )


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mixed_score double, learned_score double"

TAUGHT = "data binary, size binary, weight binary"


def taught_words(t: pa.Table, a: pa.Table) -> pa.Table:
    """The distinct training words that a chunk teaches, with their weights."""
    if not t.num_rows:
        return X.table_of({}, TAUGHT)
    b, _, _, index, _ = chunk_words(t)
    c = X.answer_of(a, np.int64)
    start, size = b.start[index], b.end[index] - b.start[index]
    own = np.flatnonzero(c % 2 == 1)
    data = b.data[B.ragged(start[own], size[own])]
    return X.table_of({"data": [data.tobytes()], "size": [size[own].astype(np.int64).tobytes()], "weight": [(1 / (c[own] >> 1)).tobytes()]}, TAUGHT)


def learn(taught: DataFrame, lattice: Lattice, path: str) -> Lattice:
    """The lattice with weights learned from the words; what comes to the driver is a sum for each piece and byte."""
    for _ in range(ROUNDS):
        own = lattice.piece, lattice.byte

        def uses(tables: Iterator[pa.RecordBatch], own: tuple[np.ndarray, np.ndarray] = own) -> Iterator[pa.RecordBatch]:
            model = Lattice(P.load(path))
            model.piece, model.byte = own
            out = np.zeros(len(model.piece) + 256)
            for t in tables:
                for data, size, weight in zip(*[t.column(c) for c in ("data", "size", "weight")], strict=True):
                    n = np.frombuffer(size.as_buffer(), np.int64)
                    end = np.cumsum(n)
                    out += model.expected(np.frombuffer(data.as_buffer(), np.uint8), end - n, end, np.frombuffer(weight.as_buffer(), np.float64))
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["piece", "n"])

        expected = np.zeros(len(own[0]) + 256)
        for piece, n in taught.mapInArrow(uses, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            expected[piece] = n
        lattice = lattice.taught(expected)
    return lattice


def score(docs: DataFrame, path: str = P.MODEL) -> DataFrame:
    """Base, lattice and learned scores of every document."""
    n_bytes = X.text_bytes(docs)
    texts = X.chunked(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out")], n_bytes)
    n = X.n_buckets(docs, n_bytes // 30)

    def ask(t: pa.Table) -> pa.Table:
        _, keys, _, _, count = chunk_words(t)
        return X.ask(X.chunk_no(t), keys, count, n)

    counts = keep(texts.groupBy("chunk").applyInArrow(ask, X.ASK).groupBy("bucket").applyInArrow(total, COUNTS), "words")
    sums = counts.agg(F.coalesce(F.sum("n_types"), F.lit(0)).alias("v"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()
    n_docs = docs.where(~held_out(F.col("doc_id"))).count()
    train_tokens, n_types = sums.n + n_docs, sums.v + (n_docs > 0)
    answers = counts.select("chunk", "bucket", "vals")
    taught = keep(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(taught_words, TAUGHT), "taught")
    learned = learn(taught, Lattice(P.load(path)), path)
    weights = learned.piece, learned.byte

    def mixed(c: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log probability of tokens of count c and log probability logp by pieces."""
        if not train_tokens:
            return logp
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(c), np.log(n_types) + logp) - np.log(train_tokens + n_types)

    log_total = float(np.log10(train_tokens + 0.5 * (n_types + 1)))

    def run(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.table_of({}, OUT)
        b, keys, inverse, index, _ = chunk_words(t)
        c = X.answer_of(a, np.int64) >> 1
        lattice = Lattice(P.load(path))
        logp = lattice.words(b.data, b.start[index], b.end[index])
        both = mixed(c, logp)
        lattice.piece, lattice.byte = weights
        taught = mixed(c, lattice.words(b.data, b.start[index], b.end[index]))
        per_doc = lambda x: np.bincount(b.doc, weights=x[inverse], minlength=b.n) if len(b.start) else np.zeros(b.n)
        tokens = b.n_words + 1
        last = float(mixed(np.array([n_docs]), np.array([lattice.end]))[0])
        base = per_doc(np.log10(c + 0.5)) + np.log10(n_docs + 0.5) - tokens * log_total
        return pa.table(
            [t.column("doc_id"), t.column("held_out"), pa.array(tokens.astype(np.int64)), pa.array(per_doc(c > 0).astype(np.int64) + (n_docs > 0)), pa.array(np.full(b.n, train_tokens)), pa.array(base), pa.array((per_doc(logp) + lattice.end) / LN10), pa.array((per_doc(both) + last) / LN10), pa.array((per_doc(taught) + last) / LN10)],
            names=[x.split()[0] for x in OUT.split(", ")],
        )

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, OUT)
