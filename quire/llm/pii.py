"""Personal data by patterns and a linear-chain conditional random field (operator 5).

Base spans of four kinds come from fixed patterns over the bytes of whole texts.  The CRF adds spans
that the patterns miss: telephone numbers without a plus sign, spelt-out addresses, card-like
numbers, and secrets.  It labels words by shape features of the word and its two neighbours, is
trained on a small labelled table made by rule, and is decoded by Viterbi over batches of sequences.

Whole texts are decoded.  A word whose best label leads every other one by more than any labels of its
neighbours can make up has that label in the best sequence; such words cut a text into runs that are
decoded apart, with the transitions from and to the words around them, so the result is that of one
Viterbi pass over the text.  Runs of a block advance together, the shorter ones dropping out.

Of a run of words of one label, what lies outside base spans is split where an item is complete, so
neighbours of one kind are spans of their own and base spans stay as they are.  Items that ``plausible``
refuses are dropped: an email needs an ``@``, or a word ``at`` within it and a dot behind that, a card 13 to 19 digits, a phone 7 to 15, a
secret 12 bytes and 2 digits; an ip is never added, as the base pattern finds all of four numbers.  A
secret is also a value of ``SHORT`` bytes or more, with a letter and a digit or sign, behind a strong cue
and ``=`` or ``:``; that rule is a pattern, not the CRF, and ``n_pattern`` counts its spans.  An item of more than
``LONGEST`` words is found only if it is all of a run of one label.

Null and empty texts have no spans; rows without an id, and repeated rows, are judged as any other.
Offsets are code points, ends exclusive.  Every step takes time in proportion to the text, however long
a run of digits or letters is and however many spans it has.  Equal costs of two cuts go to the item that
begins earlier.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x: bytes) -> bytes:
    return bytes(c for c in x if 48 <= c <= 57)


def luhn(number: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        n = (c - 48) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(t: bytes) -> Iterator[tuple[int, int]]:
    at, least = t.find(b"@"), 0
    while at >= 0:
        start = at
        while start > least and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            yield start, m.end()
        least = m.end() if m else at + 1
        at = t.find(b"@", least)


def base_spans(t: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes, by kind and start."""
    out = [(0, s, e) for s, e in emails(t)] if b"@" in t else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m[0].split(b".")))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if b"+" in t:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- features

#: Cue words; fixed values.
CUES = (
    "at", "dot", "tel", "phone", "call", "mobile", "fax", "mail", "email", "e-mail", "card", "visa", "token", "password", "passwd", "secret", "key", "api_key", "apikey", "api-key", "access_key", "bearer", "pwd", "ip", "=", ":", "(at)", "[at]", "(dot)", "[dot]", "com", "org", "net",
)
#: Cues that announce a secret; fixed values.
STRONG = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "bearer", "pwd")

_CLASS = np.full(256, 9, np.uint8)
for _chars, _n in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b"@", 4), (b".", 5), (b"-", 6), (b"+", 7), (b"()[]{}", 8), (b"=", 10), (b"\"'`", 11), (b":", 12), (b"_/\\", 13), (b",;!?", 14)):
    _CLASS[list(_chars)] = _n
_CLASS[128:] = 1
SHAPES = 1 << 11
N_FEATURES = SHAPES + 100 + (len(CUES) + 1) + 64


@cache
def _cue_keys() -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer("".join(CUES).encode(), np.uint8)
    size = np.array([len(c.encode()) for c in CUES])
    end = np.cumsum(size)
    key = B.span_hashes(data, end - size, end)
    order = np.argsort(key)
    return key[order], order


class Features:
    """Feature numbers of the words of a block: four for each word."""

    def __init__(self, b: B.Block):
        kind = _CLASS[b.data]
        size = b.end - b.start
        count = lambda flags: (s := B.prefix_sum(flags))[b.end] - s[b.start]
        letter = (kind == 1) | (kind == 2)
        n_digit = count(kind == 3)
        low = B.LOWER[b.data]
        keep_start, keep_end = b.start, b.end
        key = B.span_hashes(low, keep_start, keep_end)
        trimmed_end = np.where((size > 1) & np.isin(kind[b.end - 1], (5, 12, 14)), b.end - 1, b.end)
        keys, index = _cue_keys()
        cue = np.zeros(len(size), np.int64)
        for k in (B.span_hashes(low, b.start, trimmed_end), key):
            at = np.searchsorted(keys, k)
            at[at == len(keys)] = 0
            hit = keys[at] == k
            cue[hit] = index[at[hit]] + 1
        run_first = np.ones(len(kind), bool)
        run_first[1:] = kind[1:] != kind[:-1]
        run_first[b.start] = True
        runs = np.flatnonzero(run_first)
        shape_start, shape_end = np.searchsorted(runs, b.start), np.searchsorted(runs, b.end)
        shape = B.span_hashes(kind[runs], shape_start, shape_end) % np.uint64(SHAPES)
        digit_band = np.searchsorted([1, 2, 4, 5, 7, 9, 12, 13, 20], n_digit, "right")
        size_band = np.searchsorted([2, 4, 8, 12, 16, 20, 32, 40, 64], size, "right")
        signs = (count(kind == 4) > 0) + 2 * (count(kind == 5) > 1) + 4 * (count(kind == 6) > 0) + 8 * ((n_digit > 0) & (count(letter) > 0)) + 16 * (count(kind == 8) > 0) + 32 * (count((kind == 10) | (kind == 11)) > 0)
        self.ids = np.stack([shape.astype(np.int64), SHAPES + digit_band * 10 + size_band, SHAPES + 100 + cue, SHAPES + 101 + len(CUES) + signs], axis=1)


# ---------------------------------------------------------------- model


class Crf:
    """Emission weights (feature; own, previous, next; label) and transition weights."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def emissions(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of the labels of words; ``first`` marks the words that begin a text."""
        code = ids @ np.array([1, SHAPES, SHAPES * 100, SHAPES * 100 * (len(CUES) + 1)]) if len(ids) else np.zeros(0, np.int64)
        _, index, inverse = np.unique(code, return_index=True, return_inverse=True)
        each = self.emit[ids[index]].sum(axis=1).reshape(len(index), 3, len(LABELS))
        out = each[inverse, 0]
        inner = np.flatnonzero(~first)
        out[inner] += each[inverse[inner - 1], 1]
        out[inner - 1] += each[inverse[inner], 2]
        return out

    def certain(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best label by emission, whether it is the label in every best sequence) of words."""
        m = self.move
        least = np.zeros((len(LABELS), len(LABELS)))  # [y, z]: the lead over z with which y is certain
        for y in range(len(LABELS)):
            into, out = (m - m[:, y : y + 1]).max(axis=0), (m - m[y : y + 1]).max(axis=1)
            least[y] = np.maximum(into, 0) + np.maximum(out, 0)
        top = emit.argmax(axis=1)
        lead = emit[np.arange(len(emit)), top][:, None] - emit - least[top]
        lead[np.arange(len(emit)), top] = np.inf
        return top, (lead > 1e-4).all(axis=1)

    def viterbi(self, emit: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best labels of the sequences emit[first : first + length], advancing together; others stay 0."""
        out, back = np.zeros(len(emit), np.int8), np.zeros((len(emit), len(LABELS)), np.int8)
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        steps = int(length[0]) if len(length) else 0
        live = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than i
        best = emit[first]
        for i in range(1, steps):
            at = first[: live[i]] + i
            total = best[: live[i], :, None] + self.move
            back[at] = total.argmax(axis=1)
            best[: live[i]] = total.max(axis=1) + emit[at]
        out[first + length - 1] = best.argmax(axis=1)
        for i in range(steps - 1, 0, -1):
            at = first[: live[i]] + i
            out[at - 1] = back[at, out[at]]
        return out

    def decode(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best labels of the words of texts; ``first`` marks the words that begin a text."""
        emit = self.emissions(ids, first)
        top, sure = self.certain(emit)
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return top.astype(np.int8)
        new = np.concatenate([[True], (np.diff(open_) > 1) | first[open_[1:]]])
        begin = open_[new]
        length = np.diff(np.append(np.flatnonzero(new), len(open_)))
        end = begin + length
        left = begin[~first[begin]]
        emit[left] += self.move[top[left - 1]]
        right = end[(end < len(ids))]
        right = right[~first[right]]
        emit[right - 1] += self.move[:, top[right]].T
        return np.where(sure, top, self.viterbi(emit, begin, length)).astype(np.int8)


def labelled_rows(n: int = 1200, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The labelled table: sentences of made-up words around personal data and harmless numbers, by rule."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda k: "".join(str(int(x)) for x in rng.integers(0, 10, k))
    syllables = "the an er in on re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve con que los ung ich ein der eau ment elle".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def plain() -> str:
        w = word()
        w = w.capitalize() if rng.random() < 0.15 else w
        return w + pick([",", ".", "", "", "", ""])

    def email() -> tuple[list[str], list[int]]:
        user, host, end = pick([word(), f"{word()}.{number(2)}", f"{word()}_{word()}"]), pick([word(), f"mail{number(1)}.example"]), pick(["com", "org", "net", "de"])
        return pick([([f"{user}@{host}.{end}"], [1]), ([user, "at", host, "dot", end], [1] * 5), ([user, "(at)", host, "(dot)", end], [1] * 5), ([user, "[at]", f"{host}.{end}"], [1] * 3), ([f"{word()}.{user}@{host}.{end}{word()}"], [1])])

    def phone() -> tuple[list[str], list[int]]:
        a, b, c = number(3), number(3), number(4)
        return pick([([f"+1", f"({a})", f"555-{c}"], [4] * 3), ([f"({a})", f"{b}-{c}"], [4] * 2), ([f"{a}-{b}-{c}"], [4]), ([f"{a}.{b}.{c}"], [4]), ([f"+{number(2)}", a, b, c], [4] * 4), ([f"0{a}", f"{b}{c}"], [4] * 2), ([f"+{number(11)}"], [4])])

    def card() -> tuple[list[str], list[int]]:
        return pick([([number(16)], [3]), ([number(4) for _ in range(4)], [3] * 4), (["-".join(number(4) for _ in range(4))], [3]), ([number(15)], [3])])

    def address() -> tuple[list[str], list[int]]:
        return [".".join(str(int(x)) for x in rng.integers(0, 256, 4))], [2]

    def secret() -> tuple[list[str], list[int]]:
        value = "".join(pick("0123456789abcdef") for _ in range(int(pick([32, 40, 40, 64]))))
        mixed = "".join(pick("0123456789abcdefghijkABCDEFGHIJK") for _ in range(20))
        name = pick(["token", "api_key", "secret", "password", "access_key"])
        return pick([([name, "=", f'"{value}"'], [0, 0, 5]), ([f"{name}:", mixed], [0, 5]), ([name, "=", mixed], [0, 0, 5]), ([f"{name}={value}"], [5]), ([value], [5])])

    def harmless() -> tuple[list[str], list[int]]:
        w = pick([[number(int(rng.integers(1, 5)))], [number(2) + ":" + number(2)], [f"20{number(2)}-{number(2)}-{number(2)}"], [f"{number(1)}.{number(2)}"], [f"${number(3)}"], [f"{number(2)}%"], [f"v{number(1)}.{number(1)}.{number(1)}"], [number(6)], [f"({number(4)})"], [number(3) + ","], [f"{number(2)}/{number(2)}/{number(4)}"], [f"#{number(3)}"], ["key", "of"], ["secret", word()], ["token", word()], [word(), "=", number(2)], [number(1), "-", number(2)], [f"{word()}_{number(1)}"], ["call", word()], ["password", "is", "not"], ["at", word()], [word() + "@" + word()], [f"{word()}({number(1)});"], [f"x{number(2)}", "=", f"y{number(2)};"]])
        return w, [0] * len(w)

    rows = []
    for _ in range(n):
        words, labels = [], []
        for part in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 6))):
                words.append(plain()), labels.append(0)
            w, y = pick([email, phone, card, address, secret, harmless, harmless])()
            if y[-1] and rng.random() < 0.3:
                w = [*w[:-1], w[-1] + pick([",", "."])]
            words += w
            labels += y
        words += (tail := [plain() for _ in range(int(rng.integers(1, 5)))])
        labels += [0] * len(tail)
        rows.append((words, [LABELS[x] for x in labels]))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "words array<string>, labels array<string>")


def fit(rows: list[tuple[list[str], list[str]]], steps: int = 60, ridge: float = 2e-4) -> Crf:
    """Maximum likelihood by forward-backward over padded batches, with Adam."""
    k = len(LABELS)
    texts = pa.array([" ".join(w) for w, _ in rows])
    b = B.Block(*B.buffers(texts))
    ids = Features(b).ids
    n = b.n_words
    gold = np.array([LABELS.index(y) for _, ys in rows for y in ys])
    longest, m = int(n.max()), len(n)
    mask = np.arange(longest) < n[:, None]
    where = np.zeros((m, longest), np.int64)
    where[mask] = np.arange(len(ids))
    padded = np.zeros((m, longest, k))
    emit, move = np.zeros((N_FEATURES, 3 * k)), np.zeros((k, k))
    first = np.zeros(len(ids), bool)
    first[b.word_off[:-1][n > 0]] = True
    inner = np.flatnonzero(~first)
    one = np.zeros((len(ids), k))
    one[np.arange(len(ids)), gold] = 1
    counted = np.zeros((k, k))
    np.add.at(counted, (gold[inner - 1], gold[inner]), 1)
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    lse = lambda x, axis: (top := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))
    for step in range(1, steps + 1):
        each = emit[ids].sum(axis=1).reshape(-1, 3, k)
        e = each[:, 0].copy()
        e[inner] += each[inner - 1, 1]
        e[inner - 1] += each[inner, 2]
        padded[mask] = e
        alpha, beta = np.zeros((m, longest, k)), np.zeros((m, longest, k))
        alpha[:, 0] = padded[:, 0]
        for i in range(1, longest):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + move, 1) + padded[:, i], alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], lse(move + (padded[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])[mask]
        expected = np.zeros((k, k))
        for i in range(1, longest):
            live = mask[:, i]
            expected += np.exp(alpha[live, i - 1, :, None] + move + (padded[live, i] + beta[live, i])[:, None, :] - z[live, None, None]).sum(axis=0)
        r = p - one
        grads = np.zeros((len(ids), 3, k))
        grads[:, 0] = r
        grads[inner - 1, 1] = r[inner]
        grads[inner, 2] = r[inner - 1]
        g_emit = np.zeros_like(emit)
        for f in range(ids.shape[1]):
            np.add.at(g_emit, ids[:, f], grads.reshape(len(ids), -1))
        for x, g, at in ((emit, g_emit / m + ridge * emit, 0), (move, (expected - counted) / m + ridge * move, 2)):
            moments[at] = 0.9 * moments[at] + 0.1 * g
            moments[at + 1] = 0.99 * moments[at + 1] + 0.01 * g * g
            x -= 0.15 * (moments[at] / (1 - 0.9**step)) / (np.sqrt(moments[at + 1] / (1 - 0.99**step)) + 1e-8)
    return Crf(emit.astype(np.float32), move.astype(np.float32))


# ---------------------------------------------------------------- spans

_TRIM = b".,;:!?\"'`"


def plausible(kind: int, size: int, n_digit: int, mail: bool) -> bool:
    """Limits that an added span of a kind keeps: its bytes, its digits, and whether it reads as an address."""
    if kind == 0:
        return mail
    if kind == 2:
        return 13 <= n_digit <= 19
    if kind == 3:
        return 7 <= n_digit <= 15
    return kind == 4 and size >= 12 and n_digit >= 2


def labelled_runs(b: B.Block, model: Crf) -> Iterator[tuple[int, int, int, int]]:
    """(document, kind, first word, end word) of the runs of words that the CRF gives one label."""
    if not len(b.start):
        return
    begins = np.concatenate([[True], b.doc[1:] != b.doc[:-1]])
    label = model.decode(Features(b).ids, begins)
    new = begins | np.concatenate([[True], label[1:] != label[:-1]])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(label))
    for x, y in zip(lo[label[lo] > 0], hi[label[lo] > 0], strict=True):
        yield int(b.doc[x]), int(label[x]) - 1, int(x), int(y)


def sums(flags: list) -> list[int]:
    return [0, *accumulate(map(int, flags))]


#: Words of an item at most, unless it is a whole run: room for an address spelt out letter by letter.
LONGEST = 64


def entities(kind: int, t: bytes, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the single items in a run of words (start, end) of one kind.

    The cheapest cut into plausible items: a word left out costs most, then an item that holds what
    opens another, a line break, or two words that are items by themselves; sizes near the usual win ties.
    Counts of a stretch of words are differences of running sums.
    """
    n = len(words)
    text = [t[s:e] for s, e in words]
    n_digit = sums([len(digits(x)) for x in text])
    broken = sums([k > 0 and b"\n" in t[words[k - 1][1] : words[k][0]] for k in range(n)])
    sign = [x.strip(b"()[]").lower() == b"at" for x in text]
    at, signs, dots = sums([b"@" in x for x in text]), sums(sign), sums([x.strip(b"()[]").lower() == b"dot" or b"." in x.strip(_TRIM) for x in text])
    mail = lambda i, j: at[j] > at[i] or (j > i + 2 and signs[j - 1] > signs[i + 1] and dots[j] > dots[i + 2])
    if kind == 0:
        alone = sums([sign[k] or b"@" in text[k] for k in range(n)])
        opens = sums([b"@" in text[k] or (k + 1 < n and sign[k + 1]) for k in range(n)])
    else:
        alone = sums([plausible(kind, len(x), len(digits(x)), False) for x in text])
        opens = sums([kind == 3 and (x[:1] == b"+" or (x[:1] == b"(" and (not k or text[k - 1][:1] != b"+"))) for k, x in enumerate(text)])
    head = [s + len(x) - len(x.lstrip(_TRIM)) for (s, _), x in zip(words, text, strict=True)]
    tail = [e - len(x) + len(x.rstrip(_TRIM)) for (_, e), x in zip(words, text, strict=True)]
    best, back = [0.0], [(0, -1, -1)]
    for j in range(1, n + 1):
        cost, how = best[j - 1] + 20, (j - 1, -1, -1)
        for i in (*range(max(0, j - LONGEST), j), *([0] if j == n > LONGEST else [])):
            s, e, size = head[i], tail[j - 1], n_digit[j] - n_digit[i]
            if s >= e or not plausible(kind, e - s, size, kind == 0 and mail(i, j)):
                continue
            odd = 0.5 * (size not in (15, 16)) if kind == 2 else 0.01 * (size - 10) ** 2 if kind == 3 else 0
            now = best[i] + 0.1 + odd + 3 * (broken[j] - broken[i + 1]) + 2 * max(0, alone[j] - alone[i] - 1) + 10 * (opens[j] - opens[i + 1])
            if now < cost:
                cost, how = now, (i, s, e)
        best.append(cost), back.append(how)
    out = []
    while n:
        n, s, e = back[n]
        if s >= 0:
            out.append((s, e))
    yield from reversed(out)


class Taken:
    """Spans of one text, as disjoint stretches in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for s, e in sorted(spans):
            if self.end and s <= self.end[-1]:
                self.end[-1] = max(self.end[-1], e)
            else:
                self.start.append(s), self.end.append(e)

    def outside(self, s: int, e: int) -> Iterator[tuple[int, int]]:
        """The parts of (s, e) that lie in no span."""
        k = bisect_right(self.end, s)
        while k < len(self.start) and self.start[k] < e:
            if s < self.start[k]:
                yield s, self.start[k]
            s, k = max(s, self.end[k]), k + 1
        if s < e:
            yield s, e


SHORT = 6
#: A strong cue that no letter or digit stands before, = or :, and what opens the value; the value may hold the next cue.
_CUE = re.compile(rb"(?i)(?<![A-Za-z0-9])(?:" + b"|".join(sorted((re.escape(c.encode()) for c in STRONG), key=len, reverse=True)) + rb")[\x20\t\"']*+[:=][\x20\t]*+[\"']?")
_STOP = re.compile(rb"[\s\"']|&(?=[A-Za-z0-9_.-]++=)")
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])


def short_secrets(t: bytes) -> Iterator[tuple[int, int]]:
    """Values behind a strong cue and = or :, with a letter and a digit or sign, however far the cue is padded.

    A value ends at white space, a quote, or the next parameter of a query string.  Of values that begin within
    another, the outer one is given.  Ends, and what a value holds, are looked up, so values within values cost no more.
    """
    cues = [m.end() for m in _CUE.finditer(t)]
    if not cues:
        return
    data = np.frombuffer(t, np.uint8)
    stops = [*(m.start() for m in _STOP.finditer(t)), len(t)]
    letters = B.prefix_sum(_LETTER[data])
    place = np.arange(1, len(t) + 1)
    solid = np.maximum.accumulate(np.where(np.isin(data, np.frombuffer(_TRIM, np.uint8)), 0, place))  # end of the last byte that is not trimmed
    done = 0
    for at in cues:
        end = stops[bisect_left(stops, at)]
        end = max(at, int(solid[end - 1])) if end > at else at
        n = int(letters[end] - letters[at])
        if at >= done and end - at >= SHORT and 0 < n < end - at:
            done = end
            yield at, end


_DIGIT = (np.arange(256) >= 48) & (np.arange(256) < 58)
Span = tuple[int, int, int]
NONE = Taken([])


def block_spans(b: B.Block, model: Crf) -> tuple[dict[int, list[Span]], dict[int, list[Span]], dict[int, int]]:
    """(base spans, all spans, how many of them by the pattern of secrets) by document, in code points of the text, ordered by kind and start."""
    patterns: dict[int, int] = {}
    points = B.prefix_sum((b.data & 0xC0) != 0x80)
    some = np.flatnonzero((B.per_doc(_DIGIT[b.data], b.off) > 0) | (B.per_doc(b.data == 64, b.off) > 0))
    raw = {int(i): [(k, s + int(b.off[i]), e + int(b.off[i])) for k, s, e in base_spans(b.text(i))] for i in some}
    every = {i: list(v) for i, v in raw.items()}
    base = {i: Taken([(s, e) for _, s, e in v]) for i, v in raw.items()}
    for i, kind, first, last in labelled_runs(b, model):
        own = every.setdefault(i, [])
        for lo, hi in base.get(i, NONE).outside(int(b.start[first]), int(b.end[last - 1])):
            x, y = max(first, int(np.searchsorted(b.end, lo, "right"))), min(last, int(np.searchsorted(b.start, hi, "left")))
            words = [(max(s, lo) - lo, min(e, hi) - lo) for s, e in zip(b.start[x:y].tolist(), b.end[x:y].tolist(), strict=True)]
            own += [(kind, s + lo, e + lo) for s, e in entities(kind, b.data[lo:hi].tobytes(), words)]
    for i in np.flatnonzero(B.per_doc((b.data == 58) | (b.data == 61), b.off) > 0).tolist():
        at, own = int(b.off[i]), every.setdefault(i, [])
        free = Taken([(s, e) for _, s, e in own])
        found = [(4, lo, hi) for s, e in short_secrets(b.text(i)) for lo, hi in free.outside(s + at, e + at)]
        own += found
        patterns[i] = len(found)
    place = lambda spans, i: sorted((k, int(points[s] - points[b.off[i]]), int(points[e] - points[b.off[i]])) for k, s, e in spans)
    return {i: place(v, i) for i, v in raw.items() if v}, {i: place(v, i) for i, v in every.items() if v}, patterns


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_pattern long"


def find(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Spans of every document; one narrow pass."""
    emit, move = (m := model or fit(labelled_rows())).emit, m.move

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(emit, move)
        for batch in batches:
            for lo, hi, b in B.blocks(batch.column(1)):
                base, every, patterns = block_spans(b, crf)
                own = [base.get(i, []) for i in range(b.n)]
                alls = [every.get(i, []) for i in range(b.n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array([sum(k == kind for k, _, _ in x) for x in own], pa.int64()) for kind in range(4)), pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in own]), pa.array([written(x) for x in alls], pa.string()), pa.array([len(x) - len(y) for x, y in zip(alls, own, strict=True)], pa.int64()), pa.array([patterns.get(i, 0) for i in range(b.n)], pa.int64())],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Crf | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text; all columns stay."""
    emit, move = (m := model or fit(labelled_rows())).emit, m.move
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(emit, move)
        for batch in batches:
            column = batch.column(at)
            for lo, hi, b in B.blocks(column):
                _, every, _ = block_spans(b, crf)
                part = batch.slice(lo, hi - lo)
                if every:
                    texts = part.column(at).to_pylist()
                    for i, spans in every.items():
                        texts[i] = redacted(texts[i], spans)
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
