"""Conversation repair against a search over all edits, over odd rows, long conversations and cut segments."""

import collections
import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from quire.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, part int, audit string, cost string, _md5 int, key string"
LONG_ID = 7


def spoiled(rows):
    """Plain damage: {conv: [(turn, role, text)]} in order."""
    out = collections.defaultdict(list)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] if r[2] is not None else " ", (r[3] if r[3] is not None else " ")[:64], hashlib.md5((r[3] if r[3] is not None else " ").encode()).hexdigest())
    for conv, turn, role, text in sorted((r[:4] for r in rows), key=key):
        role, text = (" " if x is None else x for x in (role, text))
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out[conv] += [(turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, roles and texts): the ASCII-least of the cheapest edit strings, by Dijkstra over (cost, string)."""
    seen, kinds = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(fault)
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, q, built = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in ("", "a"):
            return cost, audit, built, kinds
        for name in ("user", "assistant"):
            if (q, name[0]) in grammar:
                heapq.heappush(heap, (cost + 2, audit + "I", i, name[0], (*built, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, built))
            if kinds[i] not in ("blank", "duplicate"):
                more = kinds[i] == "truncated"
                if (q, role[:1]) in grammar:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, grammar[q, role[:1]], (*built, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (q, name[0]) in grammar:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, name[0], (*built, f"{name}:{text}")))


def expected(rows):
    out = []
    for conv, own in spoiled(rows).items():
        cost, audit, built, kinds = cheapest(own)
        turns = [t for t, _, _ in own if t is not None]
        count = collections.Counter(kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(built).encode()).hexdigest()))
    return sorted(out, key=repr)


def talk():
    rng = np.random.Generator(np.random.PCG64(11))
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Why?", "cut off", "", " \t", "ü 漢字.", None, "Yes.", "." * 70 + "x", "." * 70 + "y."]
    some = lambda conv, n, turn: [(conv, turn(i), roles[int(rng.integers(0, 8))], texts[int(rng.integers(0, 11))], 1, "a", "c", 2, "k") for i in range(n)]
    rows = []
    for conv in range(200, 260):
        rows += some(conv, int(rng.integers(1, 9)), lambda i: i)
    rows += some(None, 12, lambda i: i // 2)
    rows += some(300, 9, lambda i: None if i < 3 else i)
    rows += some(301, 40, lambda i: 5)  # ties, with different texts
    rows += [(302, 3, "user", "Same.", 1, "a", "c", 2, "k")] * 60  # equal rows
    rows += [(LONG_ID, i, ("user", "assistant")[i % 2] if i % 17 else "system", f"Turn {i % 150}{'.' if i % 5 else ''}", 1, "a", "c", 2, "k") for i in range(500)]
    rows.append((303, 0, "user", "long. " * 400_000 + "end", 1, "a", "c", 2, "k"))
    dropped = next(k for k in range(400, 500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone.", 1, "a", "c", 2, "k"))
    return rows


@pytest.mark.parametrize("size", [C.SEGMENT_BYTES, 60_000])
def test_repair_is_the_cheapest_and_ascii_least(spark, monkeypatch, size):
    monkeypatch.setattr(C, "SEGMENT_BYTES", size)
    rows = talk()
    out = C.repaired(C.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert out.columns == ["conv_id", *C.COUNTS, "audit", "repaired_sha256"]
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == expected(rows)


def test_long_conversation_is_cut(spark, monkeypatch):
    """Its rows are in several ranges, none of them with most of it."""
    monkeypatch.setattr(C, "SEGMENT_BYTES", 1000)
    rows = [r for r in talk() if r[0] in (LONG_ID, 302) for _ in range(10 if r[0] == 302 else 1)]
    seen = []
    crossing = C.crossing
    monkeypatch.setattr(C, "crossing", lambda pending, kind: seen.append(pending.groupBy("conv_id", "part").count().collect()) or crossing(pending, kind))
    got = sorted((tuple(r) for r in C.repaired(C.damaged(spark.createDataFrame(rows, SCHEMA))).collect()), key=repr)
    assert got == expected(rows)
    for conv, n in ((LONG_ID, 500), (302, 600)):
        sizes = [r["count"] for r in seen[0] if r.conv_id == conv]
        assert len(sizes) > 3 and max(sizes) < n / 2


def test_undamaged_good_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "A?"), (2, 6, "assistant", "B.")]
    got = {r.conv_id: r for r in C.repaired(C.undamaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (got[1].audit, got[1].cost, got[2].audit, got[2].cost) == ("KKK", 0, "KK", 0)
    assert got[2].repaired_sha256 == hashlib.sha256(b"user:A?\nassistant:B.").hexdigest()


def test_empty_table(spark):
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
