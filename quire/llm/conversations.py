"""Repair of conversation structure (operator 11): cheapest edits by a backward cost-to-go DP, then a greedy walk.

``damaged`` spoils rows by a checksum, ``repaired`` repairs any table (conv_id, turn, role, text).  Roles must
have initials ``(s?(ua)+)?``.  The states of that grammar are: nothing yet, after ``s``, after ``u``, after
``a``.  Keep costs 0, Rerole 2, Delete 3 (required for blank and duplicate rows), Insert 2; a truncated row that
stays costs 1 more.  ``cost-to-go`` of a row is one number for each state; less its minimum it takes few values,
so a step is a lookup in a small table that each worker fills.  Walking forward, the ASCII-least edit among those
that keep to the cost-to-go is taken, which gives the ASCII-least of the cheapest edit strings.

Rows are dealt by ranges of (conversation, turn, role, start and MD5 of the text, place), so a conversation of any
length is cut into segments, equal rows included.  Conversations within one range are finished there; the first
and last of each range may go on in the next.  Their segments are kept and solved in three steps: a 4 x 4
min-plus matrix for each, the costs at the cuts (composed in the driver from at most two matrices a range), and
the state in which each segment ends for each state in which it may begin.  The hash of a conversation's text is
sequential by definition; its segments pass one task as a stream, one segment in memory.

Null ids are one conversation; nulls of other columns: roles and texts are one space, turns come first.  Rows of
equal turn go by role, the text's first 64 characters, and its MD5.  Conversations whose rows are all dropped have
zeros, an empty audit and the hash of the empty string.  Extra columns are left out.  An empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import parts, text_bytes
from .store import keep

SEGMENT_BYTES = 32_000_000
SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The state after a role's initial in each state, and the only role that a state may be given by Rerole or Insert.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
GIVEN = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
#: The cost of ending in each state, inserts included.
END = (0, 2 * INSERT, INSERT, 0)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Kind = tuple[str, bool, bool]  # initial of the role, must be deleted, truncated
Costs = tuple[int, int, int, int]


def damaged(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, by_role, by_text): rows by what the checksum of ``conv_id:turn`` does to them; no copies where it drops the row."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("by_role"), plain("text").alias("by_text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("_c"))
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("by_text", ".!?", "")).otherwise(F.col("by_text"))
    copies = F.when(F.col("_c") == 0, 0).when(F.col("_c") == 3, 2).otherwise(1)
    return t.select("conv_id", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("by_role")).alias("role"), text.alias("text"), copies.alias("copies"), "by_role", "by_text")


def undamaged(talks: DataFrame) -> DataFrame:
    """The same columns of rows as they are."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return talks.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role").alias("role"), plain("text").alias("text"), F.lit(1).alias("copies"), plain("role").alias("by_role"), plain("text").alias("by_text"))


def reach(costs: Costs) -> Costs:
    """The least cost once inserts are allowed; two of them lead from any state to any that may be wanted."""
    u = min(costs[USER], INSERT + costs[ASSISTANT])
    a = min(costs[ASSISTANT], INSERT + costs[USER])
    return min(costs[START], INSERT + u), min(costs[SYSTEM], INSERT + u), u, a


def options(kind: Kind, after: Costs, q: int) -> list[tuple[int, str, int]]:
    """(cost to the end, edit, state) of each way to take a row in state q, in ASCII order of the edit."""
    initial, must, cut = kind
    found = [(DELETE + after[q], "D", q)]
    if not must:
        if initial in NEXT[q]:
            found.append((KEEP + cut * CUT_OFF + after[NEXT[q][initial]], "K", NEXT[q][initial]))
        found.append((REROLE + cut * CUT_OFF + after[GIVEN[q]], "R", GIVEN[q]))
    return found


class Steps:
    """The table of steps that a worker has met."""

    def __init__(self) -> None:
        self.met: dict[tuple[Kind, Costs], tuple[Costs, int, tuple[tuple[str, int], ...]]] = {}

    def step(self, kind: Kind, after: Costs) -> tuple[Costs, int, tuple[tuple[str, int], ...]]:
        """(costs before the row less their minimum, that minimum, edits up to and over the row with the state after it, by state)."""
        if (kind, after) not in self.met:
            costs = reach(tuple(min(o[0] for o in options(kind, after, q)) for q in range(4)))
            moves = []
            for q in range(4):
                edits = ""
                while True:
                    taken = [(e, to) for c, e, to in options(kind, after, q) if c == costs[q]]
                    insert = costs[q] == INSERT + costs[GIVEN[q]]
                    if taken and (taken[0][0] == "D" or not insert):
                        break
                    edits, q = edits + "I", GIVEN[q]
                    if len(edits) > 3:  # only from a state out of reach, where all costs are FAR
                        taken = [("D", q)]
                        break
                moves.append((edits + taken[0][0], taken[0][1]))
            low = min(costs)
            self.met[kind, after] = tuple(min(c - low, FAR) for c in costs), low, tuple(moves)
        return self.met[kind, after]

    def back(self, kinds: list[Kind], end: Costs) -> tuple[Costs, list[tuple[tuple[str, int], ...]]]:
        """(costs before the first row, moves of each row) of rows followed by ``end``."""
        low = min(end)
        costs, total, moves = tuple(min(c - low, FAR) for c in end), low, []
        for kind in reversed(kinds):
            costs, more, move = self.step(kind, costs)
            total += more
            moves.append(move)
        moves.reverse()
        return tuple(min(c + total, FAR) for c in costs), moves


def walked(rows: list[tuple[str, str]], moves: list, q: int, last: bool) -> tuple[str, list[str], int]:
    """(edits, repaired ``role:text`` lines, state after) of rows begun in state q."""
    audit, lines = [], []
    for (role, text), move in zip(rows, moves, strict=True):
        edits, to = move[q]
        audit.append(edits)
        for _ in edits[:-1]:
            q = GIVEN[q]
            lines.append(f"{NAME[q]}:")
        if edits[-1] != "D":
            lines.append(f"{NAME[to] if edits[-1] == 'R' else role}:{text}")
        q = to
    while last and END[q]:
        q = GIVEN[q]
        audit.append("I")
        lines.append(f"{NAME[q]}:")
    return "".join(audit), lines, q


def kind_of(role: str, text: str, seen: bool) -> tuple[Kind, str]:
    """The kind of a row, and its first fault."""
    rest = text.strip(SPACES)
    fault = "blank" if not rest else "duplicate" if seen else "truncated" if rest[-1] not in ".!?" else ""
    return (role[:1], fault in ("blank", "duplicate"), fault == "truncated"), fault


def row_key(conv: object, role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{conv!r}\0{role}\0{text}".encode(), digest_size=16).digest()


class Facts:
    """What is counted over rows in order, for segments that are put together in order."""

    def __init__(self) -> None:
        self.turns: list[int | None] = [None, None, 0]  # least, greatest, how many
        self.ends: list[str | None] = [None, None]
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.ends[0] is None:
            self.ends[0] = initial
        else:
            self.faults["illegal"] += self.ends[1] + initial not in ("su", "ua", "au")
        self.ends[1] = initial
        if fault:
            self.faults[fault] += 1

    def join(self, other: Facts) -> None:
        if other.turns[2]:
            same = self.turns[1] == other.turns[0]
            self.turns = [other.turns[0] if self.turns[0] is None else self.turns[0], other.turns[1], self.turns[2] + other.turns[2] - same]
        if other.ends[0] is not None:
            if self.ends[0] is None:
                self.ends[0] = other.ends[0]
            else:
                self.faults["illegal"] += self.ends[1] + other.ends[0] not in ("su", "ua", "au")
            self.ends[1] = other.ends[1]
        for k, n in other.faults.items():
            self.faults[k] += n

    def counts(self, cost: int) -> dict[str, int]:
        low, high, n = self.turns
        return {"gaps": 0 if low is None else high - low + 1 - n, **self.faults, "cost": cost}


def whole(rows: list[tuple], steps: Steps) -> tuple[dict[str, int], str, str]:
    """(counts, audit, hash) of the (turn, role, text) of one conversation, in order."""
    seen: set[tuple[str, bytes]] = set()
    facts, kinds = Facts(), []
    for turn, role, text in rows:
        key = (role, hashlib.blake2b(text.encode(), digest_size=16).digest())
        kind, fault = kind_of(role, text, key in seen)
        seen.add(key)
        facts.add(turn, kind[0], fault)
        kinds.append(kind)
    costs, moves = steps.back(kinds, END)
    audit, lines, _ = walked([r[1:] for r in rows], moves, START, True)
    return facts.counts(costs[START]), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def settled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Finished conversations, and the rows of the first and the last of a range."""
    steps, part = Steps(), TaskContext.get().partitionId()
    out: list[dict] = []
    rows: list[tuple] = []
    conv, slot, any_conv = None, 0, False

    def pending() -> None:
        live = [r for r in rows if r[0] is not None]
        for seq, (_, turn, role, text) in enumerate(live):
            out.append({"conv_id": conv, "part": part, "slot": slot, "seq": seq, "turn": turn, "role": role, "text": text, "key": row_key(conv, role, text)})
        if not live:
            out.append({"conv_id": conv, "part": part, "slot": slot})

    def finished() -> None:
        counts, audit, digest = whole([r[1:] for r in rows if r[0] is not None], steps)
        out.append({"conv_id": conv, **counts, "audit": audit, "repaired_sha256": digest})

    def flush() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()

    for batch in batches:
        for c, turn, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies")), strict=True):
            if any_conv and c != conv:
                if slot:
                    finished()
                else:
                    pending()
                rows, slot = [], 1
            conv, any_conv = c, True
            rows.extend([(0, turn, role, text)] * copies or [(None,)])
        if out:
            yield from flush()
    if any_conv:
        pending()
        yield from flush()


def segment_of(t: pa.Table) -> tuple[list[dict], list[Kind], Facts]:
    """A segment's rows in order, their kinds, and its facts."""
    rows = [r for r in t.sort_by("seq").to_pylist() if r["seq"] is not None]
    facts, kinds = Facts(), []
    for r in rows:
        kind, fault = kind_of(r["role"], r["text"], (r["part"], r["seq"]) != (r["first"]["part"], r["first"]["seq"]))
        facts.add(r["turn"], kind[0], fault)
        kinds.append(kind)
    return rows, kinds, facts


def crossing(pending: DataFrame, conv_type: str) -> DataFrame:
    """The conversations whose rows lie in several ranges, or at the edge of one."""
    first = pending.where("seq IS NOT NULL").groupBy("key").agg(F.min(F.struct("part", "seq")).alias("first"))
    rows = keep(pending.join(first, "key", "left").select("conv_id", "part", "slot", "seq", "turn", "role", "text", "first"), "segments")
    one_a_segment = lambda f, schema: rows.groupBy("part", "slot").applyInArrow(f, schema)

    def matrix(t: pa.Table) -> pa.Table:
        _, kinds, facts = segment_of(t)
        steps = Steps()
        columns = [steps.back(kinds, tuple(0 if p == q else FAR for p in range(4)))[0] for q in range(4)]
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "part": t.column("part").slice(0, 1), "slot": t.column("slot").slice(0, 1), "costs": pa.array([[c for column in columns for c in column]], pa.list_(pa.int64())), "turns": pa.array([facts.turns], pa.list_(pa.int64())), "ends": pa.array([facts.ends], pa.list_(pa.string())), "faults": pa.array([list(facts.faults.values())], pa.list_(pa.int64()))})

    # At most two rows of a few numbers for each range.
    found = sorted(one_a_segment(matrix, f"conv_id {conv_type}, part int, slot int, costs array<long>, turns array<long>, ends array<string>, faults array<long>").collect(), key=lambda r: (r.part, r.slot))
    chains: dict[object, list] = {}
    for r in found:
        chains.setdefault(r.conv_id, []).append(r)
    ends: dict[tuple[int, int], Costs] = {}
    facts: dict[object, dict[str, int]] = {}
    for conv, chain in chains.items():
        after: Costs = END
        for r in reversed(chain):
            ends[r.part, r.slot] = after
            after = tuple(min(r.costs[4 * q + p] + after[q] for q in range(4)) for p in range(4))
        total = Facts()
        for r in chain:
            one = Facts()
            one.turns, one.ends, one.faults = list(r.turns), list(r.ends), dict(zip(one.faults, r.faults, strict=True))
            total.join(one)
        facts[conv] = total.counts(after[START])

    def exits(t: pa.Table) -> pa.Table:
        place = t.column("part")[0].as_py(), t.column("slot")[0].as_py()
        rows, kinds, _ = segment_of(t)
        _, moves = Steps().back(kinds, ends[place])
        at = list(range(4))
        for move in moves:
            at = [move[q][1] for q in at]
        return pa.table({"part": t.column("part").slice(0, 1), "slot": t.column("slot").slice(0, 1), "exits": pa.array([at], pa.list_(pa.int32()))})

    leaves = {(r.part, r.slot): r.exits for r in one_a_segment(exits, "part int, slot int, exits array<int>").collect()}
    enters: dict[tuple[int, int], tuple[int, bool]] = {}
    for chain in chains.values():
        q = START
        for r in chain:
            enters[r.part, r.slot] = q, r is chain[-1]
            q = leaves[r.part, r.slot][q]

    def texts(t: pa.Table) -> pa.Table:
        place = t.column("part")[0].as_py(), t.column("slot")[0].as_py()
        rows, kinds, _ = segment_of(t)
        _, moves = Steps().back(kinds, ends[place])
        audit, lines, _ = walked([(r["role"], r["text"]) for r in rows], moves, *enters[place])
        return pa.table({"conv_id": t.column("conv_id").slice(0, 1), "part": t.column("part").slice(0, 1), "slot": t.column("slot").slice(0, 1), "audit": [audit], "lines": pa.array(["\n".join(lines).encode()], pa.binary()), "empty": [not lines]})

    solved = one_a_segment(texts, f"conv_id {conv_type}, part int, slot int, audit string, lines binary, empty boolean")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, begun, open_ = None, [], hashlib.sha256(), False, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": conv, **facts[conv], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], pa.schema([(f.name, f.type) for f in result]))

        result: list[pa.Field] = []
        for batch in batches:
            result = result or [pa.field("conv_id", batch.schema.field("conv_id").type), *(pa.field(c, pa.int64()) for c in COUNTS), pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
            for r in batch.to_pylist():
                if open_ and r["conv_id"] != conv:
                    yield row()
                    audit, digest, begun = [], hashlib.sha256(), False
                conv, open_ = r["conv_id"], True
                audit.append(r["audit"])
                if not r["empty"]:
                    digest.update((b"\n" if begun else b"") + r["lines"])
                    begun = True
        if open_:
            yield row()

    return solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "slot").mapInArrow(hashed, result_schema(conv_type))


def result_schema(conv_type: str) -> str:
    return f"conv_id {conv_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of what ``damaged`` or ``undamaged`` gives: faults, cost, audit and the hash of the repaired turns."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    n = max(parts(rows), -(-text_bytes(rows, "by_text") // SEGMENT_BYTES))
    order = ["conv_id", "turn", "by_role", "_start", "_md5", "_place"]
    dealt = rows.withColumns({"_start": F.substring("by_text", 1, 64), "_md5": F.md5("by_text"), "_place": F.monotonically_increasing_id()}).drop("by_text")
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    both = f"{result_schema(conv_type)}, part int, slot int, seq long, turn long, role string, text string, key binary"
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in both.split(", "))])
    found = keep(dealt.mapInArrow(lambda batches: settled(batches, schema), both), "conversations")
    results = found.where("audit IS NOT NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    pending = found.where("audit IS NULL").select("conv_id", "part", "slot", "seq", "turn", "role", "text", "key")
    return results.unionByName(crossing(pending, conv_type))
