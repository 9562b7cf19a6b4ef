"""Keyed state, tables of buckets, sessions and live totals against plain versions."""

import collections
import random
import shutil
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from quire import storage
from quire.operators import ledger as batch_ledger
from quire.operators.numbering import numbered
from quire.sources import files
from quire.streaming import ledger, quality, runs, sessions
from quire.streaming.table import MOST_DELTAS, KeyedTable

EVENT = "file_id long, ts timestamp_ntz, event_id long, op string, content_hash string"
START = datetime(2024, 1, 1)


def put(spark, folder, events):
    spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)


def by_file(df):
    return {r.file_id: tuple(r)[1:] for r in df.collect()}


def invented(seed, n_files, n):
    rng = random.Random(seed)
    ops = ["enqueue", "enqueue", "processing", "done", "flag", "failed"]
    return [(rng.randrange(n_files), START + timedelta(minutes=rng.randrange(600)), i, rng.choice(ops), f"h{rng.randrange(2)}") for i in range(n)]


def test_ledger_stream_equals_the_batch_fold(spark, tmp_path):
    """Shuffled and repeated batches, a stop in between, and no way back to earlier events."""
    events = invented(1, 12, 300)
    rng = random.Random(2)
    arrival = sorted(events, key=lambda e: e[1] + timedelta(minutes=rng.randrange(90)))
    cuts = [arrival[i : i + 60] for i in range(0, 300, 60)]
    cuts[2] = cuts[2] + cuts[1][:20] + cuts[0][:5]
    folder, inside = str(tmp_path / "out"), str(tmp_path / "in")
    for cut in cuts[:3]:
        put(spark, inside, cut)
    ledger.run_to_end(stream(spark, inside), folder, "3 hours", buckets=4)
    first = by_file(ledger.ledger_table(spark, folder, 4).read())
    seen = spark.createDataFrame([e for c in cuts[:3] for e in c], EVENT).dropDuplicates(["event_id"])
    assert first == by_file(batch_ledger.fold(seen).select("file_id", *[c.split()[0] for c in ledger.TABLE.split(", ")][1:]))
    shutil.rmtree(inside)  # what was read is not read again
    for cut in cuts[3:]:
        put(spark, inside, cut)
    got = by_file(ledger.run_to_end(stream(spark, inside), folder, "3 hours", buckets=4))
    assert got == by_file(batch_ledger.fold(spark.createDataFrame(events, EVENT)))
    assert len(ledger.ledger_table(spark, folder, 4).versions()) <= 2


def test_ledger_stream_drops_what_is_later_than_the_delay(spark, tmp_path):
    folder, inside = str(tmp_path / "out"), str(tmp_path / "in")
    at = lambda h: START + timedelta(hours=h)
    spark.createDataFrame([], EVENT).write.parquet(inside)
    assert by_file(ledger.run_to_end(stream(spark, inside), folder, "2 hours")) == {}
    put(spark, inside, [(7, at(1), 1, "enqueue", "a"), (7, at(9), 2, "done", "a"), (8, at(9), 3, "done", "a")])
    assert by_file(ledger.run_to_end(stream(spark, inside), folder, "2 hours"))[7][0] == "done"
    put(spark, inside, [(7, at(8), 4, "flag", "a"), (9, at(20), 6, "enqueue", "b")])  # in time
    assert by_file(ledger.run_to_end(stream(spark, inside), folder, "2 hours"))[7][:3] == ("done", "a", False)
    put(spark, inside, [(7, at(12), 7, "failed", "a"), (7, at(9), 2, "done", "a")])  # behind the watermark
    got = by_file(ledger.run_to_end(stream(spark, inside), folder, "2 hours"))
    assert got[7][0] == "done" and got[9][0] == "queued" and 8 not in got
    put(spark, inside, [(7, at(21), 8, "failed", "a")])
    assert by_file(ledger.run_to_end(stream(spark, inside), folder, "2 hours"))[7][:4] == ("failed", "a", False, "event 8")


def test_stable_files_are_forgotten(spark, tmp_path):
    """Their row stays, and later events are those of a new file."""
    folder, inside = str(tmp_path / "out"), str(tmp_path / "in")
    at = lambda h: START + timedelta(hours=h)
    run = lambda: by_file(ledger.run_to_end(stream(spark, inside), folder, "1 hour", forget_ms=3_600_000))
    put(spark, inside, [(1, at(0), 1, "enqueue", "a"), (1, at(1), 2, "done", "a"), (2, at(0), 3, "enqueue", "a")])
    put(spark, inside, [(3, at(10), 4, "enqueue", "a")])
    put(spark, inside, [(3, at(20), 5, "done", "a")])
    assert run()[1][0] == "done"
    put(spark, inside, [(1, at(21), 6, "failed", "a"), (2, at(21), 7, "failed", "a"), (1, at(22), 8, "enqueue", "z")])
    got = run()
    assert got[2][0] == "failed" and got[1] == ("queued", "z", False, None, at(22), at(22))


def test_a_python_step_is_the_native_step(spark):
    events = invented(5, 30, 400)
    own = collections.defaultdict(list)
    for f, ts, i, op, h in events:
        own[f].append((int((ts - datetime(1970, 1, 1)).total_seconds()) * 1_000_000, i, op, h))
    got = {f: ledger.folded(ledger.NEW, sorted(es)) for f, es in own.items()}
    want = by_file(batch_ledger.fold(spark.createDataFrame(events, EVENT)))
    assert {f: s[:4] for f, s in got.items() if s[0]} == {f: s[:4] for f, s in want.items()}


def test_table_takes_deltas(spark, tmp_path):
    """Equals a plain dict after any merges; the bytes of a merge follow its rows; replays and old versions are right."""
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", "k", 8)
    assert table.read().count() == 0
    rng, plain, past = random.Random(3), {}, {}
    size = lambda: storage.written_bytes(spark, f"{tmp_path}/t/data")
    for version in range(1, 9):
        change = {k: f"{version}-{k}" * 20 for k in (range(4000) if version == 1 else [rng.randrange(5000) for _ in range(5)])}
        before = size()
        df = spark.createDataFrame(list(change.items()), "k long, v string").coalesce(1)
        table.merge(df, version)
        if version == 1:
            whole = size()
        else:
            assert size() - before < whole / 8
        if version == 3:
            table.merge(df, version)  # again, as after a failure
        plain.update(change)
        past[version] = dict(plain)
        assert {r.k: r.v for r in table.read().collect()} == plain
    assert {r.k: r.v for r in table.read(4).collect()} == past[4]
    keys = spark.createDataFrame([(1,), (3,), (99_999,)], "k long")
    assert {r.k: r.v for r in table.of(keys, 2).collect()} == {k: past[2][k] for k in (1, 3)}
    table.prune(1)
    assert table.versions() == [8] and {r.k: r.v for r in table.read().collect()} == plain


def test_table_rewrites_a_bucket_when_its_deltas_have_grown(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v long", "k", 1)
    one = lambda v, n: spark.range(n).selectExpr("id AS k", f"{v}L AS v")
    table.merge(one(1, 100), 1)
    for v in (2, 3):
        table.merge(one(v, 40), v)
    assert len(table.manifest()[0]) == 3
    table.merge(one(4, 40), 4)  # 120 rows of deltas on a base of 100
    assert table.manifest()[0] == [(4, 1, 100)]
    for v in range(5, 5 + MOST_DELTAS):
        table.merge(one(v, 1), v)
    assert len(table.manifest()[0]) == 1 and table.read().where("k = 0").first().v == 4 + MOST_DELTAS
    table.prune()
    assert table.read().count() == 100 and storage.written_bytes(spark, f"{tmp_path}/t/data/version=2") == 0


def test_sessions_close_once_and_late_rows_are_kept(spark, tmp_path):
    rng = random.Random(8)
    events = [(rng.randrange(6), START + timedelta(minutes=rng.randrange(4000))) for _ in range(500)]
    slot = lambda e: min(5, (int((e[1] - START).total_seconds() // 60) + rng.choice([0, 0, 0, 200, 1500])) // 700)
    dealt = [(*e, slot(e)) for e in events]
    s = runs.staged(spark.createDataFrame(dealt, "u long, ts timestamp_ntz, slot int"), "slot", 6, str(tmp_path / "in"))
    got = sessions.sessions(s, "u", "ts", 600, "2 hours", str(tmp_path / "out")).collect()
    mark, fresh, late = datetime(1900, 1, 1), collections.defaultdict(list), []
    for k in range(6):
        own = [e for e in dealt if e[2] == k]
        for u, ts, _ in own:
            late.append((u, ts)) if ts < mark else fresh[u].append(ts)
        mark = max([mark, *(e[1] - timedelta(hours=2) for e in own)])
    spans = []
    for u, times in fresh.items():
        for t in sorted(times):
            if spans and spans[-1][0] == u and t - spans[-1][2] < timedelta(minutes=10):
                spans[-1] = (u, spans[-1][1], t, spans[-1][3] + 1)
            else:
                spans.append((u, t, t, 1))
    assert sorted((r.u, r["first"]) for r in got if r.late) == sorted(late) and late
    assert sorted((r.u, r["first"], r["last"], r.n) for r in got if not r.late) == sorted(x for x in spans if x[2] + timedelta(minutes=10) <= mark)


@pytest.mark.parametrize("cut", [[9], [3, 3, 3], [1, 1, 4, 3]])
def test_live_totals_equal_those_of_the_last_records(spark, tmp_path, cut):
    """After any cut of the input, records of a file in any order, some again."""
    rng = random.Random(4)
    rows = [(i % 7, f"s{i % 2}", seq, rng.choice(["ocr", "ocr", "passthrough", "skip_text"]), Decimal(rng.randrange(100)), rng.randrange(9), rng.randrange(9)) for seq in range(3) for i in range(9)]
    rng.shuffle(rows)
    last = {}
    for r in rows:
        if r[0] not in last or last[r[0]][2] < r[2]:
            last[r[0]] = r
    rows = [r for r in rows if r[2] < 2 or last[r[0]] == r]  # one record of a file and number 2
    seen = {}
    rows = [seen.setdefault((r[0], r[2]), r) for r in rows if (r[0], r[2]) not in seen]
    last = {f: max((r for r in rows if r[0] == f), key=lambda r: r[2]) for f in last}
    folder, at = str(tmp_path / "out"), 0
    spark.createDataFrame([], quality.RECORD).write.parquet(str(tmp_path / "in"))
    for k in [*cut, len(rows)]:
        part = rows[at : at + k]
        at += k
        if part:
            spark.createDataFrame(part, quality.RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = runs.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], quality.RECORD))
        quality.folding(s, folder, buckets=2).awaitTermination()
    ocr = [r for r in last.values() if r[3] == "ocr"]
    got = quality.current(spark, folder).first()
    assert (got.passthrough_count, got.skip_text_count, got.ocr_count) == tuple(sum(r[3] == x for r in last.values()) for x in quality.ROUTES)
    assert got.mean_confidence == round(float(sum(r[4] for r in ocr)) / len(ocr), 6)
    assert got.wins == f"primary:{sum(r[5] for r in ocr)},secondary:{sum(r[6] for r in ocr)}"


def test_files_come_once_within_the_delay(spark, tmp_path):
    schema = "path string, content_hash string, modificationTime timestamp"
    at = lambda m: START + timedelta(minutes=m)
    for name, rows in (("a", [("p", "1", at(0)), ("p", "1", at(5)), ("q", "1", at(6))]), ("b", [("p", "1", at(50)), ("p", "2", at(51))]), ("c", [("x", "0", at(2000))]), ("d", [("y", "0", at(2001))]), ("e", [("p", "1", at(2002))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runs.drained(files.once(s, "1 hour"), str(tmp_path / "out")).collect()
    assert sorted((r.path, r.content_hash, r.modificationTime) for r in got) == [("p", "1", at(0)), ("p", "1", at(2002)), ("p", "2", at(51)), ("q", "1", at(6)), ("x", "0", at(2000)), ("y", "0", at(2001))]


def test_the_earliest_of_a_batch_stays_in_any_order(spark, tmp_path):
    schema = "path string, content_hash string, modificationTime timestamp"
    at = lambda m: START + timedelta(minutes=m)
    rows = [(f"p{i}", h, at(i + m)) for m in (10, 0, 20) for i in range(40) for h in ("1", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = runs.drained(files.once(s, "1 hour"), str(tmp_path / "out")).collect()
    assert sorted((r.path, r.content_hash or "", r.modificationTime) for r in got) == sorted((f"p{i}", h, at(i)) for i in range(40) for h in ("", "1"))


def test_tree_changes(spark):
    old = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("e", None), ("f", None), ("g", "5"), ("g", "5"), ("h", "7")] + [(f"empty/{i:02}", "0") for i in range(30)]
    new = [("a", "1"), ("b", "2b"), ("z1", "3"), ("z0", "3"), ("z2", "3"), ("e", "4"), ("f", None), ("y", None), ("h", None)] + [(f"now/{i:02}", "0") for i in range(29)]
    listing = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    got = {(r.change, r.path, r.from_path) for r in files.changes(listing(old), listing(new)).collect()}
    moved = {("moved", "z0", "c"), ("moved", "z1", "d")} | {("moved", f"now/{i:02}", f"empty/{i:02}") for i in range(29)}
    assert got == moved | {("modified", "b", None), ("modified", "e", None), ("modified", "h", None), ("created", "z2", None), ("created", "y", None), ("deleted", "g", None), ("deleted", "empty/29", None)}
    assert files.changes(listing([]), listing([])).count() == 0


def test_numbers_within_groups_of_any_size(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i) for i in range(2000)]
    got = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"], "k").collect()
    want = collections.defaultdict(list)
    for g, v in sorted(rows, key=lambda r: r[1]):
        want[g].append(v)
    assert {(r.g, r.v, r.k) for r in got} == {(g, v, k) for g, vs in want.items() for k, v in enumerate(vs)} and len(got) == 2000
    whole = numbered(spark.createDataFrame(rows, "g string, v int"), [], ["v"], "k").collect()
    assert all(r.v == r.k for r in whole)


def test_a_stream_stops_when_told(spark, tmp_path):
    rate = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path)).start()
    assert runs.run_until(rate, lambda: True, 0.1) is True and not rate.isActive


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Far)
