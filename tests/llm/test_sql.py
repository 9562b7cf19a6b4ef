"""Queries of the operators against their SQL on the smallest tables, and windows and terms against plain versions."""

import collections
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quire.llm import blocks as B
from quire.llm import substrings, toxicity
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_windows_of_equal_hash_are_told_apart_by_their_marks():
    """Hashes and marks of few values: repeated windows are those whose pair of both occurs twice."""
    rng = np.random.Generator(np.random.PCG64(31))
    chunks = [(rng.integers(0, 4, n).astype(np.uint64) << np.uint64(60), rng.integers(0, 5, n).astype(np.uint32)) for n in (0, 1, 9, 6, 1)]
    asked = pa.concat_tables([substrings.ask_windows(c, h, m, 2) for c, (h, m) in enumerate(chunks)])
    assert sum(len(k.as_buffer()) // 8 for k in asked.column("keys")) == sum(len(set(zip(h.tolist(), m.tolist(), strict=True))) for h, m in chunks)
    buckets = [asked.filter(pa.compute.equal(asked.column("bucket"), b)) for b in set(asked.column("bucket").to_pylist())]
    answers = pa.concat_tables([substrings.repeated(t) for t in buckets])
    count = collections.Counter(p for h, m in chunks for p in zip(h.tolist(), m.tolist(), strict=True))
    assert 1 in count.values() and max(count.values()) > 1
    for c, (h, m) in enumerate(chunks):
        own = answers.filter(pa.compute.equal(answers.column("chunk"), c))
        got = substrings.among(h, m, *substrings.windows_of(own)).tolist() if own.num_rows else [False] * len(h)
        assert got == [count[p] > 1 for p in zip(h.tolist(), m.tolist(), strict=True)]


def test_marks_follow_the_words():
    text = " ".join(f"w{i % 50}" for i in range(200))
    at, h, mark = substrings.marked_windows(B.Block(*B.buffers(pa.array([text, text]))))
    assert len(at) == 2 * 166 and len(set(zip(h.tolist(), mark.tolist(), strict=True))) == 50
    assert len(set(h.tolist())) == 50 and len(set(mark.tolist())) == 50


def test_chosen_terms_are_those_that_stand_out(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    rows = []
    for i in range(600):
        grade = int(i % 3 == 0) * (1 + i % 2)
        own = [f"{'abcdefghij'[k]}term" for k in rng.integers(0, 10, 12)] + ["Mean!"] * (grade * int(rng.integers(1, 3))) + ["kind"] * (grade == 0) + [f"rare{chr(97 + i % 26)}"] * (i < 40)
        rows.append((grade, " ".join(own)))
    sample = spark.createDataFrame([*rows, (0, "")], "grade int, text string").repartition(3)
    share = sum(g > 0 for g, _ in rows) / len(rows)
    every, toxic = collections.Counter(), collections.Counter()
    for grade, text in rows:
        for w in re.findall("[a-z]+", text.lower()):
            d = np.frombuffer(w.encode(), np.uint8)
            term = int(B.span_hashes(d, np.array([0]), np.array([len(d)]))[0] >> np.uint64(64 - toxicity.BITS))
            every[term] += 1
            toxic[term] += grade > 0
    z = {t: (toxic[t] - n * share) / (n * share * (1 - share)) ** 0.5 for t, n in every.items()}
    strong = sorted((t for t, n in every.items() if n >= 4 and abs(z[t]) > 4 and (z[t] < 0 or toxic[t] >= 3)), key=lambda t: (-abs(z[t]), t))
    assert len(strong) >= 2
    assert toxicity.chosen_terms(sample, share, 100).tolist() == sorted(strong)
    assert toxicity.chosen_terms(sample, share, 1).tolist() == strong[:1]
