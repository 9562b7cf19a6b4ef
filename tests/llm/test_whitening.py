"""Whitening against exact fractions and plain numpy, over odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component string, id int, v int"


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "c", 2, 3) for i, v in vectors], schema).repartition(3)


def plain(vectors, d):
    kept = [(i, v) for i, v in vectors if v is not None and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 1e13 for c in v)]
    x = [[math.floor(Fraction(64) * Fraction(float(c))) + 1_000_000 for c in v] for _, v in kept]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums)] for row in x])
    return [i for i, _ in kept], [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x], centred


@pytest.mark.parametrize("d", [5, 40])
def test_whitening(spark, d):
    rng = np.random.Generator(np.random.PCG64(d))
    mix = rng.normal(size=(d, d))
    vectors = [(i, np.float32(rng.normal(size=d) @ mix + 3).tolist()) for i in range(300)]
    vectors += [(None, vectors[0][1]), (3, vectors[4][1]), (900, None), (901, []), (902, [None] + vectors[1][1][1:]), (903, [math.nan] + vectors[1][1][1:]), (904, [math.inf] + vectors[1][1][1:]), (905, vectors[1][1][1:]), (906, [1e30] + vectors[1][1][1:])]
    out = W.whiten(table(spark, vectors))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    ids, deviations, centred = plain(vectors, d)
    k = min(d, 32)
    assert sorted((r.vec_id for r in got), key=repr) == sorted((i for i in ids for _ in range(k)), key=repr)
    assert {r.n for r in got} == {len(ids)} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {(r.vec_id, r.component): r for r in got if r.vec_id not in (3, None)}
    e, axes = np.linalg.eigh(centred.T @ centred / len(ids))
    e, axes = e[::-1], axes[:, ::-1]
    want = centred @ axes / np.sqrt(e)
    for c in range(k):
        column = np.array([by[i, c + 1].whitened for i in ids if i not in (3, None)])
        plain_column = np.array([w for i, w in zip(ids, want[:, c]) if i not in (3, None)])
        sign = np.sign(column @ plain_column)
        assert np.abs(column * sign - plain_column).max() < 1e-7
        assert all(abs(by[i, c + 1].explained / (e[c] / e.sum()) - 1) < 1e-9 for i in ids[:3])
    assert [by[i, 1].deviation for i in ids if i not in (3, None)] == [v for i, v in zip(ids, deviations) if i not in (3, None)]


def test_no_variance_and_large_entries(spark):
    """A dimension without variance has no component; sums and deviations are exact at any size."""
    vectors = [(i, [float(i % 2), 7.0, 1e12 * (i % 3)]) for i in range(30)]
    got = W.whiten(table(spark, vectors, SCHEMA.replace("array<float>", "array<double>"))).collect()
    _, deviations, _ = plain(vectors, 3)
    last = [r for r in got if r.component == 3]
    assert len(got) == 90 and all(r.whitened is None and r.explained == 0 for r in last)
    assert {r.vec_id: r.deviation for r in last} == {i: v if v < 2**63 else None for i, v in zip(range(30), deviations)}
    same = W.whiten(table(spark, [(1, [1.0, 2.0])] * 4)).collect()
    assert len(same) == 8 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in same)


def test_partial_sums_do_not_depend_on_the_deal(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    vectors = [(i, np.float32(rng.normal(size=8)).tolist()) for i in range(200)]
    one, many = (W.whiten(table(spark, vectors).repartition(n)).collect() for n in (1, 9))
    of = lambda rows: {(r.vec_id, r.component): (r.n, r.deviation, round(abs(r.whitened), 8), round(r.explained, 9)) for r in rows}
    assert of(one) == of(many)


def test_empty_table(spark):
    assert W.whiten(table(spark, [(1, None)]).limit(0)).count() == 0
    assert W.whiten(table(spark, [(1, None)])).count() == 0
