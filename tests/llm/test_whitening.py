"""Whitened vectors against numpy over the whole table."""

import math

import numpy as np
import pytest

from cadenza.llm import plans, whitening


def plain(vectors, components=8):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, total = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, total))) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, total)] for row in x], float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = (centred ** 2).sum() / n
    return deviation, centred @ axes / np.sqrt(values), values / trace


@pytest.mark.parametrize("scale, block", [("sf0.001", 16), ("sf0.01", 1024)])
def test_query_equals_numpy(spark, scale, block, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", block)
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    folder = f"/root/testdata/{scale}"
    given = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = plain([r.embedding for r in given])
    out = plans.QUERIES["op13_whitening"](spark, folder).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in out] == [(g.vec_id, k) for g in given for k in range(1, 9)]
    assert {r.n for r in out} == {len(given)}
    assert [r.deviation for r in out[::8]] == deviation
    got = np.array([r.whitened for r in out]).reshape(-1, 8)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-7
    assert np.allclose([r.explained for r in out[:8]], explained, rtol=1e-9)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-9


def test_bad_vectors_repeats_widths_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1, 0.2], [0.4, -0.3], [-0.5, 0.25], [0.4, -0.3]]
    df = spark.createDataFrame(
        [(i % 3, v, 1, "r") for i, v in enumerate(good)]
        + [(7, None, 1, "r"), (8, [nan, 0.0], 1, "r"), (9, [inf, 0.0], 1, "r"), (10, [0.0, None], 1, "r"), (11, [-inf, 1.0], 1, "r"), (None, [0.75], 1, "r")],
        "vec_id long, embedding array<double>, row int, entries string")
    out = whitening.whiten(df).collect()
    assert {r.component for r in out} == {1, 2} and {r.n for r in out} == {5}
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in out) == sorted(
        (k is None, k or 0) for k in [0, 1, 2, 0, None] for _ in range(2))
    assert out[0].identity_error < 1e-9
    deviation, _, _ = plain([*good, [0.75, 0.0]], 2)
    assert sorted(r.deviation for r in out if r.component == 1) == sorted(deviation)


def test_tables_without_variance_give_no_rows(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, None)], [(1, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, kind))
        assert out.count() == 0 and out.columns == [c.split()[0] for c in whitening.WHITENED.split(", ")]
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert None in {r.deviation for r in whitening.whiten(huge).collect()}
