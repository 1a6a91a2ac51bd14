import math

import numpy as np
import pytest

from intake.llm import whitening as W
from intake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def counted(rows):
    """vec_id and x of the vectors that count, in whole numbers of any size."""
    return [(i, [math.floor(1024 * float(c)) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def test_query_equals_definition(spark):
    got = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    rows = counted([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    n, x = len(rows), np.array([v for _, v in rows], dtype=np.int64)
    sums = x.sum(axis=0)
    y = x - sums / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = y @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(rows)}
    dev = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums.tolist())) for i, v in rows}
    mine = np.zeros_like(want)
    for r in got:
        assert r.deviation == dev[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        mine[place[r.vec_id], r.component - 1] = r.whitened
    for c in range(8):
        sign = np.sign(mine[0, c] * want[0, c])
        assert np.allclose(sign * mine[:, c], want[:, c], atol=1e-8)
    measured = np.abs(np.cov(mine.T, bias=True) - np.eye(8)).max()
    error = {r.identity_error for r in got}
    assert len(error) == 1 and abs(error.pop() - measured) < 1e-10 and measured < 1e-9


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [7, 7, 7, 1, 1, 0], [1e8, 1, 1e-3, 1e-9], [2, 2, 2], [3, 3 - 1e-9, 1], [0, 0, 0], [6]])
def test_eigen_splits_to_single_directions(values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, v = W.eigen(a)
    assert np.allclose(found, sorted(values, reverse=True), atol=1e-13 * max(1, max(values)))
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.linalg.norm(a @ v - v * found) <= 1e-13 * max(1, max(values)) * len(values)


def test_polar_factor_is_the_sign():
    a = np.random.default_rng(1).standard_normal((40, 40))
    a = a + a.T
    values, v = np.linalg.eigh(a)
    assert np.allclose(W.polar(a), v @ np.diag(np.sign(values)) @ v.T, atol=1e-10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, (-1.0) ** i, 0.5]) for i in range(6)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [nan, 0.0, 0.0]), (24, [inf, 0.0, 0.0]), (25, [1.0, 2.0]), (26, [-inf, 1.0, 1.0])]
    rows = good + good[:1] + [(None, [0.3, 0.3, 0.3])] + odd
    df = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n string, component int, whitened double")
    got = W.whiten(df).collect()
    assert {r.n for r in got} == {8} and sorted({r.vec_id for r in got}, key=str) == [0, 1, 2, 3, 4, 5, None]
    assert len(got) == 8 * 3 and sum(r.vec_id == 0 for r in got) == 6
    assert max(abs(r.identity_error) for r in got) < 1e-9 and sum(r.explained for r in got) == pytest.approx(8)
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert W.whiten(flat).collect() == [] and W.whiten(flat.where("vec_id < 0")).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.component for r in W.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(i, [1e38 * (-1) ** i, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r.deviation for r in W.whiten(huge).collect()} == {None}


def test_partitions_change_nothing(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, two = ({(r.vec_id, r.component): (r.deviation, abs(r.whitened)) for r in W.whiten(d).collect()} for d in (df.coalesce(1), df.repartition(7)))
    assert one.keys() == two.keys()
    assert all(one[k][0] == two[k][0] and abs(one[k][1] - two[k][1]) < 1e-8 for k in one)
