"""Whitening against plain whole-number arithmetic and numpy, and its edge cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemline.llm.whitening import covariances, pair_squares, whiten, whole_numbers

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def integers(vectors):
    return [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]


def exact_covariance(x):
    n, size = len(x), len(x[0])
    means = [Fraction(sum(r[i] for r in x), n) for i in range(size)]
    return np.array(
        [[float(sum((r[i] - means[i]) * (r[j] - means[j]) for r in x) / n) for j in range(size)] for i in range(size)]
    )


def test_covariances_are_those_of_plain_fractions():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, (50, 5)) + 10**12
    sums = x.sum(axis=0).tolist()
    middle = [s // 50 for s in sums]
    got = covariances(50, middle, sums, pair_squares(x, middle).tolist())
    assert (got == exact_covariance(x.tolist())).all()
    huge = x.astype(object) * 10**20
    sums = [sum(c) for c in huge.T.tolist()]
    middle = [s // 50 for s in sums]
    got = covariances(50, middle, sums, pair_squares(huge, middle).tolist())
    assert (got == exact_covariance(huge.tolist())).all()


def test_floors():
    c = np.array([0.5, -0.5, 1 / 3, -1 / 3, 0.0, -1e-9])
    assert whole_numbers(c).tolist() == [100_512, 99_488, 100_341, 99_658, 100_000, 99_999]
    assert whole_numbers(np.array([2.0**100]))[0] == 2**110 + 100_000


def test_rows_against_numpy(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32).tolist()
    got = whiten(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    x = integers(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    values, axes = np.linalg.eigh(exact_covariance(x))
    values, axes = values[::-1], axes[:, ::-1]
    want = (np.array(x) - np.array(sums) / n) @ axes[:, :8] / np.sqrt(values[:8])
    have = got["whitened"].to_numpy().reshape(n, 8)
    sign = np.sign((want * have).sum(axis=0))
    assert np.abs(want * sign - have).max() < 1e-9
    assert got["component"].tolist() == list(range(1, 9)) * n
    assert got["explained"].to_numpy()[:8] == pytest.approx(values[:8] / values.sum(), rel=1e-9)
    assert set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert [int(d) for d in got["deviation"]] == [d for d in deviations for _ in range(8)]
    assert np.abs(np.cov(have.T, bias=True) - np.eye(8)).max() < 1e-9


def test_a_small_spread_around_a_large_mean(spark):
    rng = np.random.default_rng(3)
    vectors = (1000 + rng.normal(size=(200, 3)) * [3.0, 0.1, 0.02]).astype(np.float32).tolist()
    got = whiten(frame(spark, vectors), components=3).toPandas().sort_values(["vec_id", "component"])
    assert got["identity_error"].max() < 1e-8
    values = np.linalg.eigvalsh(exact_covariance(integers(vectors)))[::-1]
    assert got["explained"].to_numpy()[:3] == pytest.approx(values / values.sum(), rel=1e-6)


def test_unusable_vectors_take_no_part(spark, rows):
    good = [[1, 2], [3, 1], [0, 5], [2, 2]]
    odd = [None, [None, 1], [float("nan"), 1], [float("inf"), 0], [-float("inf"), 0], [], [1, 2, 3]]
    ids = [0, 1, None, 1, 4, 5, 6, 7, 8, 9, 10]
    got = whiten(frame(spark, good + odd, ids))
    assert got.select("vec_id").distinct().count() == 3  # 0, a null and 1, which two rows share
    assert got.count() == 4 * 2
    plain = whiten(frame(spark, good))
    near = F.round("whitened", 9).alias("w")
    assert rows(got, "component", "deviation", near) == rows(plain, "component", "deviation", near)


def test_no_variance_and_no_rows(spark):
    same = whiten(frame(spark, [[1, 2], [1, 2], [1, 2]])).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in same} == {(None, None, None, 0)}
    line = whiten(frame(spark, [[0, 0], [1, 1], [2, 2]])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True}
    assert whiten(frame(spark, [None, [None]])).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).columns == whiten(frame(spark, [[1, 2]])).columns


def test_very_large_components(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [3e30, 3.0]]
    got = whiten(frame(spark, vectors), components=1).collect()
    assert all(r["whitened"] is not None and r["deviation"] is None for r in got)
    assert got[0]["identity_error"] < 1e-6


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, 2.0), (1, [1.0, 0.0], 6, 2.0), (2, [0.0, 3.0], 7, 1.0)], "vec_id bigint, embedding array<double>, n int, vector double")
    got = whiten(df, components=1).collect()
    assert len(got) == 3 and {r["n"] for r in got} == {3}
