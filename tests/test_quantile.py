"""The quantile line against all lines through two points, and on many rows."""

import itertools

import numpy as np
import pytest

from motifloom.operators import calibrate


def loss(x, y, n, a, b, tau):
    r = y - a - b * x
    return float((n * np.where(r > 0, tau * r, (tau - 1) * r)).sum())


@pytest.mark.parametrize("tau", [0.05, 0.31, 0.5])
def test_least_loss(tau):
    rng = np.random.default_rng(int(tau * 100))
    for k in range(60):
        m = int(rng.integers(1, 20))
        x, y, n = rng.integers(-9, [5, 40, 1000][k % 3], m), rng.integers(-20, 60, m), rng.integers(1, 5, m)
        if k % 5 == 0:
            x, y = x / 7, y + rng.random(m)
        got = loss(x, y, n, *calibrate.quantile_regression(x, y, tau, n), tau)
        lines = [(v, 0.0) for v in y]
        for i, j in itertools.permutations(range(m), 2):
            if x[i] != x[j]:
                b = (y[j] - y[i]) / (x[j] - x[i])
                lines.append((y[i] - b * x[i], b))
        assert got <= min(loss(x, y, n, a, b, tau) for a, b in lines) + 1e-6 * (1 + abs(got))


def test_tied_points_are_on_the_line():
    x = np.array([90] * 238 + [80, 70, 100] * 20)
    y = 45 + 5 * x
    y[250:] += 30
    a, b = calibrate.quantile_regression(x, y)
    assert (a, b) == (45.0, 5.0) and not (y < a + b * x).any()


def test_large_values_and_counts():
    x, y = np.array([0, 1, 2, 10**9]), np.array([0, 3, 6, 3 * 10**9])
    assert calibrate.quantile_regression(x, y, 0.5, np.array([5, 1, 7, 10**9])) == (0.0, 3.0)


def test_counts_come_from_all_rows(spark):
    df = spark.range(200_000).selectExpr("id % 50 AS s", "2 * (id % 50) + 7 + id % 3 AS h")
    assert calibrate.quantile_line(df, "s", "h") == (7.0, 2.0)
    with pytest.raises(ValueError):
        calibrate.quantile_line(df.where("false"), "s", "h")
