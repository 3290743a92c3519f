"""Distribution functions against printed tables and the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from armlift.functions import normal, tails


def test_normal_expressions(spark):
    zs = [-9.0, -3.0, -1.96, -0.1, 0.0, 0.5, 1.0, 2.5758, 7.5]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = df.select("z", F.expr(normal.cdf("z")), F.expr(normal.two_sided("z")), F.expr(normal.pdf("z"))).collect()
    for z, p, two, dens in got:
        assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-12)
        assert two == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)
        assert dens == pytest.approx(NormalDist().pdf(z), rel=1e-12)


def test_normal_quantile(spark):
    ps = [1e-9, 1e-4, 0.03, 0.07, 0.3, 0.5, 0.8, 0.975, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, q in df.select("p", F.expr(normal.quantile("p"))).collect():
        assert q == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)


@pytest.mark.parametrize("df,q", [(1, 12.7062), (2, 4.30265), (5, 2.57058), (10, 2.22814), (30, 2.04227), (120, 1.97993)])
def test_t_table(df, q):
    assert tails.t_quantile(0.975, np.array([df]))[0] == pytest.approx(q, abs=1e-4)
    assert tails.t_two_sided(np.array([q]), np.array([df]))[0] == pytest.approx(0.05, abs=1e-5)


def test_t_series_meets_newton():
    below, above = tails.t_quantile(0.975, np.array([199.999999, 200.000001]))
    assert below == pytest.approx(above, abs=1e-9)


@pytest.mark.parametrize("d,n", [(0.2, 393.41), (0.5, 63.77), (0.8, 25.52)])
def test_two_sample_size_table(d, n):
    assert tails.solve_n(np.array([d]), 1.0, 0.05, 0.8)[0] == pytest.approx(n, abs=0.01)
    assert tails.two_sample_power(np.array([d]), np.array([n]), np.array([n]), 0.05)[0] == pytest.approx(0.8, abs=1e-3)
    assert tails.solve_effect(np.array([n]), np.array([n]), 0.05, 0.8)[0] == pytest.approx(d, abs=1e-4)


def test_power_against_simulation():
    rng = np.random.default_rng(1)
    n, d = 12, 0.9
    a, b = rng.normal(d, 1, (40_000, n)), rng.normal(0, 1, (40_000, n))
    t = (a.mean(1) - b.mean(1)) / np.sqrt((a.var(1, ddof=1) + b.var(1, ddof=1)) / n)
    share = np.mean(np.abs(t) > tails.t_quantile(0.975, np.array([2 * n - 2.0]))[0])
    assert tails.two_sample_power(np.array([d]), np.array([n]), np.array([n]), 0.05)[0] == pytest.approx(share, abs=0.01)


def test_power_columns_special_cases(spark):
    df = spark.createDataFrame([(0.0, 50, 50), (0.5, 1, 50), (0.5, 64, 64)], "d double, a int, b int")
    rows = df.select(tails.power_of(F.col("d"), F.col("a"), F.col("b"), 0.05).alias("p"),
                     tails.required_n_of(F.col("d"), F.lit(1.0), 0.05, 0.8).alias("n"),
                     tails.detectable_effect_of(F.col("a"), F.col("b"), 0.05, 0.8).alias("e")).collect()
    assert [r.n for r in rows] == [10**9, 64, 64]
    assert rows[0].p == 0 and rows[1].p == 0 and rows[2].p == pytest.approx(0.8015, abs=1e-3)
    assert rows[1].e == 0


def test_t_tail_is_exact_at_every_df():
    """Against mpmath-free references: the exact sum at even df, and the series in 1/df around the normal tail."""
    import math

    from armlift.functions.tails import t_two_sided

    def even(t, v):  # closed form for even v: 1 - sin(theta) * sum of products, by its complement
        x = v / (v + t * t)
        term, total, k = 1.0, 0.0, 0
        # P = I_x(v/2, 1/2); continued sum of the beta series from the small side
        front = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi)
                         + v / 2 * math.log(x) + 0.5 * math.log1p(-x)) / (v / 2)
        while term > 1e-18 * max(total, 1e-300) and k < 2_000_000:
            total += term
            term *= ((v + 1) / 2 + k) / (v / 2 + 1 + k) * x
            k += 1
        return front * total

    for v in (1000, 2000, 5000):
        for t in (1.0, 3.0, 9.0, 20.0, 37.0):
            assert t_two_sided([t], [v])[0] == pytest.approx(even(t, v), rel=1e-9)
    for t in (0.5, 4.0, 9.0, 20.0, 37.0):
        normal = math.erfc(t / math.sqrt(2))
        assert t_two_sided([t], [1e12])[0] == pytest.approx(normal, rel=1e-6)
        below, above = t_two_sided([t, t], [999.999, 1000.001])
        assert below == pytest.approx(above, rel=1e-5 * max(1, t**4 / 100))
        tails = t_two_sided([t] * 5, [1e5, 9e5, 1.1e6, 1e8, 1e12])
        assert (np.diff(tails) < 0).all() and (tails > 0).all()
