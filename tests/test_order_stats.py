"""Exact order statistics against numpy, also where buckets must be refined."""

import numpy as np
import pandas as pd
import pytest

from armlift.operators import order_stats
from armlift.operators.models import MAD_SCALE, huber_shift
from armlift.operators.multiplicity import _adjust_large, _adjust_small


def table(spark, groups):
    parts = [pd.DataFrame({"g": g, "v": np.asarray(v, float)}) for g, v in groups.items()]
    return spark.createDataFrame(pd.concat(parts)).repartition(8)


@pytest.mark.parametrize("bracket", [500_000, 40])
def test_percentiles_match_numpy(spark, monkeypatch, bracket):
    monkeypatch.setattr(order_stats, "SMALL_BRACKET", bracket)
    rng = np.random.default_rng(3)
    groups = {
        "clumped": 1e9 + rng.uniform(0, 1e-3, 3000),   # one bucket at first
        "signed": rng.normal(0, 1, 2000),
        "hot": np.r_[np.full(4000, 7.0), rng.lognormal(0, 3, 500)],
        "one": [4.5],
        "two": [1.0, 2.0],
    }
    probs = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    got = order_stats.percentiles(table(spark, groups), ["g"], "v", probs).collect()
    assert len(got) == len(groups)
    for row in got:
        assert row.n == len(groups[row.g])
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.percentile(groups[row.g], 100 * p), rel=1e-12, abs=1e-12)


def test_whole_table_and_ranks(spark):
    v = np.arange(101, dtype=float) - 50
    got = order_stats.order_statistics(
        table(spark, {"a": v}).drop("g"), [], "v", {"first": lambda n: n - n + 1, "last": lambda n: n}).first()
    assert (got.n, got.first, got.last) == (101, -50, 50)


@pytest.mark.parametrize("bracket", [500_000, 40])
def test_rows_meet_one_open_range_and_sums_come_from_ranges(spark, monkeypatch, bracket):
    from armlift.operators.robustness import robust_sums

    monkeypatch.setattr(order_stats, "SMALL_BRACKET", bracket)
    rng = np.random.default_rng(8)
    arms = {
        ("a", "t"): rng.lognormal(0, 2, 3000), ("a", "c"): 1e9 + rng.uniform(0, 1e-3, 2000),
        ("b", "t"): np.r_[np.zeros(500), np.ones(500)], ("b", "c"): rng.integers(-3, 9, 800).astype(float), ("c", "t"): [2.5]}
    rows = spark.createDataFrame(pd.concat(
        pd.DataFrame({"segment": s, "arm": g, "y": v}) for (s, g), v in arms.items())).repartition(7)
    joined, inside = [], order_stats.inside

    def counted(data, todo, path, size):
        out = inside(data, todo, path, size)
        joined.append((out.count(), todo.agg({"_cnt": "sum"}).first()[0], data.count()))
        return out

    monkeypatch.setattr(order_stats, "inside", counted)
    got = {(r.segment, r.arm): r for r in robust_sums(rows).collect()}
    assert got.keys() == arms.keys() and joined
    assert all(met == held <= read for met, held, read in joined)  # exactly the rows of the open ranges, once each
    for key, v in arms.items():
        v, row = np.sort(v), got[key]
        w, t = int(len(v) * 0.05), int(len(v) * 0.1)
        z = np.abs(v - np.median(v))
        assert (row.k, row.median) == (len(v), pytest.approx(np.median(v), rel=1e-12))
        assert row.winsor_mean == pytest.approx(np.clip(v, v[w], v[len(v) - w - 1]).mean(), rel=1e-12)
        assert row.trim_mean == pytest.approx(v[t:len(v) - t].mean(), rel=1e-9)
        assert row.zm == pytest.approx(z.mean(), rel=1e-3 if key == ("a", "c") else 1e-9)
        assert row.zv is None if len(v) == 1 else row.zv == pytest.approx(z.var(ddof=1), rel=1e-2 if key == ("a", "c") else 1e-9)
    assert got["b", "t"].zv == 0


@pytest.mark.parametrize("size", [10_000, 7])
def test_ranks_are_a_permutation(spark, monkeypatch, size):
    monkeypatch.setattr(order_stats, "PIECE_VALUES", size)
    monkeypatch.setattr(order_stats, "CHUNK", size)
    rng = np.random.default_rng(4)
    groups = {"a": np.r_[rng.normal(0, 5, 300), np.full(50, 2.0)], "b": 1e6 + rng.uniform(0, 1e-3, 200)}
    df = order_stats.ranked_rows(table(spark, groups), ["g"], "v").toPandas()
    for g, v in groups.items():
        mine = df[df["g"] == g].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(v) + 1))
        assert list(mine["v"]) == sorted(v)


def numpy_huber(t, c):
    y, x = np.r_[t, c], np.r_[np.ones(len(t)), np.zeros(len(c))]
    X = np.c_[np.ones_like(x), x]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    scale = np.median(np.abs(y - X @ beta)) / MAD_SCALE
    for _ in range(2000):
        r = y - X @ beta
        w = np.minimum(1, 1.345 * scale / np.maximum(np.abs(r), 1e-300))
        beta = np.linalg.solve((X.T * w) @ X, X.T @ (w * y))
        scale = np.median(np.abs(y - X @ beta)) / MAD_SCALE
    r = (y - X @ beta) / scale
    inner = np.abs(r) <= 1.345
    m, n = inner.mean(), len(y)
    k = 1 + 2 / n * (m * (1 - m)) / m**2
    var = k**2 * np.sum(np.clip(r, -1.345, 1.345) ** 2) / (n - 2) * scale**2 / m**2 * np.linalg.inv(X.T @ X)[1, 1]
    return beta[1], np.sqrt(var)


def test_huber_shift_matches_iterated_fit(spark):
    rng = np.random.default_rng(5)
    frames, want = [], {}
    for seg, shift in (("a", 0.4), ("b", -2.0)):
        t, c = rng.standard_t(2, 700) * 3 + 20 + shift, rng.standard_t(2, 500) * 3 + 20
        want[seg] = numpy_huber(t, c)
        frames += [pd.DataFrame({"segment": seg, "arm": "t", "y": t}), pd.DataFrame({"segment": seg, "arm": "c", "y": c})]
    got = huber_shift(spark.createDataFrame(pd.concat(frames)).repartition(6)).collect()
    for row in got:
        assert row.fit_effect == pytest.approx(want[row.segment][0], rel=1e-6, abs=1e-7)
        assert row.fit_se == pytest.approx(want[row.segment][1], rel=1e-6)


def bh(p):
    p = np.asarray(p)
    order = np.argsort(p)
    adj = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate(adj[::-1])[::-1])
    return out


@pytest.mark.parametrize("adjust", [_adjust_small, _adjust_large])
def test_bh_paths_agree_with_definition(spark, adjust):
    rng = np.random.default_rng(6)
    p = np.r_[rng.uniform(0, 1, 200) ** 3, np.zeros(5), np.ones(70), np.full(10, 0.03)]
    df = spark.createDataFrame(pd.DataFrame({"segment": [f"s{i}" for i in range(len(p))], "p": p, "e": 1}))
    got = adjust(df, "p", "q", ["e"]).toPandas()
    want = dict(zip([f"s{i}" for i in range(len(p))], bh(p)))
    assert len(got) == len(p)
    for s, q in zip(got["segment"], got["q"]):
        assert q == pytest.approx(want[s], rel=1e-12, abs=1e-15)


def test_joins_back_spread_equal_rows_and_bound_bytes(spark, monkeypatch):
    from armlift import session

    rows = spark.range(20_000).selectExpr("IF(id % 20 = 0, 'rare', 'hot') AS k", "IF(id % 20 = 0, id, 0) AS v")
    assert session.salted(rows.where("k = 'hot'")).select("_salt").distinct().count() > session.SALTS // 2
    side = session.stage(spark.createDataFrame([("rare", 1), ("hot", 2)], "k string, w int"))
    want = sorted(session.attach(rows, side, ["k"]).groupBy("k", "w").count().collect())
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    assert sorted(session.attach(rows, side, ["k"]).groupBy("k", "w").count().collect()) == want
    monkeypatch.undo()
    wide = session.stage(spark.createDataFrame([("a", [0.1] * 1000)] * 20, "k string, m array<double>"))
    assert session.fits_broadcast(wide)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 50_000)
    assert not session.fits_broadcast(wide)


def test_huber_shift_settles_or_says_so(spark):
    from armlift.config import Options, Roles
    from armlift.plans.analysis import analyze

    rng = np.random.default_rng(14)
    n = 2000
    shapes = {
        "bimodal": np.where(rng.random(n) < 0.5, -10, 10) + rng.normal(size=n), "constant": np.where(rng.random(n) < 0.8, 4.0, 4 + rng.exponential(9, n)),
        "gap": np.where(rng.random(n) < 0.51, 0.0, 100.0) + rng.normal(0, 1e-6, n), "plain": rng.exponential(2, n)}
    df = pd.concat([pd.DataFrame({"segment": k, "arm": np.where(np.arange(n) % 2, "t", "c"), "y": v}) for k, v in shapes.items()])
    got = {r.segment: r for r in huber_shift(spark.createDataFrame(df)).collect()}
    assert got.keys() == shapes.keys() and got["plain"].fit_converged
    for name, row in got.items():
        assert row.fit_converged == (row.fit_effect is not None) == (row.fit_se is not None), name
    assert got["constant"].fit_scale == 0 and not got["constant"].fit_converged
    out = analyze(spark.createDataFrame(df), Roles("arm", "y", "t", "c", segment="segment"), Options(metric_type="heavy_tail", diagnostics=False))
    for r in out.results.collect():
        fitted = got[r.segment].fit_converged
        assert r.model_type == ("rlm_huber" if fitted else "ols_hc3_fallback")
        assert ("model_fit_failed_fallback_to_ols" in r.inference_reasons) == (not fitted)
