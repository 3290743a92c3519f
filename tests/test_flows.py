"""Roles, sources, rebalancing and whole analyses."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from armlift.config import Options, Roles
from armlift.operators import presentation, profile
from armlift.operators.arms import analysis_rows
from armlift.operators.balance import rebalance_control
from armlift.operators.moments import enough, segment_moments
from armlift.operators.summary import recommendations, summarize
from armlift.plans.analysis import analyze, auto_analyze, sample_size_table
from armlift.plans.roles import auto_configure, detect_columns, infer_labels, two_valued_columns
from armlift.sources import sinks
from armlift.sources.readers import read_experiment


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(21)
    n = 1200
    arm = np.where(np.arange(n) % 2 == 0, "treatment", "control")
    pre = rng.normal(50, 10, n)
    post = pre * 0.6 + rng.normal(20, 5, n) + np.where(arm == "treatment", 3.0, 0.0)
    df = pd.DataFrame({"customer_id": [f"u{i}" for i in range(n)], "experiment_group": arm,
                       "customer_segment": np.array(["Premium", "Standard", "Basic"])[np.arange(n) % 3],
                       "pre_effect": pre, "post_effect": post, "experiment_duration_days": 30})
    df.loc[n] = ["lone", "treatment", "Tiny", 1.0, 2.0, 30]
    return spark.createDataFrame(df)


def test_detection_and_labels(spark, sample):
    found = {}
    for r in detect_columns(sample).orderBy("role", "position").collect():
        found.setdefault(r.role, []).append(r.column)
    assert found["group"] == ["experiment_group"] and found["segment"] == ["customer_segment"]
    assert found["pre_effect"] == ["pre_effect"] and found["post_effect"] == ["post_effect"]
    auto = auto_configure(sample)
    assert auto.success and auto.roles.outcome == "post_effect" and auto.warnings == ()
    assert (auto.roles.treatment, auto.roles.control) == ("treatment", "control")

    def labels(*values):
        return infer_labels(spark.createDataFrame([(v,) for v in values], "value string")).first()

    assert (labels("ctrl", "test").treatment, labels("ctrl", "test").confidence) == ("test", "high")
    one = labels("ctrl", "blue")
    assert (one.treatment, one.control, one.confidence) == ("blue", "ctrl", "low")
    order = labels("variant_b", "variant_a")
    assert (order.control, order.treatment) == ("variant_a", "variant_b") and len(order.warnings) == 1
    assert labels("only").treatment is None
    guess = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("y", 3.0)], "side string, amount double")
    assert two_valued_columns(guess) == ["side"]
    assert auto_configure(guess).warnings[0].startswith("column 'side'")
    assert not auto_configure(guess.select("amount")).success


def test_full_analysis(spark, sample):
    out = auto_analyze(sample)
    rows = {r.segment: r for r in out.results.collect()}
    assert set(rows) == {"Premium", "Standard", "Basic"}
    for r in rows.values():
        assert r.is_significant and r.effect_size == pytest.approx(3.0, abs=1.5)
        assert r.covariate_adjustment_applied and r.covariates_used == ["pre_effect"]
        assert r.covariate_adjusted_effect == pytest.approx(3.0, abs=1.2)
        assert r.p_value_adjusted >= r.p_value and r.multiple_testing_method == "fdr_bh"
        assert r.normality_test == "shapiro" and r.diagnostics.experiment_quality.srm.srm_is_mismatch is False
    assert [r.segment for r in out.failures.collect()] == ["Tiny"]
    s = out.summary.first()
    assert s.total_segments_analyzed == 3 and s.failed_segments == 1 and "Tiny" in s.analysis_warnings[0]
    assert s.metric_type_breakdown == {"continuous": 3}
    rules = [r.rule for r in out.recommendations.collect()]
    assert "positive" in rules and "multiple_testing" in rules and "none" not in rules
    for key in presentation.chart_keys():
        assert presentation.chart_table(out.results, key).count() >= 3
    names = sinks.publish_tables(sample, out.results, out.summary, out.failures)
    assert len(names) == 4 and sinks.describe_tables(spark).select("table_name").distinct().count() == 4
    answer = sinks.query_results(spark, f"SELECT segment FROM {sinks.RESULTS} WHERE is_significant")
    assert answer.row_count == 3 and answer.source_tables == (sinks.RESULTS,)


def test_row_order_and_partitions_do_not_matter(spark, sample):
    roles = auto_configure(sample).roles
    o = Options(diagnostics=False, covariates=False, metric_type="continuous")
    cols = ["segment", "effect_size", "p_value", "bayesian_prob_treatment_better"]
    a = analyze(sample.coalesce(1), roles, o).results.select(*cols).toPandas().sort_values("segment", ignore_index=True)
    b = analyze(sample.orderBy("post_effect").repartition(7), roles, o).results.select(*cols).toPandas().sort_values(
        "segment", ignore_index=True)
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_cuped_sequential_and_overall(spark, sample):
    roles = auto_configure(sample).roles
    o = Options(scope="both", cuped=True, diagnostics=False, covariates=False, sequential={"look_index": 1, "max_looks": 2})
    rows = {r.segment: r for r in analyze(sample, roles, o).results.collect()}
    assert "Overall" in rows and all(r.cuped_applied and r.cuped_variance_reduction > 0.3 for r in rows.values())
    assert rows["Overall"].sequential_decision == "stop_efficacy" and rows["Overall"].is_significant
    assert sum(rows[s].treatment_size for s in ("Premium", "Standard", "Basic")) == rows["Overall"].treatment_size - 1


def test_rebalance(spark):
    rng = np.random.default_rng(23)  # arms that clearly differ before the experiment
    t, c = rng.normal(10, 2, 120), np.r_[rng.normal(10, 2, 150), rng.normal(12, 2, 60)]
    df = pd.DataFrame({"segment": "s", "grp": ["t"] * 120 + ["c"] * 210, "pre": np.r_[t, c], "y": np.r_[t, c] + 1})
    roles = Roles("grp", "y", "t", "c", segment="segment", pre_effect="pre")
    rows = analysis_rows(spark.createDataFrame(df), roles)
    kept, report = rebalance_control(rows, enough(segment_moments(rows)), iterations=24, target_p=0.9, alpha=0.2)
    r = report.first()
    assert r.original_control_size == 210 and r.balanced_control_size == 120
    assert r.aa_p_value >= r.p_before and 1 <= r.bootstrap_iterations <= 24
    after = kept.groupBy("arm").count().collect()
    assert {x.arm: x["count"] for x in after} == {"t": 120, "c": 120}
    # The reported p is that of the rows kept.
    from armlift.operators.inference import aa_test
    assert aa_test(segment_moments(kept)).first().aa_p_value == pytest.approx(r.aa_p_value, rel=1e-9)
    small = analysis_rows(spark.createDataFrame(df[:180]), roles)
    same, rep = rebalance_control(small, enough(segment_moments(small)), iterations=8, alpha=0.9999999)
    assert rep.first().balanced_control_size == 60 and same.count() == 180


def test_rebalance_matches_ranking_all_hashes(spark):
    import hashlib

    rng = np.random.default_rng(5)
    n_t, n_c = 700, 4000  # large enough for a window that holds a part of the rows only
    pre = np.r_[rng.normal(10, 2, n_t), rng.normal(10.3, 2.2, n_c)]
    df = pd.DataFrame({"segment": "s", "grp": ["t"] * n_t + ["c"] * n_c, "pre": pre, "y": pre + 1, "id": np.arange(n_t + n_c)})
    twin = df.assign(segment="r", pre=lambda x: x.pre * np.where(x.grp == "c", 1.2, 1))
    roles = Roles("grp", "y", "t", "c", segment="segment", pre_effect="pre", customer_id="id")
    rows = analysis_rows(spark.createDataFrame(pd.concat([df, twin])), roles, unit=True)
    kept, report = rebalance_control(rows, enough(segment_moments(rows)), iterations=20, target_p=0.95)
    got = {r.segment: r for r in report.collect()}

    def welch(a, b):
        va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
        return abs(a.mean() - b.mean()) / np.sqrt(va + vb)

    ids = df.id[n_t:].to_numpy()
    for name, frame in (("s", df), ("r", twin)):
        t, c = (frame.pre[frame.grp == g].to_numpy() for g in "tc")
        picks = []
        for b in range(20):
            u = np.array([int(hashlib.md5(f"{i}:{b}:42".encode()).hexdigest()[:13], 16) for i in ids])
            picks.append(np.sort(np.argsort(u)[:n_t]))
        best = int(np.argmin([welch(t, c[p]) for p in picks]))
        assert got[name].replicate == best and got[name].balanced_control_size == n_t
        left = sorted(int(r.unit) for r in kept.where(f"segment = '{name}' AND arm = 'c'").collect())
        assert left == ids[picks[best]].tolist()
    assert rebalance_control(rows, enough(segment_moments(rows)), iterations=0)[1].count() == 2


def test_profile_operators(spark):
    v = np.r_[np.arange(1, 100), 1000.0]
    df = spark.createDataFrame(pd.DataFrame({"v": v, "k": np.where(v % 3 == 0, "a", "b"), "g": "t"}))
    s = profile.column_stats(df, "v").first()
    assert (s["count"], s.p25, s.median, s.p75, s.missing) == (100, *np.percentile(v, [25, 50, 75]), 0)
    with pytest.raises(ValueError):
        profile.column_stats(df, "k")
    top = profile.column_values(df, "v", 5).collect()
    assert len(top) == 5 and top[0].omitted == 95
    p = {r.column: r for r in profile.profile(df, quartiles=True).collect()}
    assert p["v"].median == 50.5 and p["k"].mean is None and p["k"].row_count == 100


def test_quartiles_of_all_columns_match_numpy(spark, monkeypatch):
    from armlift.operators import order_stats

    rng = np.random.default_rng(31)
    n = 3000
    wide = pd.DataFrame({
        "clumped": 1e9 + rng.uniform(0, 1e-3, n), "signed": rng.normal(0, 1, n), "tiny": rng.choice([-5e-324, 0.0, 5e-324], n),
        "whole": rng.integers(-4, 5, n), "odd name.x": rng.lognormal(0, 6, n), "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.random(n))})
    df = spark.createDataFrame(wide).repartition(5).withColumn("none", F.lit(None).cast("double")).withColumn("t", F.lit("x"))
    for bracket in (500_000, 20):
        monkeypatch.setattr(order_stats, "SMALL_BRACKET", bracket)
        got = {r.column: r for r in profile.quartile_rows(df, [*wide.columns, "none"]).collect()}
        assert "none" not in got or got["none"].median is None
        for name in wide.columns:
            want = np.percentile(wide[name].dropna(), [25, 50, 75])
            assert [got[name].p25, got[name].median, got[name].p75] == pytest.approx(want, rel=1e-12, abs=1e-320), name
    assert profile.quartile_rows(df.limit(0), ["signed"]).count() == 0
    monkeypatch.undo()
    plan = profile.quartile_rows(df, ["signed", "gaps"])._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_sinks_and_guards(spark, sample, tmp_path):
    path = str(tmp_path / "x")
    sinks.write_results_partitioned(sample, path, "parquet", ["customer_segment"])
    back = read_experiment(spark, path, "parquet")
    assert back.where("customer_segment = 'Tiny'").count() == 1
    csv = str(tmp_path / "c")
    sample.write.option("header", True).csv(csv)
    assert dict(read_experiment(spark, csv).dtypes)["post_effect"] == "double"
    assert sinks.filter_rows(sample, "post_effect > 0", 7).count() == 7
    assert sinks.query(sample, "SELECT count(*) AS n FROM ab_test_data").first().n == 1201
    assert sinks.query(sample, "customer_segment = 'Tiny'").count() == 1
    for bad in ("", "  ", "true", "1 == 1", "post_effect > 0; DROP TABLE x"):
        with pytest.raises(ValueError):
            sinks.filter_rows(sample, bad)
    with pytest.raises(ValueError):
        sinks.filter_rows(sample, "post_effect > 0", 0)
    for bad in ("", "DELETE FROM raw_data", "SELECT 1; DROP TABLE raw_data", "SHOW TABLES"):
        with pytest.raises(ValueError):
            sinks.query_results(spark, bad)


def test_planning_rules(spark):
    df = spark.createDataFrame([("a", float(i % 2)) for i in range(100)], "seg string, y double")
    t = sample_size_table(df, "y", [0.1], "proportion", "seg").first()
    assert t.treatment_n == t.control_n and 380 < t.treatment_n < 400
    t2 = sample_size_table(df, "y", [0.25], segment="seg", ratio=2.0).first()
    assert t2.control_n == 2 * t2.treatment_n and t2.total_n == 3 * t2.treatment_n
    for bad in (dict(effects=[0.0]), dict(effects=[1.0], alpha=2.0), dict(effects=[1.0], metric_type="odd")):
        with pytest.raises(ValueError):
            sample_size_table(df, "y", **bad)


def test_empty_results(spark):
    df = spark.createDataFrame([("a", "t", 1.0), ("a", "c", 2.0)], "segment string, grp string, y double")
    out = analyze(df, Roles("grp", "y", "t", "c", segment="segment"), Options(diagnostics=False, metric_type="continuous"))
    assert out.results.count() == 0 and out.failures.count() == 1
    s = summarize(out.results, out.failures).first()
    assert s.error == "no segment was analysed" and s.analysis_warnings[0].startswith("1 segment(s)")
    assert recommendations(out.results).count() == 0


def test_validation(spark):
    with pytest.raises(ValueError, match="effect_value"):
        Roles.from_mapping({"group": "g"})
    df = spark.createDataFrame([("a", 1.0)], "grp string, y double")
    with pytest.raises(ValueError, match="labels"):
        analyze(df, Roles("grp", "y"))
    with pytest.raises(ValueError, match="not found"):
        analyze(df, Roles("grp", "z", "t", "c"))
    assert presentation.chart_keys("pvalue") == ["p_values"] and presentation.chart_keys("nothing") == []
    assert F.lit(1) is not None


def test_pooled_row_changes_no_total_and_no_adjusted_p(spark):
    rng = np.random.default_rng(8)
    rows = [(s, "t" if i % 2 else "c", float(rng.normal(10 + k * (i % 2) * 0.2, 2)))
            for k, s in enumerate(["a", "b", "Overall"]) for i in range(400)]
    df = spark.createDataFrame(rows, "segment string, grp string, y double")
    roles = Roles("grp", "y", "t", "c", segment="segment")
    options = dict(diagnostics=False, metric_type="continuous")
    apart, both = (analyze(df, roles, Options(scope=s, **options)) for s in ("segments", "both"))
    pooled = [r for r in both.results.collect() if r.is_overall]
    assert [r.treatment_size for r in pooled] == [600] and pooled[0].p_value_adjusted == pooled[0].p_value
    name = {"Overall": "Overall (segment)"}
    assert {name.get(r.segment, r.segment): (r.p_value_adjusted, r.treatment_size) for r in apart.results.collect()} == {
        r.segment: (r.p_value_adjusted, r.treatment_size) for r in both.results.collect() if not r.is_overall}
    assert apart.summary.first() == both.summary.first()
    assert apart.recommendations.collect() == both.recommendations.collect()
    assert presentation.waterfall(both.results).count() == 4


def test_pooled_moments_are_merged_from_those_of_segments(spark):
    from armlift.operators.arms import each_scope
    from armlift.operators.moments import segment_moments

    rng = np.random.default_rng(31)
    n = 3000
    df = pd.DataFrame({
        "segment": rng.choice(["a", "b", "c", "lonely", None], n, p=[0.5, 0.3, 0.1, 0.001, 0.099]), "grp": rng.choice(["t", "c", "other"], n),
        "pre": 1e6 + rng.normal(size=n), "age": rng.exponential(9, n)})
    df["y"] = 1e6 + rng.exponential(2, n) + df.segment.map({"a": 0, "b": 5}).fillna(-3)
    for k in ("pre", "age", "y"):
        df.loc[rng.random(n) < 0.05, k] = None
    df.loc[5, "y"] = np.inf
    roles = Roles("grp", "y", "t", "c", segment="segment", pre_effect="pre", covariates=("age",))
    for covs in ((), ("age",), ("age", "pre")):
        rows = analysis_rows(spark.createDataFrame(df), roles, "both", covs)
        assert rows.count() == len(df[df.grp != "other"])  # no row is doubled
        merged = {r.segment: r.asDict() for r in segment_moments(rows).collect()}
        direct = {r.segment: r.asDict() for r in segment_moments(each_scope(rows)).collect()}
        assert merged.keys() == direct.keys() and "Overall" in merged
        for name, row in direct.items():
            for k, v in row.items():
                got = merged[name][k]
                assert got == (pytest.approx(v, rel=1e-6, abs=1e-9) if isinstance(v, float) else v), (name, k)


def test_looks_are_merged_from_their_parts(spark):
    from armlift.operators.moments import segment_moments

    rng = np.random.default_rng(41)
    n = 900
    df = pd.DataFrame({"segment": rng.choice(["a", "b"], n), "grp": rng.choice(["t", "c"], n), "y": rng.exponential(2, n), "look": rng.integers(1, 5, n)})
    df.loc[(df.segment == "b") & (df.look == 2), "look"] = 3  # a look without rows of its own
    roles = Roles("grp", "y", "t", "c", segment="segment")
    rows = analysis_rows(spark.createDataFrame(df), roles, look="look")
    assert rows.count() == n
    got = {r.segment: r.asDict() for r in segment_moments(rows).collect()}
    assert set(got) == {f"{s}:{k}" for s in "ab" for k in range(1, 5)}
    for name, row in got.items():
        part = df[(df.segment == name[0]) & (df.look <= int(name[2:]))]
        want = segment_moments(analysis_rows(spark.createDataFrame(part.drop(columns="look")), roles)).first().asDict()
        for k, v in want.items():
            if k != "segment":
                assert row[k] == (pytest.approx(v, rel=1e-8) if isinstance(v, float) else v), (name, k)


def test_partition_overwrite_and_catalog_tables(spark, tmp_path):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "segment string, n int")
    path = str(tmp_path / "parts")
    sinks.write_results_partitioned(one, path, "parquet", ["segment"])
    sinks.write_results_partitioned(one.where("segment = 'b'").withColumn("n", F.lit(9)), path, "parquet", ["segment"], "overwrite_partitions")
    assert {(r.segment, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 9)}
    with pytest.raises(ValueError):
        sinks.write_results_partitioned(one, path, "parquet", None, "overwrite_partitions")
    assert sinks.publish_tables(raw=one, managed=True, folder=str(tmp_path / "tables")) == [sinks.RAW]
    assert sinks.query_results(spark, f"SELECT sum(n) AS n FROM {sinks.RAW}").data.first().n == 3
    sinks.publish_tables(raw=one.union(one), managed=True, folder=str(tmp_path / "tables2"))
    assert spark.table(sinks.RAW).count() == 4
    sinks.unpublish_tables(spark)
    assert not spark.catalog.tableExists(sinks.RAW)


def test_scope_both_without_a_segment_column(spark, sample):
    roles = Roles("grp", "y", "t", "c")
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"grp": ["t", "c"] * 300, "y": rng.normal(5, 1, 600)}))
    both = analyze(df, roles, Options(scope="both", diagnostics=False))
    overall = analyze(df, roles, Options(scope="overall", diagnostics=False))
    assert [r.is_overall for r in both.results.collect()] == [False]
    assert both.summary.first() == overall.summary.first()
    assert both.summary.first().total_segments_analyzed == 1


def test_only_queries_are_run(spark):
    spark.range(3).createOrReplaceTempView("three")
    good = "WITH a AS (SELECT id, replace('update', 'u', 'x') AS t FROM three LIMIT 2) SELECT * FROM a WHERE t <> 'drop'"
    answer = sinks.query_results(spark, good)
    assert answer.row_count == 2 and answer.source_tables == ("three",)
    assert sinks.query_results(spark, "SELECT (SELECT max(id) FROM three) AS m, id FROM three").row_count == 3
    for bad in ("INSERT INTO three VALUES (1)", "WITH a AS (SELECT 1 AS id) INSERT INTO three SELECT id FROM a",
                "CREATE TABLE x AS SELECT 1", "SHOW TABLES", "SET x = 1"):
        with pytest.raises(ValueError):
            sinks.query_results(spark, bad)
