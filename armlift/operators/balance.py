"""Rebalancing of the control arm after a failed pre-period check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlift.functions import tails
from armlift.operators.arms import each_scope
from armlift.operators.inference import aa_test, welch_columns
from armlift.session import attach, stage

# Fixed values.
TARGET_P = 0.10
FIRST_BATCH = 8
MAX_BATCH = 64       # replicates of a pass, each with three sums per row
REACH = 8.0          # standard errors around the expected cut that are ranked exactly
HEX_DIGITS = 13      # of the hash; 52 bits are a whole double

c = F.col


def uniform(unit: Column, replicate: Column, seed: int) -> Column:
    """Repeatable uniform number of a unit in a replicate: the head of an MD5 hash."""
    key = F.concat_ws(":", unit, replicate.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("double") / float(16**HEX_DIGITS)


def _one_batch(control: DataFrame, open_: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """Size, mean, variance and cut of the replicates ``first`` to ``last - 1`` of every open segment.

    A control arm of n_c hashed numbers has its n_t-th smallest near n_t / n_c, within a few standard errors. What lies
    below that window only counts towards three sums per replicate, held side by side in one aggregation; what lies
    inside it, some sqrt(n_c) rows, is ranked. Should a cut lie outside, the window is widened and the batch repeated.
    """
    reach = REACH
    while True:
        share = c("n_t") / c("n_c")
        width = reach * F.sqrt(share * (1 - share) / c("n_c")) + reach * reach / c("n_c")
        plan = open_.withColumns({"low": share - width, "high": share + width})
        rows = attach(control, plan.select("segment", "low", "high", c("mean_c").alias("centre")), ["segment"])
        numbers = F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda b: uniform(c("unit"), b, seed))
        rows = rows.select("segment", (c("x") - c("centre")).alias("x"), "low", "high", numbers.alias("u"))
        below = rows.groupBy("segment").agg(*[
            e.alias(f"{name}_{b}") for b in range(last - first) for name, e in (
                ("n", F.count_if(c("u")[b] < c("low"))), ("s", F.sum(F.when(c("u")[b] < c("low"), c("x")))),
                ("q", F.sum(F.when(c("u")[b] < c("low"), c("x") * c("x")))))])
        below = below.select("segment", F.explode(F.array(*[F.struct(
            F.lit(first + b).alias("b"), c(f"n_{b}").alias("n"), F.coalesce(f"s_{b}", F.lit(0.0)).alias("s"),
            F.coalesce(f"q_{b}", F.lit(0.0)).alias("q")) for b in range(last - first)])).alias("r")).select("segment", "r.*")
        inside = rows.select("segment", "x", F.explode(F.filter(
            F.transform("u", lambda u, b: F.struct((b + first).alias("b"), u.alias("u"))),
            lambda r: (r["u"] >= c("low")) & (r["u"] < c("high")))).alias("r")).select("segment", "x", "r.*")
        wanted = below.join(open_.select("segment", "n_t"), "segment").select(
            "segment", "b", (c("n_t") - c("n")).alias("left"))
        # rows of a unit share a number: they are kept or left together
        place = Window.partitionBy("segment", "b").orderBy("u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = inside.withColumn("place", F.count(F.lit(1)).over(place)).join(wanted, ["segment", "b"])
        cuts = ranked.groupBy("segment", "b").agg(F.min(F.when(c("place") >= c("left"), c("u"))).alias("cut"))
        kept = inside.join(cuts, ["segment", "b"]).where("u <= cut").groupBy("segment", "b").agg(
            F.count(F.lit(1)).alias("n2"), F.sum("x").alias("s2"), F.sum(c("x") * c("x")).alias("q2"), F.max("cut").alias("cut"))
        found = stage(below.join(kept, ["segment", "b"], "left").join(
            open_.select("segment", "n_t", "mean_t", "var_t", c("mean_c").alias("centre")), "segment"))
        if found.where("cut IS NULL OR n >= n_t").isEmpty():
            break
        reach *= 4
    n, s, q = c("n") + c("n2"), c("s") + c("s2"), c("q") + c("q2")
    return found.select("segment", "b", "cut", "n_t", "mean_t", "var_t", n.alias("n_c"), (c("centre") + s / n).alias("mean_c"),
                        ((q - s * s / n) / (n - 1)).alias("var_c"))


def rebalance_control(
    rows: DataFrame, moments: DataFrame, iterations: int = 1000, target_p: float = TARGET_P,
    alpha: float = 0.05, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Rows with rebalanced control arms, and one report row per failed segment.

    Each replicate keeps the control units with the smallest hashed numbers, as many
    rows as there are treated ones. The first replicate that reaches ``target_p``
    wins, otherwise the best one. Replicates run in growing batches, for open
    segments only. The numbers hang on ``unit`` where the rows have one, so that
    nothing but small tables is written; without it every row is a unit of its own,
    named by its place in a written copy of the open control arms. A control arm no
    larger than the treatment arm has one possible subsample, itself, so nothing is
    drawn for it.
    """
    rows = each_scope(rows)
    checked = stage(aa_test(moments, alpha))
    failed = stage(checked.where(~c("aa_test_passed")).select(
        "segment", c("aa_n_t").alias("n_t"), c("aa_n_c").alias("n_c"), c("aa_mean_t").alias("mean_t"),
        c("aa_var_t").alias("var_t"), c("aa_mean_c").alias("mean_c"), c("aa_p_value").alias("p_before")))
    pending = stage(failed.where(c("n_c") > c("n_t")))
    control = attach(rows.where("arm = 'c' and y is not null and x is not null"), pending.select("segment"), ["segment"])
    if "unit" not in rows.columns and not pending.isEmpty():
        control = stage(control.withColumn("unit", F.monotonically_increasing_id().cast("string")))

    tried, start, size = [], 0, FIRST_BATCH
    while start < iterations and not pending.isEmpty():
        stop = min(start + size, iterations)
        stats = welch_columns(_one_batch(control, pending, start, stop, seed), "w")
        stats = stage(stats.select(
            "segment", "b", "n_c", "cut", F.coalesce(tails.t_p_value(c("w_t"), c("w_df")), F.lit(1.0)).alias("p")))
        tried.append(stats)
        reached = stats.where(c("p") >= target_p).select("segment").distinct()
        pending = stage(pending.join(reached, "segment", "left_anti"))
        start, size = stop, min(size * 2, MAX_BATCH)

    none = {"replicate": "int", "p_after": "double", "kept_c": "bigint", "cut": "double"}
    report = failed.withColumns({k: F.lit(None).cast(t) for k, t in none.items()})
    if tried:
        whole = tried[0]
        for part in tried[1:]:
            whole = whole.unionByName(part)
        one = F.struct("b", "p", "n_c", "cut")
        hit = c("p") >= target_p
        best = whole.groupBy("segment").agg(
            F.min_by(one, F.when(hit, c("b"))).alias("first"),
            F.max_by(one, F.struct(c("p"), -c("b"))).alias("top"))
        best = best.select("segment", F.coalesce("first", "top").alias("w")).select(
            "segment", c("w.b").alias("replicate"), c("w.p").alias("p_after"), c("w.n_c").alias("kept_c"), c("w.cut").alias("cut"))
        report = failed.join(best, "segment", "left")
    report = stage(report)
    chosen = stage(report.where(c("cut").isNotNull() & (c("p_after") > 0)).select("segment", "replicate", "cut"))
    out = rows
    if not chosen.isEmpty():
        flagged = attach(rows, chosen, ["segment"], "left")
        if "unit" in rows.columns:
            drawn = uniform(c("unit"), c("replicate"), seed) <= c("cut")
            complete = c("y").isNotNull() & c("x").isNotNull()
            out = flagged.where(c("cut").isNull() | (c("arm") == "t") | (complete & drawn)).select(*rows.columns)
        else:
            others = flagged.where(c("cut").isNull() | (c("arm") == "t")).select(*rows.columns)
            redrawn = attach(control, chosen, ["segment"]).where(uniform(c("unit"), c("replicate"), seed) <= c("cut"))
            out = others.unionByName(redrawn.select(*rows.columns))
    p_final = F.coalesce("p_after", "p_before")
    return out, report.select(
        "segment", "p_before", "replicate", p_final.alias("aa_p_value"),
        c("n_c").alias("original_control_size"),
        F.coalesce("kept_c", "n_c").alias("balanced_control_size"),
        F.coalesce(c("replicate") + 1, F.lit(1)).cast("int").alias("bootstrap_iterations"),
        (p_final > alpha).alias("aa_test_passed"))
