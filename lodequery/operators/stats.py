"""Calibration, selective prediction, resampling and multiple testing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def roc_auc(rows: DataFrame) -> DataFrame:
    """Tie-aware area under the ROC curve of (score, label); null with one class.

    Ranks come from the distinct scores' counts, so rows with equal scores are one row of the
    running sum.
    """
    by = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    below = W.orderBy("score").rowsBetween(W.unboundedPreceding, -1)  # distinct scores
    ranked = by.withColumn("neg_below", F.coalesce(F.sum(F.col("n") - F.col("p")).over(below), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("neg_below") + 0.5 * (F.col("n") - F.col("p"))))
    sums = ranked.agg(wins.alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.round(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("wins") / (F.col("p") * (F.col("n") - F.col("p")))), 6).alias("roc_auc"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """rows (id, score, label) with rank by descending score, then id, and the positives so far."""
    from .ordering import numbered

    placed = numbered(rows.withColumn("_down", -F.col("score")), "_down", "id").withColumn("rank", F.col("place") + 1)
    step = F.floor(F.col("place") / 4096)
    chunked = placed.withColumn("_chunk", step)
    sums = chunked.groupBy("_chunk").agg(F.sum("label").alias("_s"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)  # one row for 4096
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = W.partitionBy("_chunk").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    return chunked.withColumn("_own", F.sum("label").over(inside)).join(offsets, "_chunk").withColumn("positives", F.col("_before") + F.col("_own")).drop("_chunk", "_own", "_before", "place", "_down")


def pr_auc(rows: DataFrame) -> DataFrame:
    """Mean precision at the positives, by descending score, then id."""
    p = _prefixes(rows)
    return p.agg(F.round(F.sum(F.when(F.col("label") == 1, F.col("positives") / F.col("rank"))) / F.nullif(F.sum("label"), F.lit(0)), 6).alias("pr_auc"))


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(rank, coverage, risk) over the prefixes by descending confidence, then id."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    risk = 1.0 - F.col("positives") / F.col("rank")
    return _prefixes(rows).crossJoin(total).select("rank", F.round(F.col("rank") / F.col("n"), 6).alias("coverage"), F.round(risk, 6).alias("risk"))


def aurc(rows: DataFrame) -> DataFrame:
    return _prefixes(rows).agg(F.round(F.avg(1.0 - F.col("positives") / F.col("rank")), 6).alias("aurc"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of confidence that hold any row: count, mean confidence, accuracy, gap."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    grouped = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("c"), F.avg(F.col("label").cast("double")).alias("a"))
    return grouped.select("bin", "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round(F.abs(F.col("c") - F.col("a")), 6).alias("gap"))


def ece_brier(rows: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("c"), F.avg(F.col("label").cast("double")).alias("a"), F.sum(F.pow(F.col("score") - F.col("label"), 2.0)).alias("sq")
    )
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def selective(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accepted count, coverage, accuracy and risk at each threshold."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    ok = F.col("score") >= F.col("threshold")
    per = rows.select("score", "label", t).groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("accepted"), F.sum(F.when(ok, F.col("label"))).alias("right"))
    accuracy = F.col("right") / F.nullif(F.col("accepted"), F.lit(0))
    return per.select("threshold", "accepted", F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), F.round(accuracy, 6).alias("accuracy"), F.round(1.0 - accuracy, 6).alias("risk"))


def threshold_for_coverage(rows: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the order statistic at ceil(target * n) of the ascending scores, as published, and the corrected one at the (1 - target) quantile."""
    from .ordering import numbered

    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    t = F.broadcast(rows.sparkSession.createDataFrame([(float(x),) for x in targets], "target double"))
    places = t.crossJoin(n)
    up = places.select("target", F.greatest(F.lit(0), F.ceil(F.col("target") * F.col("n")) - 1).cast("long").alias("as_published"), F.least(F.col("n") - 1, F.floor((1.0 - F.col("target")) * F.col("n"))).cast("long").alias("corrected"))
    at = numbered(rows.select("score"), "score")
    first = up.join(at, up["as_published"] == at["place"]).select("target", F.round("score", 6).alias("as_published"))
    second = up.join(at, up["corrected"] == at["place"]).select("target", F.round("score", 6).alias("corrected"))
    return first.join(second, "target")


def distribution_overlap(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Sum over shared bins of the smaller share of either label's scores."""
    edge = F.broadcast(rows.agg(F.min("score").alias("low"), F.max("score").alias("high")))
    width = (F.col("high") - F.col("low")) / bins
    b = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.least(F.floor((F.col("score") - F.col("low")) / width), F.lit(bins - 1)))
    counts = rows.crossJoin(edge).groupBy(b.alias("bin")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    totals = F.broadcast(counts.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")))
    return counts.crossJoin(totals).agg(F.round(F.sum(F.least(F.col("p") / F.col("tp"), F.col("q") / F.col("tq"))), 6).alias("overlap"))


def holm(p_values: DataFrame) -> DataFrame:
    """(name, p, adjusted): running maximum of min(1, (m - i) * p) in ascending order of p. A row a hypothesis."""
    order = W.orderBy("p", "name")
    m = F.count(F.lit(1)).over(W.partitionBy())
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p"))
    return p_values.withColumn("_s", scaled).select("name", "p", F.round(F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0)), 6).alias("adjusted"))


def hash_draw(seed: int, draw, index, n):
    """A reproducible place in [0, n) for a resample's draw: from the first 8 hex digits of a SHA-256."""
    key = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n


def bootstrap(values: DataFrame, resamples: int, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the mean of (place, value), place from 0; interpolated and by floor index.

    A resample draws n of n by hash. Values are summed by resample before anything is gathered.
    """
    n = F.broadcast(values.agg(F.count(F.lit(1)).alias("n")))
    draws = values.select("place").crossJoin(n).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = draws.select("b", hash_draw(seed, F.col("b"), F.col("place"), F.col("n")).alias("place"))
    means = drawn.join(values, "place").groupBy("b").agg(F.avg("value").alias("m"))
    floor = lambda q: F.element_at(F.sort_array(F.collect_list("m")), int((resamples - 1) * q) + 1)
    stats = means.agg(
        F.round(F.percentile("m", low), 6).alias("low"), F.round(F.percentile("m", high), 6).alias("high"), F.round(floor(low), 6).alias("floor_low"), F.round(floor(high), 6).alias("floor_high")
    )
    return values.agg(F.round(F.avg("value"), 6).alias("mean")).crossJoin(F.broadcast(stats))


def auc_bootstrap(rows: DataFrame, resamples: int, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the ROC area of (place, score, label), place from 0; resamples of one class aren't used.

    A resample's area is found by counting labels at each distinct score, as in roc_auc.
    """
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))
    draws = rows.select("place").crossJoin(n).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = draws.select("b", hash_draw(seed, F.col("b"), F.col("place"), F.col("n")).alias("place"))
    at = drawn.join(rows, "place").groupBy("b", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = W.partitionBy("b").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    wins = at.withColumn("won", F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0)) + F.col("q") / 2.0))
    areas = wins.groupBy("b").agg(F.sum("won").alias("w"), (F.sum("p") * F.sum("q")).alias("pq")).filter("pq > 0").select((F.col("w") / F.col("pq")).alias("a"))
    return areas.agg(F.count(F.lit(1)).alias("usable"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.percentile("a", low), 6).alias("low"), F.round(F.percentile("a", high), 6).alias("high"))


def group_bootstrap(rows: DataFrame, group: str, resamples: int, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(group, n, mean, low, high) of (group, id, value): each group's resamples draw from itself by hash."""
    order = W.partitionBy(group).orderBy("id")
    placed = rows.withColumn("place", F.row_number().over(order).cast("long") - 1)
    sizes = placed.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    draws = placed.select(group, "place").join(sizes.select(group, "n"), group).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("b").cast("string"), F.col("place").cast("string"))
    pick = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % F.col("n")
    means = draws.select(group, "b", pick.alias("place")).join(placed.select(group, "place", "value"), [group, "place"]).groupBy(group, "b").agg(F.avg("value").alias("m"))
    interval = means.groupBy(group).agg(F.round(F.percentile("m", low), 6).alias("low"), F.round(F.percentile("m", high), 6).alias("high"))
    return sizes.join(interval, group).select(group, "n", F.round("mean", 6).alias("mean"), "low", "high")


def sign_flip(deltas: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """Two-sided p of the mean delta of (place, delta): signs by a hash's parity, (extreme + 1) / (permutations + 1)."""
    draws = deltas.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    sign = F.when(hash_draw(seed, F.col("p"), F.col("place"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    means = draws.groupBy("p").agg(F.avg(F.col("delta") * sign).alias("m"))
    seen = F.broadcast(deltas.agg(F.avg("delta").alias("d")))
    extreme = F.count_if(F.abs("m") >= F.abs("d") - 1e-15)
    return means.crossJoin(seen).agg(F.round(F.max("d"), 6).alias("observed"), F.round((extreme + 1) / (permutations + 1.0), 6).alias("p_value"))


def platt(rows: DataFrame, rounds: int = 100, ridge: float = 1e-3, tolerance: float = 1e-10) -> tuple[float, float, float, float]:
    """(intercept, slope, mean, sd) of a logistic calibrator over standardised scores, by Newton steps of five sums each."""
    mean, sd, n, positive = rows.agg(F.avg("score"), F.stddev_pop("score"), F.count(F.lit(1)), F.sum("label")).first()
    if not n:
        return 0.0, 0.0, 0.0, 1.0
    if not sd or positive in (0, n):
        share = (positive + 1.0) / (n + 2.0)
        return float(np.log(share / (1 - share))), 0.0, mean, sd or 1.0
    a = b = 0.0
    z = (F.col("score") - mean) / sd
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-(a + b * z)))
        r, w = p - F.col("label"), p * (1.0 - p)
        ga, gb, haa, hab, hbb = rows.agg(F.sum(r), F.sum(r * z), F.sum(w), F.sum(w * z), F.sum(w * z * z)).first()
        gb, hbb = gb + ridge * b, hbb + ridge
        step = np.linalg.solve(np.array([[haa + 1e-12, hab], [hab, hbb]]), np.array([ga, gb]))
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < tolerance:
            break
    return a, b, mean, sd


def calibrated(rows: DataFrame, model: tuple[float, float, float, float]) -> DataFrame:
    a, b, mean, sd = model
    return rows.withColumn("calibrated", 1.0 / (1.0 + F.exp(-(a + b * ((F.col("score") - mean) / sd)))))


def seed_summary(rows: DataFrame) -> DataFrame:
    """n, mean, sample sd (0 for one), least and greatest of each metric over seeds, and its stability label."""
    v = F.col("value")
    label = (
        F.when(F.min(v) > 0, "ROBUST")
        .when(F.max(v) < 0, "NOT SUPPORTED")
        .when((F.max(F.abs(v)) <= 1e-12), "NO CLEAR DIFFERENCE")
        .when((F.min(v) < 0) & (F.max(v) > 0), "SEED-SENSITIVE")
        .otherwise("DIRECTIONALLY CONSISTENT BUT UNCERTAIN")
    )
    return rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("sd"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("greatest"), label.alias("stability")
    )
