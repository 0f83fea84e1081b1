"""Comparing systems: several rankings of the same queries, cohorts, effects, gates and perturbations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold_case, jaccard

#: Bytes of queries' words that are sent to every machine at once.
SLAB_BYTES = 32 << 20


def _mean(c: Column, name: str) -> Column:
    return F.round(F.avg(c), 6).alias(name)


def system_ranks(ranks: DataFrame) -> DataFrame:
    """(system, queries, r_at_1, r_at_5, median_rank, misses) of (system, query_id, first_rank); the median is that of hits."""
    r = F.col("first_rank")
    early = lambda k: F.coalesce(r <= k, F.lit(False)).cast("double")
    return ranks.groupBy("system").agg(
        F.count(F.lit(1)).alias("queries"), _mean(early(1), "r_at_1"), _mean(early(5), "r_at_5"), F.round(F.percentile(r, 0.5), 6).alias("median_rank"), F.count_if(r.isNull()).alias("misses")
    )


def joint_rank_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of b's first rank less a's over queries that both hit; both (query_id, first_rank)."""
    both = a.select("query_id", F.col("first_rank").alias("x")).join(b.select("query_id", F.col("first_rank").alias("y")), "query_id").dropna()
    return both.agg(F.count(F.lit(1)).alias("joint_hits"), _mean(F.col("y") - F.col("x"), "mean_delta"))


def three_way(zero: Column, full: Column, light: Column) -> Column:
    """What the light variant does to a query, the first that holds; ranks may be null for a miss."""
    none = light.isNull()
    return (
        F.when(light < full, "light_beats_full")
        .when(light < zero, "light_fixes_zero")
        .when((full < zero) & (none | (light >= zero)), "full_only_fix")
        .when((none & zero.isNotNull()) | (light > zero), "light_degraded")
        .otherwise("unchanged")
    )


def retention(zero: Column, full: Column, light: Column, least: float = 1e-8) -> Column:
    """The share of the full variant's gain that the light one keeps; null where there is no gain."""
    return F.when(full - zero > least, (light - zero) / (full - zero))


def equivalence(left: DataFrame, right: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Whether two rankings have the same candidates in the same places, and scores within the tolerance place by place."""
    side = lambda d, s: d.select("query_id", "rank", F.col("candidate_id").alias(f"{s}_id"), F.col("score").alias(f"{s}_score"))
    both = side(left, "l").join(side(right, "r"), ["query_id", "rank"], "full")
    worst = F.max(F.abs(F.col("l_score") - F.col("r_score")))
    return both.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("l_id") == F.col("r_id"), F.lit(False))), F.lit(True)).alias("ids_equal"),
        F.round(F.coalesce(worst, F.lit(0.0)), 6).alias("max_score_delta"),
        (F.coalesce(worst, F.lit(0.0)) <= tolerance).alias("equivalent"),
    )


def agreement(left: DataFrame, right: DataFrame, k: int = 10) -> DataFrame:
    """Share of queries with the same whole ranking and with the same first candidate, and the mean overlap of the first k."""
    side = lambda d, s: d.filter(F.col("rank") <= k).select("query_id", "candidate_id", F.col("rank").alias(s))
    both = side(left, "l").join(side(right, "r"), ["query_id", "candidate_id"], "full")
    per = both.groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.col("l") == F.col("r"), F.lit(False))).cast("double").alias("same"),
        F.max(F.when((F.col("l") == 1) & (F.col("r") == 1), 1.0).otherwise(0.0)).alias("first"),
        (F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()) / F.greatest(F.count("l"), F.lit(1))).alias("overlap"),
    )
    return per.agg(F.count(F.lit(1)).alias("queries"), _mean(F.col("same"), "ranking_agreement"), _mean(F.col("first"), "top1_agreement"), _mean(F.col("overlap"), "mean_overlap"))


def lexical_dense(dense: DataFrame, lexical: DataFrame, likeness: DataFrame, low: float = 0.2) -> DataFrame:
    """Wins of either system by hit (query_id, hit), and queries whose best lexical likeness (query_id, likeness) is low; none counts as 0."""
    both = dense.select("query_id", F.col("hit").alias("d")).join(lexical.select("query_id", F.col("hit").alias("x")), "query_id").join(likeness, "query_id", "left")
    return both.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(F.col("d") & ~F.col("x")).alias("dense_wins"),
        F.count_if(F.col("x") & ~F.col("d")).alias("lexical_wins"),
        F.count_if(F.col("x") == F.col("d")).alias("ties"),
        F.count_if(F.coalesce("likeness", F.lit(0.0)) <= low).alias("low_overlap"),
    )


def sets_alike(queries: DataFrame, candidates: DataFrame, low: float, slab: int = SLAB_BYTES) -> DataFrame:
    """(query_id, likeness): a likeness over `low` of each query that has one with another id of its group.

    Both tables are (id, group, tokens), tokens a set of strings; likeness is that of Jaccard, and
    rows where the id or the group is null match nothing. Every candidate is compared with each
    query of its group until one is found; queries are sent to all machines, `slab` bytes of
    tokens at a time, so no row is made for a pair and nothing is shuffled but what is found.
    """
    q, c = (df.select(F.col("id").cast("long").alias("id"), F.col("group").cast("string").alias("group"), "tokens").filter("id is not null and group is not null and size(tokens) > 0") for df in (queries, candidates))
    held = q.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w) + 4))).first()[0] or 0
    slabs = max(1, -(-held // slab))
    found = [_slab_alike(q.filter(F.pmod(F.xxhash64("id"), F.lit(slabs)) == i), c, low) for i in range(slabs)]
    return reduce(DataFrame.union, found).groupBy("query_id").agg(F.max("likeness").alias("likeness"))


def _slab_alike(q: DataFrame, c: DataFrame, low: float) -> DataFrame:
    shared = q.sparkSession.sparkContext.broadcast(q.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        values, sizes = _flat(asked.column("tokens"))
        vocabulary = pc.unique(values)
        codes = np.split(pc.index_in(values, value_set=vocabulary).to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
        ids, best = asked.column("id").to_numpy(), np.zeros(len(sizes))
        open_by: dict[str, list[int]] = {}
        for i, group in enumerate(asked.column("group").to_pylist()):
            open_by.setdefault(group, []).append(i)
        mark = np.zeros(len(vocabulary) + 1, np.uint8)
        for batch in batches:
            groups = np.array(batch.column(1).to_pylist(), object)
            for group in set(groups.tolist()) & open_by.keys():
                rows, at, width = np.flatnonzero(groups == group), 0, 16
                while at < len(rows) and open_by[group]:
                    part = batch.take(pa.array(rows[at : at + width]))
                    values, widths = _flat(part.column(2))
                    words = pc.fill_null(pc.index_in(values, value_set=vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False)
                    starts, others = np.cumsum(widths) - widths, part.column(0).to_numpy(zero_copy_only=False)
                    for i in open_by[group]:
                        mark[codes[i]] = 1
                        both = np.add.reduceat(mark[words], starts, dtype=np.int64)
                        mark[codes[i]] = 0
                        best[i] = np.where(others == ids[i], 0.0, both / (widths + sizes[i] - both)).max()
                    open_by[group] = [i for i in open_by[group] if best[i] <= low]
                    at, width = at + width, min(2 * width, 1024)
        over = np.flatnonzero(best > low)
        if len(over):
            yield pa.RecordBatch.from_arrays([pa.array(ids[over]), pa.array(best[over])], names=["query_id", "likeness"])

    return c.mapInArrow(run, "query_id long, likeness double")


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The values of all lists, and each list's length."""
    values = pc.list_flatten(lists)
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values, pc.list_value_length(lists).to_numpy(zero_copy_only=False) if isinstance(lists, pa.Array) else pc.list_value_length(lists).to_numpy()


def exemplars(per_query: DataFrame, category: str = "category", order: str = "query_id") -> DataFrame:
    """The first query of every category, in a single aggregation."""
    return per_query.groupBy(category).agg(F.min(order).alias("first_query"), F.count(F.lit(1)).alias("queries"))


def composed_metrics(rankings: DataFrame, goals: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: at each k the mean hit rate of the target and of any relevant candidate.

    goals (query_id, candidate_id, is_target): the relevant candidates, one of them the target.
    """
    hits = goals.join(rankings.select("query_id", "candidate_id", "rank"), ["query_id", "candidate_id"], "left")
    at = lambda k, target: F.max(F.when((F.col("rank") <= k) & (F.col("is_target") if target else F.lit(True)), 1.0).otherwise(0.0))
    per = hits.groupBy("query_id").agg(*[at(k, t).alias(f"{n}_{k}") for k in ks for n, t in (("t", True), ("a", False))])
    return per.agg(F.count(F.lit(1)).alias("queries"), *[_mean(F.col(f"{n}_{k}"), f"{name}_at_{k}") for k in ks for n, name in (("t", "recall"), ("a", "any_recall"))])


def quartiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, quartiles and extremes of the finite values of each group."""
    finite = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    q = lambda p, n: F.round(F.percentile(value, p), 6).alias(n)
    return finite.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _mean(F.col(value), "mean"), q(0.5, "median"), q(0.25, "q25"), q(0.75, "q75"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("greatest"))


def frequency(rows: DataFrame, by: list[str], holds: Column) -> DataFrame:
    """count, total and rate of a predicate; null counts as not holding."""
    n = F.count_if(F.coalesce(holds, F.lit(False)))
    return rows.groupBy(*by).agg(n.alias("count"), F.count(F.lit(1)).alias("total"), F.round(n / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("rate"))


def confidence_disparity(rows: DataFrame, group: str, threshold: float = 0.8, least: int = 20) -> DataFrame:
    """Per group of (group, confidence, right): mean confidence, accuracy, rate of confident errors, whether it's large enough, and the gap to the mean of all."""
    per = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("c"),
        F.avg(F.col("right").cast("double")).alias("a"),
        F.avg(F.when(~F.col("right") & (F.col("confidence") >= threshold), 1.0).otherwise(0.0)).alias("e"),
    )
    every = F.broadcast(rows.agg(F.avg("confidence").alias("_all")))
    return per.crossJoin(every).select(
        group, "n", F.round("c", 6).alias("confidence"), F.round("a", 6).alias("accuracy"), F.round("e", 6).alias("confident_errors"), (F.col("n") >= least).alias("eligible"), F.round(F.col("c") - F.col("_all"), 6).alias("gap")
    )


def high_confidence_errors(rows: DataFrame, by: list[str], threshold: float = 0.8, most: int = 5) -> DataFrame:
    """Of each group the wrong queries with the greatest confidence, ties by id."""
    order = W.partitionBy(*by).orderBy(F.desc("confidence"), "query_id")
    wrong = rows.filter(~F.col("right") & (F.col("confidence") >= threshold))
    return wrong.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


def evenly_spaced(ids: DataFrame, key: str, count: int) -> DataFrame:
    """`count` rows at even steps of the sorted keys, first and last included; places are rounded half to even."""
    from .ordering import numbered

    n = F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n")))
    wanted = n.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), "_n").select(F.bround(F.col("i") * (F.col("_n") - 1) / max(1, count - 1)).cast("long").alias("place")).distinct()
    return numbered(ids.select(key), key).join(F.broadcast(wanted), "place").select("place", key)


def first_share(rows: DataFrame, key: str, share: float, seed: int, least: int = 1, spare: int = 1) -> DataFrame:
    """rows with `chosen`: round(n * share) of them, at least `least` and all but `spare`, the first by a seeded SHA-256 of the key.

    The bound is found as a quantile of the hashes' leading bits, so no task orders the table.
    """
    from .ordering import numbered

    named = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)).withColumn("_v", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))
    take = F.least(F.greatest(F.lit(least), F.bround(F.col("_n") * share)), F.col("_n") - spare)
    placed = numbered(named, "_v", "_h").crossJoin(n)
    return placed.withColumn("chosen", F.col("place") < take).drop("_h", "_v", "_n", "place")


def shift_cohorts(rows: DataFrame, most: int = 5) -> DataFrame:
    """(cohort, id, ratio): as many rows of extreme aspect as of a near-square one, the first by id, at most `most`."""
    r = F.col("width") / F.col("height")
    kind = F.when((r <= 0.75) | (r >= 1.3333333333333333), "shifted").when((r >= 0.9) & (r <= 1.1), "control")
    both = rows.select("id", r.alias("ratio"), kind.alias("cohort")).filter("cohort is not null")
    sizes = both.groupBy().pivot("cohort", ["shifted", "control"]).count()
    target = F.broadcast(sizes.select(F.least(F.coalesce("shifted", F.lit(0)), F.coalesce("control", F.lit(0)), F.lit(most)).alias("_t")))
    first = both.withColumn("_p", F.row_number().over(W.partitionBy("cohort").orderBy("id"))).filter(F.col("_p") <= most)
    return first.crossJoin(target).filter(F.col("_p") <= F.col("_t")).select("cohort", "id", F.round("ratio", 6).alias("ratio"))


def priority_union(parts: list[DataFrame], key: str, most: int) -> DataFrame:
    """(key, priority): keys in the order of the lists, then of the keys, each once, the first `most`. Every list is as short as its filter makes it."""
    each = [p.select(key, F.lit(i).alias("priority")) for i, p in enumerate(parts)]
    every = each[0]
    for e in each[1:]:
        every = every.unionByName(e)
    return every.groupBy(key).agg(F.min("priority").alias("priority")).orderBy("priority", key).limit(most)


def effect_label(deltas: Column, tolerance: float = 1e-9) -> Column:
    """Direction of an array of deltas, one a seed."""
    every = lambda test: F.forall(deltas, test)
    return (
        F.when(every(lambda x: F.abs(x) <= tolerance), "no clear difference")
        .when(every(lambda x: x > tolerance), "positive")
        .when(every(lambda x: x < -tolerance), "negative")
        .otherwise("mixed / seed-sensitive")
    )


def component_label(effect: Column, costly: Column) -> Column:
    """What to do with a component whose removal has that effect."""
    return F.when((effect == "positive") & ~costly, "KEEP").when(effect == "negative", "REMOVE / NOT RECOMMENDED").otherwise("OPTIONAL")


def select_config(results: DataFrame, least: float = 0.99, fallback: str = "exact") -> DataFrame:
    """The cheapest of (config, fidelity, cost) that is faithful enough, ties the fallback first, then by name; the fallback if none is."""
    exact = (F.col("config") != fallback).cast("int")
    ok = (F.col("fidelity") >= least).cast("int")
    usable = results.filter((ok == 1) | (exact == 0))
    order = F.struct((F.lit(1) - ok).alias("o"), "cost", exact.alias("e"), "config")
    return usable.agg(F.min_by(F.struct("config", "fidelity", "cost"), order).alias("s")).select("s.*")


def importance(baseline: DataFrame, variants: DataFrame) -> DataFrame:
    """What the deletion of a token does to the relevant score and rank; baseline (query_id, score, rank), variants with at and token as well."""
    b = baseline.select("query_id", F.col("score").alias("_s"), F.col("rank").alias("_r"))
    return variants.join(b, "query_id").select(
        "query_id", "at", "token", F.round(F.col("_s") - F.col("score"), 6).alias("score_delta"), (F.col("rank") - F.col("_r")).alias("rank_delta")
    )


def faithfulness(deltas: DataFrame) -> DataFrame:
    """Per query: the most and the least sensitive token and how far their effects are apart."""
    most = F.max_by("token", F.struct("score_delta", F.col("at").cast("string"))).alias("most_sensitive")
    least = F.min_by("token", F.struct("score_delta", F.col("at").cast("string"))).alias("least_sensitive")
    gap = F.max("score_delta") - F.min("score_delta")
    return deltas.groupBy("query_id").agg(F.count(F.lit(1)).alias("variants"), most, least, F.round(gap, 6).alias("score_gap"), (F.max("rank_delta") - F.min("rank_delta")).alias("rank_gap"), (gap >= 0).alias("supported"))


def top_tokens(deltas: DataFrame, k: int = 3) -> DataFrame:
    """Per query its k tokens with the largest absolute effect, ties by place, as text."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.abs("score_delta")), "at")
    first = deltas.withColumn("_p", F.row_number().over(order)).filter(F.col("_p") <= k)
    return first.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "token"))), lambda x: x["token"]), " ").alias("tokens"))


def lexical_screen(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with `likeness`, the Jaccard likeness of both texts' lower-case words."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), r"\s+"), lambda w: w != ""))
    return pairs.withColumn("likeness", F.round(jaccard(words(left), words(right)), 6))


def hard_subset(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """The ceil(n * ratio) rows with the smallest seeded hashes of the key, at least one where the ratio is positive."""
    from .ordering import numbered

    named = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}\0"), F.col(key).cast("string")), 256)).withColumn("_v", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    n = F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n")))
    take = F.when(F.lit(ratio) > 0, F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(ratio)))).otherwise(0)
    return numbered(named, "_v", "_h").crossJoin(n).filter(F.col("place") < take).drop("_h", "_v", "_n", "place")


def chosen_caption(captions: DataFrame, seed: int = 42) -> DataFrame:
    """(group_id, caption_id): the caption with the smallest seeded hash of each group."""
    key = F.sha2(F.concat(F.lit(f"{seed}\0"), F.col("caption_id")), 256)
    return captions.groupBy("group_id").agg(F.min_by("caption_id", F.struct(key, "caption_id")).alias("caption_id"))


def mined_findings(mined: DataFrame) -> DataFrame:
    """(query_id, finding) of mined negatives (query_id, candidate_id, score, rank) that break a rule."""
    twice = mined.groupBy("query_id").count().filter("count > 1").select("query_id", F.lit("duplicate_positive").alias("finding"))
    rules = {
        "same_as_positive": F.col("query_id") == F.col("candidate_id"),
        "rank_not_positive": F.col("rank") <= 0,
        "score_not_finite": F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")),
    }
    found = mined.select("query_id", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in rules.items()]))).alias("finding"))
    return found.unionByName(twice).distinct()


def metric_findings(metrics: DataFrame) -> DataFrame:
    """(metric, finding) of (metric, value, k): values outside 0 to 1 (ranks: below 1), not finite, or k below 1."""
    v = F.col("value")
    rank = F.col("metric").endswith("rank")
    rules = {
        "missing": v.isNull(),
        "not_finite": F.isnan(v) | (F.abs(v) == float("inf")),
        "out_of_range": (~rank & ((v < 0) | (v > 1))) | (rank & (v < 1)),
        "bad_k": F.col("k") < 1,
    }
    return metrics.select("metric", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]))).alias("finding"))


#: What no group may be named after.
PROTECTED = ["gender", "race", "ethnicity", "religion", "age", "disability", "nationality", "skin_tone", "protected_attribute"]


def protected_labels(groups: DataFrame, *columns: str) -> DataFrame:
    """(name, place) of columns and labels that are protected attributes."""
    spark = groups.sparkSession
    keys = spark.createDataFrame([(c, "column") for c in groups.columns if c.casefold() in PROTECTED], "name string, place string")
    for c in columns:
        found = groups.filter(fold_case(F.col(c)).isin(PROTECTED)).select(F.col(c).alias("name"), F.lit("label").alias("place"))
        keys = keys.unionByName(found.distinct())
    return keys


def request_findings(requests: DataFrame, most_k: int = 50, most_chars: int = 1000) -> DataFrame:
    """(request_id, finding): query texts that are blank or too long, and a top_k outside 1 to most_k."""
    text = F.coalesce(F.col("query"), F.lit(""))
    rules = {"blank": F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "too_long": F.length(text) > most_chars, "top_k": F.col("top_k").isNull() | ~F.col("top_k").between(1, most_k)}
    return requests.select("request_id", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in rules.items()]))).alias("finding"))


def latency_gate(current: DataFrame, baseline: DataFrame, mean_times: float = 2.0, p95_times: float = 3.0) -> DataFrame:
    """current with `passed`: mean and p95 of a name within multiples of the baseline's; one without a baseline passes."""
    b = baseline.select("name", F.col("mean").alias("_m"), F.col("p95").alias("_p"))
    ok = (F.col("mean") <= mean_times * F.col("_m")) & (F.col("p95") <= p95_times * F.col("_p"))
    return current.join(b, "name", "left").withColumn("passed", F.coalesce(ok, F.lit(True))).drop("_m", "_p")


def consistency_gate(runs: DataFrame) -> DataFrame:
    """(query_id, runs, consistent) of (run, query_id, rank, candidate_id): whether all runs return the same ids in the same order."""
    ids = runs.groupBy("run", "query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "candidate_id"))).alias("ids"))
    return ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("runs"), (F.count_distinct(F.to_json("ids")) == 1).alias("consistent"))


def contrastive_loss(pairs: DataFrame, score: Callable[[Column, Column], Column], scale: float = 14.285714285714286, most: float = 100.0) -> DataFrame:
    """(batch, n, loss): mean of both directions' cross-entropies within each batch of (batch, id, left, right); the scale is clamped.

    A batch is a stated number of pairs, all of which meet by definition of the loss.
    """
    s = min(scale, most)
    left = pairs.select("batch", F.col("id").alias("i"), "left")
    right = pairs.select("batch", F.col("id").alias("j"), "right")
    z = left.join(right, "batch").select("batch", "i", "j", (score(F.col("left"), F.col("right")) * s).alias("z"))
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("z")))
    total = lambda by: z.groupBy("batch", by).agg((F.log(F.sum(F.exp(F.col("z") - s))) + s - own).alias("l"))
    both = total("i").select("batch", "l").unionAll(total("j").select("batch", "l"))
    return both.groupBy("batch").agg((F.count(F.lit(1)) / 2).cast("long").alias("n"), _mean(F.col("l"), "loss"))
