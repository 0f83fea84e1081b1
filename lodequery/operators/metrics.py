"""Ranking metrics.

rankings (query_id, candidate_id, score, rank) and qrels (query_id, candidate_id, gain) give one
row a query; queries without relevant candidates have null metrics and drop out of macro means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KS = (1, 5, 10)


def with_relevance(rankings: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds gain (0 where there is none) and hit."""
    q = qrels.select("query_id", "candidate_id", F.col("gain").cast("double").alias("gain"))
    out = rankings.join(q, ["query_id", "candidate_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    return out.withColumn("hit", (F.col("gain") > 0).cast("int"))


def per_query(rankings: DataFrame, qrels: DataFrame, ks=KS) -> DataFrame:
    """precision, recall, hit rate and NDCG at each k, reciprocal rank, average precision, first relevant rank.

    Precision divides by k whatever is returned; recall by the number of relevant candidates; AP
    covers the whole returned list; NDCG's ideal is the k largest gains, and gains are linear.
    """
    best = W.partitionBy("query_id").orderBy(F.desc("gain"), "candidate_id")
    positive = qrels.filter("gain > 0").withColumn("ideal_rank", F.row_number().over(best))
    ideal = positive.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_rel"), *[F.sum(F.when(F.col("ideal_rank") <= k, F.col("gain") / F.log2(F.col("ideal_rank") + 1.0)).otherwise(0.0)).alias(f"idcg_{k}") for k in ks]
    )
    return _per_query(with_relevance(rankings, qrels), ideal, ks)


def in_groups(rankings: DataFrame, members: DataFrame) -> DataFrame:
    """with_relevance() where relevance is the group: members (id, label); a query isn't its own candidate. No pair is made that isn't ranked."""
    label = lambda k, n: members.select(F.col("id").alias(k), F.col("label").alias(n))
    both = rankings.join(label("query_id", "_q"), "query_id", "left").join(label("candidate_id", "_c"), "candidate_id", "left")
    same = F.coalesce((F.col("_q") == F.col("_c")) & (F.col("query_id") != F.col("candidate_id")), F.lit(False))
    return both.withColumn("gain", same.cast("double")).withColumn("hit", same.cast("int")).select(*rankings.columns, "gain", "hit")


def per_query_in_groups(rankings: DataFrame, members: DataFrame, ks=KS) -> DataFrame:
    """per_query() where all other members of a query's group are relevant: they are counted, not listed."""
    sizes = members.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel")).filter("n_rel > 0")
    places = lambda k: F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))
    gains = [F.aggregate(places(k), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0)).alias(f"idcg_{k}") for k in ks]
    ideal = members.join(sizes.select("label", "n_rel", *gains), "label").select(F.col("id").alias("query_id"), "n_rel", *[f"idcg_{k}" for k in ks])
    return _per_query(in_groups(rankings, members), ideal, ks)


def _per_query(judged: DataFrame, ideal: DataFrame, ks) -> DataFrame:
    running = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    judged = judged.withColumn("hits", F.sum("hit").over(running))
    hit = F.col("hit")
    at = lambda k: F.sum(F.when(F.col("rank") <= k, hit).otherwise(0))
    aggregates: list[Column] = [F.min(F.when(hit == 1, F.col("rank"))).alias("first_rank"), F.sum(F.when(hit == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum")]
    for k in ks:
        aggregates += [at(k).alias(f"hits_{k}"), F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}")]
    got = judged.groupBy("query_id").agg(*aggregates)
    joined = got.join(ideal, "query_id", "left")
    some = F.col("n_rel").isNotNull()
    out = [F.col("query_id"), F.coalesce("n_rel", F.lit(0)).cast("long").alias("n_rel"), F.col("first_rank")]
    for k in ks:
        out += [
            F.when(some, F.col(f"hits_{k}") / k).alias(f"precision_at_{k}"),
            F.when(some, F.col(f"hits_{k}") / F.col("n_rel")).alias(f"recall_at_{k}"),
            F.when(some, (F.col(f"hits_{k}") > 0).cast("double")).alias(f"hit_at_{k}"),
            F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).alias(f"ndcg_at_{k}"),
        ]
    out += [F.when(some, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("rr"), F.when(some, F.col("ap_sum") / F.col("n_rel")).alias("ap")]
    return joined.select(*out)


def metric_names(ks=KS) -> list[str]:
    return [f"{m}_at_{k}" for k in ks for m in ("precision", "recall", "hit", "ndcg")] + ["rr", "ap"]


def macro(per: DataFrame, ks=KS) -> DataFrame:
    """Means over the queries that have relevance; ranks only over those with a hit."""
    means = [F.round(F.avg(m), 6).alias(m) for m in metric_names(ks)]
    return per.agg(
        F.count(F.lit(1)).alias("queries_total"),
        F.count_if(F.col("n_rel") > 0).alias("queries_evaluated"),
        F.count_if(F.col("n_rel") == 0).alias("queries_without_relevance"),
        F.count_if((F.col("n_rel") > 0) & F.col("first_rank").isNotNull()).alias("hit_queries"),
        F.round(F.avg("first_rank"), 6).alias("mean_first_rank"),
        F.round(F.percentile("first_rank", 0.5), 6).alias("median_first_rank"),
        *means,
    )


def truncated_map(rankings: DataFrame, qrels: DataFrame, ks=(5, 10)) -> DataFrame:
    """Per query AP at k with the denominator min(relevant, k): the composed-retrieval protocol."""
    judged = with_relevance(rankings, qrels)
    running = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    judged = judged.withColumn("hits", F.sum("hit").over(running))
    sums = judged.groupBy("query_id").agg(*[F.sum(F.when((F.col("hit") == 1) & (F.col("rank") <= k), F.col("hits") / F.col("rank")).otherwise(0.0)).alias(f"s{k}") for k in ks])
    n = qrels.filter("gain > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    return sums.join(n, "query_id").select("query_id", *[(F.col(f"s{k}") / F.least("n_rel", F.lit(k))).alias(f"map_at_{k}") for k in ks])


def paired(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(query_id, a, b, delta) of two systems. Queries that only one has raise an error when they are read."""
    left, right = a.select("query_id", F.col(metric).alias("a"), F.lit(True).alias("_a")), b.select("query_id", F.col(metric).alias("b"), F.lit(True).alias("_b"))
    both = left.join(right, "query_id", "full_outer")
    ok = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("the systems don't have the same queries"))).otherwise(F.col("b") - F.col("a"))
    return both.select("query_id", "a", "b", ok.cast("double").alias("delta"))


def win_loss_tie(pairs: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    d = F.col("delta")
    return pairs.agg(F.count_if(d > epsilon).alias("wins"), F.count_if(d < -epsilon).alias("losses"), F.count_if(F.abs(d) <= epsilon).alias("ties"), F.round(F.avg(d), 6).alias("mean_delta"))


def stability(a: DataFrame, b: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query: is the first candidate kept, overlap of the top k over k, how far the first relevant one moved, Jaccard of the top k."""
    x = a.filter(F.col("rank") <= k).select("query_id", "candidate_id", F.col("rank").alias("ra"))
    y = b.filter(F.col("rank") <= k).select("query_id", "candidate_id", F.col("rank").alias("rb"))
    both = x.join(y, ["query_id", "candidate_id"], "full_outer").join(qrels.filter("gain > 0").select("query_id", "candidate_id", F.lit(1).alias("rel")), ["query_id", "candidate_id"], "left")
    shared = F.sum(F.when(F.col("ra").isNotNull() & F.col("rb").isNotNull(), 1).otherwise(0))
    return both.groupBy("query_id").agg(
        F.max(F.when((F.col("ra") == 1) & (F.col("rb") == 1), 1).otherwise(0)).cast("long").alias("top1_kept"),
        (shared / k).alias("overlap"),
        (shared / F.count(F.lit(1))).alias("jaccard"),
        (F.min(F.when(F.col("rel") == 1, F.col("rb"))) - F.min(F.when(F.col("rel") == 1, F.col("ra")))).alias("displacement"),
    )


def movement(a: Column, b: Column) -> Column:
    """How a rank changed: null is past the end of what was returned, and then only success among the first five tells."""
    big = F.abs(a - b) >= 5
    early = lambda r: F.coalesce(r <= 5, F.lit(False))
    unseen = F.when(early(a) == early(b), "censored").when(early(b), "major_improvement").otherwise("major_regression")
    return (
        F.when(a.isNull() | b.isNull(), unseen)
        .when(a == b, "unchanged")
        .when(b < a, F.when(big, "major_improvement").otherwise("minor_improvement"))
        .otherwise(F.when(big, "major_regression").otherwise("minor_regression"))
    )


def ranking_findings(rankings: DataFrame) -> DataFrame:
    """(query_id, finding): order, duplicates and scores that a valid ranking doesn't have."""
    w = W.partitionBy("query_id").orderBy("rank")
    before = rankings.withColumn("ps", F.lag("score").over(w)).withColumn("pc", F.lag("candidate_id").over(w))
    wrong = (F.col("ps") < F.col("score")) | ((F.col("ps") == F.col("score")) & (F.col("pc") >= F.col("candidate_id")))
    order = before.filter(wrong).select("query_id", F.lit("order").alias("finding"))
    twice = rankings.groupBy("query_id", "candidate_id").count().filter("count > 1").select("query_id", F.lit("duplicate").alias("finding"))
    odd = rankings.filter(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).select("query_id", F.lit("score").alias("finding"))
    return order.unionByName(twice).unionByName(odd).distinct()
