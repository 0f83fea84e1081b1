"""Retrieval and ranking-evaluation queries over `embeddings`.

Every tenth vector is a query, relevance is the same label, and a query is not its own candidate.
The second signal of a vector is the vector that follows it; the weaker system sees 16 dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.vectors import blend, cosine, normalize, pair_features
from ..operators import diagnostics, metrics, ranking, stats
from .text_queries import CATEGORY, features_sql

K = 10
ALPHAS = (0.25, 0.5, 0.75)


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "label", "embedding")


def asked(v):
    return v.filter("id % 10 = 0")


def system_a(spark, sf, k=K):
    v = vectors(spark, sf)
    return ranking.exact_top_k(v, asked(v), k, exclude_self=True)


def system_b(spark, sf, k=K):
    v = vectors(spark, sf).withColumn("embedding", F.slice("embedding", 1, 16))
    return ranking.exact_top_k(v, asked(v), k, exclude_self=True)


def qrels(spark, sf):
    v = vectors(spark, sf).select("id", "label")
    q = asked(v).select(F.col("id").alias("query_id"), "label")
    c = v.select(F.col("id").alias("candidate_id"), "label")
    return q.join(c, "label").filter("query_id <> candidate_id").select("query_id", "candidate_id", F.lit(1.0).alias("gain"))


def with_next(spark, sf):
    return ranking.circular_next(vectors(spark, sf), "id", ["embedding", "label"])


def fused(v, alpha):
    """Queries that blend unit vectors of both signals, not normalised."""
    mix = F.zip_with(normalize(F.col("embedding")), normalize(F.col("next_embedding")), lambda x, y: alpha * x + (1 - alpha) * y)
    return v.withColumn("embedding", mix)


def per_query(spark, sf, top):
    """Metrics of a ranking; relevance is the label, so no list of relevant pairs is made."""
    return metrics.per_query_in_groups(top, vectors(spark, sf).select("id", "label"))


def hits_of(spark, sf, top):
    """(query_id, candidate_id, gain) of a ranking's relevant candidates."""
    return metrics.in_groups(top, vectors(spark, sf).select("id", "label")).filter("hit = 1").select("query_id", "candidate_id", "gain")


def per_a(spark, sf):
    return per_query(spark, sf, system_a(spark, sf))


def per_b(spark, sf):
    return per_query(spark, sf, system_b(spark, sf))


def cos_sql(a, b):
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


E = "e as (select vec_id as id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def top_sql(name, score, where="q.id % 10 = 0 and q.id <> c.id", source="e", k=K):
    """CTEs for the top-k of a score over all pairs; `name` has the ranking."""
    return f"""{name}_s as (select q.id as query_id, c.id as candidate_id, {score} as score from {source} q, e c where {where}),
{name} as (select * from (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from {name}_s) where rank <= {k})"""


A = top_sql("a", cos_sql("q.v", "c.v"))
B = top_sql("b", cos_sql("q.v[1:16]", "c.v[1:16]"))
REL = "rel as (select q.id as query_id, c.id as candidate_id from e q join e c on q.label = c.label and q.id <> c.id where q.id % 10 = 0), nrel as (select query_id, count(*) as n from rel group by 1)"


def judged_sql(name):
    return f"""{name}j as (select r.*, (rel.candidate_id is not null)::int as hit from {name} r left join rel using (query_id, candidate_id)),
{name}h as (select *, sum(hit) over (partition by query_id order by rank) as hits from {name}j)"""


def per_sql(name, ks=(1, 5, 10)):
    """CTE {name}p: metrics of each query; all gains are 1."""
    dcg = lambda k: f"sum(case when rank <= {k} then hit / log2(rank + 1.0) else 0 end)"
    ideal = lambda k: f"list_sum(list_transform(generate_series(1, least(n, {k})), lambda i: 1.0 / log2(i + 1.0)))"
    hits = lambda k: f"sum(case when rank <= {k} then hit else 0 end)"
    at = ", ".join(f"{hits(k)} as h{k}, {dcg(k)} as d{k}" for k in ks)
    out = ", ".join(
        f"case when n is not null then h{k} / {k}.0 end::double as precision_at_{k}, case when n is not null then h{k} / n end::double as recall_at_{k},"
        f" case when n is not null then (h{k} > 0)::int end::double as hit_at_{k}, case when n is not null then d{k} / {ideal(k)} end::double as ndcg_at_{k}"
        for k in ks
    )
    return f"""{judged_sql(name)}, {name}g as (select query_id, min(case when hit = 1 then rank end) as first_rank, sum(case when hit = 1 then hits / rank else 0 end) as aps, {at} from {name}h group by 1),
{name}p as (select query_id, coalesce(n, 0)::bigint as n_rel, first_rank, {out}, case when n is not null then coalesce(1.0 / first_rank, 0) end::double as rr, case when n is not null then aps / n end::double as ap
  from {name}g left join nrel using (query_id))"""


NEXT = """e2 as (select *, coalesce(lead(v) over (order by id), first_value(v) over (order by id)) as w,
 coalesce(lead(label) over (order by id), first_value(label) over (order by id)) as next_label from e)"""
UNIT = lambda x: f"list_transform({x}, lambda z: z / sqrt(list_dot_product({x}, {x})))"


def fused_sql(alpha):
    """CTE m: queries with the blend u of both unit vectors."""
    return f"""{NEXT}, m1 as (select *, {UNIT("v")} as uv, {UNIT("w")} as uw from e2),
m as (select *, list_transform(generate_series(1, len(uv)), lambda i: {alpha} * uv[i] + {1 - alpha} * uw[i]) as u from m1)"""


LATE = "round(list_dot_product(q.u, c.v) / sqrt(list_dot_product(c.v, c.v)), 6)"
Q: dict = {}


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query(f"with {E} select id as vec_id, unnest(generate_series(0, len(v) - 1))::bigint as at, round(unnest(v) / sqrt(list_dot_product(v, v)), 6) as x from e")
def vector_normalize(spark, sf):
    v = vectors(spark, sf).select(F.col("id").alias("vec_id"), F.posexplode(normalize(F.col("embedding"))).alias("at", "x"))
    return v.select("vec_id", F.col("at").cast("long").alias("at"), F.round("x", 6).alias("x"))


@query(f"with {E}, {top_sql('t', cos_sql('q.v', 'c.v'), 'q.id % 10 = 0')} select t.*, e.label as candidate_label from t join e on t.candidate_id = e.id")
def vector_topk(spark, sf):
    v = vectors(spark, sf)
    top = ranking.exact_top_k(v, asked(v), K)
    return top.join(v.select(F.col("id").alias("candidate_id"), F.col("label").alias("candidate_label")), "candidate_id")


@query(f"with {E}, {A} select * from a")
def vector_topk_self_excluded(spark, sf):
    return system_a(spark, sf)


@query(f"with {E}, {top_sql('t', cos_sql('q.v', 'c.v'), 'q.id = 0', k=10**9)} select * from t")
def vector_single_query_rank(spark, sf):
    v = vectors(spark, sf)
    one = v.filter("id = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    # one row, found by its id, against all
    pairs = v.select(F.col("id").alias("candidate_id"), F.col("embedding").alias("c")).crossJoin(F.broadcast(one.limit(1)))
    return ranking.rank_within(ranking.scored_pairs(pairs, cosine(F.col("q"), F.col("c"))))


@query(f"with {E}, {fused_sql(0.5)}, {top_sql('t', LATE, source='m')} select * from t")
def late_fusion_topk(spark, sf):
    return ranking.exact_top_k(vectors(spark, sf), fused(asked(with_next(spark, sf)), 0.5), K, exclude_self=True, unit_queries=False)


@query(f"with {E}, {fused_sql(0.5)}, {top_sql('t', cos_sql('q.u', 'c.v'), source='m')} select * from t")
def early_fusion_topk(spark, sf):
    q = asked(with_next(spark, sf)).withColumn("embedding", blend(normalize(F.col("embedding")), normalize(F.col("next_embedding")), 0.5))
    return ranking.exact_top_k(vectors(spark, sf), q, K, exclude_self=True)


def variants():
    return [("image_only", 1.0), ("text_only", 0.0), *((f"{kind}_{a}", a) for kind in ("early", "late") for a in ALPHAS)]


def _grid_sql():
    parts = []
    for name, a in variants():
        score = LATE if name.startswith("late") else cos_sql("q.u", "c.v")
        cte = f"{E}, {REL}, {fused_sql(a)}, {top_sql('t', score, source='m')}, {per_sql('t')}"
        parts.append(f"select * from (with {cte} select '{name}' as variant, {a}::double as alpha, round(avg(hit_at_1), 6) as hit_at_1, round(avg(hit_at_5), 6) as hit_at_5, round(avg(rr), 6) as mrr from tp)")
    return " union all ".join(parts)


def _grid(spark, sf):
    v, q, parts = vectors(spark, sf), asked(with_next(spark, sf)), []
    for name, a in variants():
        top = ranking.exact_top_k(v, fused(q, a), K, exclude_self=True, unit_queries=not name.startswith("late"))
        means = per_query(spark, sf, top).agg(F.round(F.avg("hit_at_1"), 6).alias("hit_at_1"), F.round(F.avg("hit_at_5"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))
        parts.append(means.select(F.lit(name).alias("variant"), F.lit(float(a)).alias("alpha"), "*"))
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(_grid_sql())
def fusion_variant_grid(spark, sf):
    return _grid(spark, sf)


@query(f"with g as ({_grid_sql()}) select variant, alpha, mrr from g order by mrr desc, alpha, variant limit 1")
def fusion_selection(spark, sf):
    return _grid(spark, sf).orderBy(F.desc("mrr"), "alpha", "variant").limit(1).select("variant", "alpha", "mrr")


@query(
    f"""with {E}, {fused_sql(0.5)}, {top_sql('t', cos_sql('q.u', 'c.v'), source='m')}
select t.*, (x.label = m.next_label)::int::bigint as is_target from t join m on t.query_id = m.id join e x on t.candidate_id = x.id"""
)
def composed_retrieval_topk(spark, sf):
    v = with_next(spark, sf)
    top = ranking.exact_top_k(vectors(spark, sf), fused(asked(v), 0.5), K, exclude_self=True)
    goal = v.select(F.col("id").alias("query_id"), F.col("next_label").alias("goal"))
    found = v.select(F.col("id").alias("candidate_id"), F.col("label").alias("got"))
    return top.join(goal, "query_id").join(found, "candidate_id").select(*top.columns, (F.col("goal") == F.col("got")).cast("long").alias("is_target"))


@query(f"with {E}, {NEXT}, {top_sql('t', cos_sql('q.w', 'c.v'), source='e2')} select * from t")
def conflict_roll_topk(spark, sf):
    v = with_next(spark, sf)
    return ranking.exact_top_k(vectors(spark, sf), asked(v).withColumn("embedding", F.col("next_embedding")), K, exclude_self=True)


def _pairs(spark, sf):
    v = vectors(spark, sf)
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return system_a(spark, sf).join(q, "query_id").join(v.select(F.col("id").alias("candidate_id"), F.col("embedding").alias("c")), "candidate_id")


PAIRS = f"{A}, p as (select a.*, q.v as q, c.v as c from a join e q on a.query_id = q.id join e c on a.candidate_id = c.id)"
GAP = "list_sum(list_transform(generate_series(1, len(q)), lambda i: abs(q[i] - c[i])))"


@query(f"with {E}, {PAIRS} select query_id, candidate_id, (2 * len(q) + 1)::bigint as features, round(list_dot_product(q, c), 6) as dot, round({GAP}, 6) as gap from p")
def pair_feature_map(spark, sf):
    f = _pairs(spark, sf).withColumn("f", pair_features(F.col("q"), F.col("c"))).withColumn("d", F.size("q"))
    gap = F.aggregate(F.slice("f", F.col("d") + 1, F.col("d")), F.lit(0.0), lambda s, x: s + x)
    return f.select("query_id", "candidate_id", F.size("f").cast("long").alias("features"), F.round(F.element_at("f", -1), 6).alias("dot"), F.round(gap, 6).alias("gap"))


RERANK = f"""r as (select query_id, candidate_id, rank as first_rank, round(1.0 * list_dot_product(q, c) - 0.05 * {GAP} + 0.25 * score, 6) as score from p),
rr as (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from r)"""


@query(f"with {E}, {PAIRS}, {RERANK} select * from rr")
def rerank_linear(spark, sf):
    return ranking.linear_rerank(_pairs(spark, sf), (1.0, -0.05, 0.25), K)


@query(
    f"""with {E}, {REL}, {A}, {judged_sql('a')} select d as depth, round(avg(h::double / n), 6) as recall, round(avg((h > 0)::int::double), 6) as hit_rate
 from (select query_id, d, sum(case when rank <= d then hit else 0 end) as h from ah, (values (1), (5), (10)) x(d) group by 1, 2) join nrel using (query_id) group by d"""
)
def candidate_recall(spark, sf):
    per = per_a(spark, sf)
    one = lambda k: per.agg(F.round(F.avg(f"recall_at_{k}"), 6).alias("recall"), F.round(F.avg(f"hit_at_{k}"), 6).alias("hit_rate")).select(F.lit(k).alias("depth"), "recall", "hit_rate")
    return reduce(lambda x, y: x.unionByName(y), [one(k) for k in (1, 5, 10)])


@query(f"with {E}, {REL}, {A}, {judged_sql('a')} select query_id, candidate_id, hit::bigint as hit, row_number() over (partition by query_id order by hit desc, candidate_id) as rank from ah")
def oracle_rerank(spark, sf):
    j = metrics.in_groups(system_a(spark, sf), vectors(spark, sf).select("id", "label")).withColumn("score", F.col("hit").cast("double")).drop("rank")
    return ranking.rank_within(j).select("query_id", "candidate_id", F.col("hit").cast("long").alias("hit"), "rank")


BOTH = f"{E}, {REL}, {A}, {B}, {per_sql('a')}, {per_sql('b')}"


@query(
    f"""with {BOTH}, t1 as (select x.query_id, (x.candidate_id <> y.candidate_id)::int as c from a x join b y using (query_id) where x.rank = 1 and y.rank = 1)
select count(*) as queries, sum(t1.c)::bigint as top1_changed, sum(case when coalesce(bp.first_rank, 11) < coalesce(ap.first_rank, 11) then 1 else 0 end)::bigint as promoted,
 sum(case when coalesce(bp.first_rank, 11) > coalesce(ap.first_rank, 11) then 1 else 0 end)::bigint as demoted from ap join bp using (query_id) join t1 using (query_id)"""
)
def rank_change_counts(spark, sf):
    a, b = system_a(spark, sf), system_b(spark, sf)
    top = lambda r, n: r.filter("rank = 1").select("query_id", F.col("candidate_id").alias(n))
    first = lambda r, n: per_query(spark, sf, r).select("query_id", F.coalesce("first_rank", F.lit(K + 1)).alias(n))
    j = top(a, "ca").join(top(b, "cb"), "query_id").join(first(a, "fa"), "query_id").join(first(b, "fb"), "query_id")
    return j.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("ca") != F.col("cb")).alias("top1_changed"), F.count_if(F.col("fb") < F.col("fa")).alias("promoted"), F.count_if(F.col("fb") > F.col("fa")).alias("demoted"))


CELLS = f"""u as (select id, label, {UNIT('v')} as v from e), pos as (select label, generate_subscripts(v, 1) as place, unnest(v) as x from u),
mean as (select label, place, avg(x) as x from pos group by 1, 2), cm as (select label as cell, list(x order by place) as m from mean group by 1), cell as (select cell, {UNIT('m')} as centroid from cm),
near as (select q.id, cell, row_number() over (partition by q.id order by {cos_sql('q.v', 'centroid')} desc, cell) as n from e q, cell where q.id % 10 = 0),
i_s as (select q.id as query_id, c.id as candidate_id, {cos_sql('q.v', 'c.v')} as score from near join e q on near.id = q.id join e c on c.label = near.cell where n <= 9 and q.id <> c.id),
i as (select * from (select *, row_number() over (partition by query_id order by score desc, candidate_id) as rank from i_s) where rank <= {K})"""


def _ivf(spark, sf):
    v = vectors(spark, sf).withColumn("cell", F.col("label"))
    return ranking.cell_top_k(v, asked(v), ranking.centroids(v, "cell"), K, 9)


@query(f"with {E}, {CELLS} select * from i")
def ivf_label_centroid_topk(spark, sf):
    return _ivf(spark, sf)


@query(
    f"""with {E}, {A}, {CELLS}, f as (select a.query_id, sum((a.rank <= 1 and i.rank <= 1)::int) as f1, sum((a.rank <= 5 and i.rank <= 5)::int) / 5 as f5, sum((a.rank <= 10 and i.rank <= 10)::int) / 10 as f10
 from a left join i using (query_id, candidate_id) group by 1)
select count(*) as queries, round(avg(coalesce(f1, 0)), 6) as fidelity_at_1, round(avg(coalesce(f5, 0)), 6) as fidelity_at_5, round(avg(coalesce(f10, 0)), 6) as fidelity_at_10, round(avg(coalesce(f1, 0)), 6) as top1_agreement from f"""
)
def ann_fidelity(spark, sf):
    return ranking.fidelity(system_a(spark, sf), _ivf(spark, sf))


@query()
def kmeans_ivf_topk(spark, sf):
    v = vectors(spark, sf)
    placed, cells = ranking.kmeans_index(v)
    return ranking.cell_top_k(placed, asked(placed), cells, K, ranking.probes_for(cells.count()))


@query()
def lsh_ann_topk(spark, sf):
    v = vectors(spark, sf)
    return ranking.sign_top_k(v, asked(v), K)


NEG = f"{top_sql('n', cos_sql('q.v', 'c.v'), 'q.id % 10 = 0 and q.label <> c.label', k=20)}"


def _negatives(spark, sf):
    v = vectors(spark, sf)
    # the forbidden candidates of a query are those of its own label, left out where the blocks are scored
    return ranking.exact_top_k(v, asked(v), 20, apart="label")


@query(f"with {E}, {NEG} select * from n")
def hard_negative_pool(spark, sf):
    return _negatives(spark, sf)


def seed_sql(*parts):
    return "('0x' || substr(sha256(" + " || chr(0) || ".join(f"{p}::varchar" for p in parts) + "), 1, 8))::bigint"


@query(f"with {E}, {NEG}, s as (select query_id, count(*) as c, {seed_sql(42, 'query_id')} as h from n group by 1) select n.query_id, n.candidate_id, n.score, n.rank from n join s using (query_id) where n.rank = h % c + 1")
def hard_negative_pick(spark, sf):
    from ..functions.text import stable_seed

    pool = _negatives(spark, sf)
    picks = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).select("query_id", (stable_seed(F.lit(42), F.col("query_id")) % F.col("c") + 1).alias("rank"))
    return pool.join(picks, ["query_id", "rank"]).select("query_id", "candidate_id", "score", "rank")


@query(f"with {E}, {NEG} select count(*) as pairs, sum((score >= 0.85)::int)::bigint as potential, round(max(score), 6) as most_alike from n")
def false_negative_audit(spark, sf):
    return _negatives(spark, sf).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("score") >= 0.85).alias("potential"), F.round(F.max("score"), 6).alias("most_alike"))


def _metric(name, columns):
    sql = f"with {E}, {REL}, {A}, {per_sql('a')} select query_id, " + ", ".join(f"round({c}, 6) as {c}" if c != "first_rank" else c for c in columns) + " from ap"

    def run(spark, sf):
        return per_a(spark, sf).select("query_id", *[F.round(c, 6).alias(c) if c != "first_rank" else F.col(c) for c in columns])

    run.__name__ = name
    Q[name] = (run, sql)


for _n, _c in {
    "precision_at_k": ["precision_at_1", "precision_at_5", "precision_at_10"],
    "recall_at_k": ["recall_at_1", "recall_at_5", "recall_at_10"],
    "hit_rate_at_k": ["hit_at_1", "hit_at_5", "hit_at_10"],
    "ndcg_at_k": ["ndcg_at_1", "ndcg_at_5", "ndcg_at_10"],
    "reciprocal_rank": ["rr"],
    "average_precision": ["ap"],
    "first_relevant_rank": ["first_rank"],
}.items():
    _metric(_n, _c)


def _macro_sql(name):
    means = ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics.metric_names())
    return f"""select count(*) as queries_total, sum((n_rel > 0)::int)::bigint as queries_evaluated, sum((n_rel = 0)::int)::bigint as queries_without_relevance, sum((n_rel > 0 and first_rank is not null)::int)::bigint as hit_queries,
 round(avg(first_rank), 6) as mean_first_rank, round(quantile_cont(first_rank, 0.5), 6) as median_first_rank, {means} from {name}p"""


@query(f"with {E}, {REL}, {A}, {per_sql('a')} {_macro_sql('a')}")
def macro_metrics(spark, sf):
    return metrics.macro(per_a(spark, sf))


@query(
    f"""with {E}, {REL}, {A}, {judged_sql('a')}, s as (select query_id, sum(case when hit = 1 and rank <= 5 then hits / rank else 0 end) as s5, sum(case when hit = 1 then hits / rank else 0 end) as s10 from ah group by 1)
select query_id, round(s5 / least(n, 5), 6) as map_at_5, round(s10 / least(n, 10), 6) as map_at_10 from s join nrel using (query_id)"""
)
def composed_map_at_k(spark, sf):
    return rounded(metrics.truncated_map(system_a(spark, sf), qrels(spark, sf)), {"map_at_5", "map_at_10"})


@query(" union all ".join(f"select * from (with {BOTH} select '{m}' as metric, round(avg(ap.{m}), 6) as a, round(avg(bp.{m}), 6) as b, round(avg(bp.{m} - ap.{m}), 6) as delta from ap join bp using (query_id))" for m in ("hit_at_1", "recall_at_10", "rr", "ap", "ndcg_at_10")))
def system_comparison(spark, sf):
    a, b, parts = per_a(spark, sf), per_b(spark, sf), []
    for m in ("hit_at_1", "recall_at_10", "rr", "ap", "ndcg_at_10"):
        parts.append(metrics.paired(a, b, m).agg(F.round(F.avg("a"), 6).alias("a"), F.round(F.avg("b"), 6).alias("b"), F.round(F.avg("delta"), 6).alias("delta")).select(F.lit(m).alias("metric"), "*"))
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(f"with {BOTH}, d as (select bp.rr - ap.rr as delta from ap join bp using (query_id)) select sum((delta > 1e-12)::int)::bigint as wins, sum((delta < -1e-12)::int)::bigint as losses, sum((abs(delta) <= 1e-12)::int)::bigint as ties, round(avg(delta), 6) as mean_delta from d")
def win_loss_tie(spark, sf):
    return metrics.win_loss_tie(metrics.paired(per_a(spark, sf), per_b(spark, sf), "rr"))


STABLE = f"""{E}, {REL}, {A}, {B}, st as (select coalesce(a.query_id, b.query_id) as query_id, max(case when a.rank = 1 and b.rank = 1 then 1 else 0 end)::bigint as top1_kept,
 sum((a.rank is not null and b.rank is not null)::int) / 10 as overlap, sum((a.rank is not null and b.rank is not null)::int) / count(*) as jaccard,
 min(case when rel.candidate_id is not null then b.rank end) - min(case when rel.candidate_id is not null then a.rank end) as displacement
 from a full outer join b on a.query_id = b.query_id and a.candidate_id = b.candidate_id
 left join rel on rel.query_id = coalesce(a.query_id, b.query_id) and rel.candidate_id = coalesce(a.candidate_id, b.candidate_id) group by 1)"""


def _stability(spark, sf):
    return metrics.stability(system_a(spark, sf), system_b(spark, sf), qrels(spark, sf), K)


@query(f"with {STABLE} select query_id, top1_kept, round(overlap, 6) as overlap, displacement from st")
def rank_stability(spark, sf):
    return rounded(_stability(spark, sf).drop("jaccard"), {"overlap"})


@query(f"with {STABLE} select round(avg(jaccard), 6) as mean_jaccard, round(avg(overlap), 6) as mean_overlap, round(1 - avg(top1_kept), 6) as top1_changed from st")
def jaccard_overlap(spark, sf):
    return _stability(spark, sf).agg(F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.round(1 - F.avg("top1_kept"), 6).alias("top1_changed"))


MOVE = """case when ap.first_rank is null or bp.first_rank is null then case when coalesce(ap.first_rank, 99) <= 5 and coalesce(bp.first_rank, 99) > 5 then 'major_regression'
 when coalesce(bp.first_rank, 99) <= 5 and coalesce(ap.first_rank, 99) > 5 then 'major_improvement' else 'censored' end
 when ap.first_rank = bp.first_rank then 'unchanged' when bp.first_rank < ap.first_rank then case when abs(ap.first_rank - bp.first_rank) >= 5 then 'major_improvement' else 'minor_improvement' end
 else case when abs(ap.first_rank - bp.first_rank) >= 5 then 'major_regression' else 'minor_regression' end end"""


@query(f"with {BOTH} select {MOVE} as movement, count(*) as queries from ap join bp using (query_id) group by 1")
def rank_movement(spark, sf):
    a, b = per_a(spark, sf).select("query_id", F.col("first_rank").alias("x")), per_b(spark, sf).select("query_id", F.col("first_rank").alias("y"))
    return a.join(b, "query_id").groupBy(metrics.movement(F.col("x"), F.col("y")).alias("movement")).agg(F.count(F.lit(1)).alias("queries"))


@query(f"with {BOTH} select (ap.hit_at_1 > 0) as a_right, (bp.hit_at_1 > 0) as b_right, count(*) as queries from ap join bp using (query_id) group by 1, 2")
def transitions(spark, sf):
    a, b = per_a(spark, sf).select("query_id", (F.col("hit_at_1") > 0).alias("a_right")), per_b(spark, sf).select("query_id", (F.col("hit_at_1") > 0).alias("b_right"))
    return a.join(b, "query_id").groupBy("a_right", "b_right").agg(F.count(F.lit(1)).alias("queries"))


@query(f"with {BOTH}, m as (select avg(ap.rr) as c, avg(bp.rr) as d from ap join bp using (query_id)) select round(d - c, 6) as delta, round((c - d) / nullif(c, 0), 6) as relative, round(d / nullif(c, 0), 6) as retention from m")
def metric_degradation(spark, sf):
    m = metrics.paired(per_a(spark, sf), per_b(spark, sf), "rr").agg(F.avg("a").alias("c"), F.avg("b").alias("d"))
    c, d = F.col("c"), F.col("d")
    return m.select(F.round(d - c, 6).alias("delta"), F.round((c - d) / F.nullif(c, F.lit(0.0)), 6).alias("relative"), F.round(d / F.nullif(c, F.lit(0.0)), 6).alias("retention"))


INVALID = "(-1, 5, 0.5::double, 1), (-1, 5, 0.4::double, 2), (-2, 7, 0.1::double, 1), (-2, 8, 0.9::double, 2), (-3, 4, 'nan'::double, 1), (-4, 9, 0.5::double, 1), (-4, 3, 0.5::double, 2)"


@query(
    f"""with {E}, {A}, r as (select query_id, candidate_id, score, rank from a union all select * from (values {INVALID}) v), p as (select *, lag(score) over w as ps, lag(candidate_id) over w as pc from r window w as (partition by query_id order by rank))
select distinct query_id, finding from (select query_id, 'order' as finding from p where ps < score or (ps = score and pc >= candidate_id) union all select query_id, 'duplicate' from r group by query_id, candidate_id having count(*) > 1 union all select query_id, 'score' from r where score is null or not isfinite(score))"""
)
def ranking_validity(spark, sf):
    wrong = [(-1, 5, 0.5, 1), (-1, 5, 0.4, 2), (-2, 7, 0.1, 1), (-2, 8, 0.9, 2), (-3, 4, float("nan"), 1), (-4, 9, 0.5, 1), (-4, 3, 0.5, 2)]
    return metrics.ranking_findings(system_a(spark, sf).select("query_id", "candidate_id", "score", "rank").union(spark.createDataFrame(wrong, "query_id long, candidate_id long, score double, rank long")))


SEVERITY = "case when seen = 1 then 'success' when seen <= 5 then 'low' when seen <= 10 then 'medium' else 'high' end"


def margin_sql(s):
    """CTE {s}m (query_id, margin, margin_class) from {s}h."""
    return f"""{s}w as (select query_id, max(case when rank = 1 then score end) as top, max(case when rank = 1 then hit end) as ok, max(case when hit = 1 then score end) as r from {s}h group by 1),
{s}m as (select query_id, round(top - r, 6) as margin, case when r is null then 'target_not_in_retained_prefix' when ok = 1 then 'correct_top1' when round(top - r, 6) <= 0.02 then 'near_miss' when round(top - r, 6) <= 0.05 then 'ambiguous_close' else 'confident_wrong' end as margin_class from {s}w)"""


def fail_sql(s):
    """CTE {s}f of a system's failures, with the margin class."""
    return f"""{s}n as (select query_id, count(*) as returned from {s} group by 1), {s}rk as (select {s}p.query_id, first_rank, coalesce(first_rank, coalesce(returned, 0) + 1) as seen from {s}p left join {s}n using (query_id)),
{s}f as (select query_id, first_rank, seen <> 1 as top1_failure, seen > 5 as top5_failure, seen > 10 as severe_failure, {SEVERITY} as severity, margin_class from {s}rk left join {s}m using (query_id))"""


FAIL = f"{E}, {REL}, {B}, {per_sql('b')}, {margin_sql('b')}, {fail_sql('b')}"


def _failures(system, spark, sf):
    top = system(spark, sf)
    rel = hits_of(spark, sf, top)
    n = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
    per = per_query(spark, sf, top).join(n, "query_id", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    return diagnostics.failures(per).join(diagnostics.margin_classes(top, rel).drop("margin"), "query_id", "left")


@query(f"with {FAIL} select * exclude (margin_class) from bf")
def failure_taxonomy(spark, sf):
    return _failures(system_b, spark, sf).drop("margin_class")


@query(
    f"with {BOTH}, {margin_sql('a')}, {fail_sql('a')}, {margin_sql('b')}, {fail_sql('b')}, u as (select 'a' as system, * from af union all select 'b', * from bf) select system, count(*) as queries, "
    + ", ".join(f"sum({c}::int)::bigint as {c}, round(avg({c}::int::double), 6) as {c}_rate" for c in ("top1_failure", "top5_failure", "severe_failure"))
    + ", "
    + ", ".join(f"sum((severity = '{s}')::int)::bigint as severity_{s}" for s in ("success", "low", "medium", "high"))
    + ", "
    + ", ".join(f"coalesce(sum((margin_class = '{m}')::int), 0)::bigint as {m}" for m in ("correct_top1", "near_miss", "ambiguous_close", "confident_wrong", "target_not_in_retained_prefix"))
    + " from u group by 1"
)
def failure_summary(spark, sf):
    both = _failures(system_a, spark, sf).withColumn("system", F.lit("a")).unionByName(_failures(system_b, spark, sf).withColumn("system", F.lit("b")))
    return diagnostics.failure_summary(both, ["system"])


# a query's caption is the document of the same id
QUERY_CAPTIONS = "cq as (select doc_id as caption_id, coalesce(text, '') as text from documents)"
BY_FLAG = ["has_number_or_count_term", "has_attribute_term", "has_action_term", "has_spatial_term", "multiple_object_terms", "rare_token_present"]


def _query_captions(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("caption_id"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    f"with {FAIL}, {QUERY_CAPTIONS}, {features_sql('cq')}, ff as (select * from bf join ft on bf.query_id = ft.caption_id), u as (select 'caption_length_bin' as feature, case when word_count <= 3 then 'short_0_3' when word_count <= 8 then 'medium_4_8' else 'long_9_plus' end as value, * from ff"
    + "".join(f" union all select '{x}', 'true', * from ff where {x}" for x in BY_FLAG)
    + ") select feature, value, count(*) as queries, "
    + ", ".join(f"sum({c}::int)::bigint as {c}, round(avg({c}::int::double), 6) as {c}_rate" for c in ("top1_failure", "top5_failure", "severe_failure"))
    + " from u group by 1, 2"
)
def failures_by_caption_feature(spark, sf):
    f = _failures(system_b, spark, sf).withColumnRenamed("query_id", "caption_id")
    return diagnostics.failures_by_feature(f, diagnostics.caption_features(_query_captions(spark, sf)))


@query(f"with {FAIL}, {QUERY_CAPTIONS}, {features_sql('cq')}, k as ({CATEGORY}) select category, label_source, count(*) as failures, count(distinct caption_id) as queries from k join bf on bf.query_id = k.caption_id where top1_failure group by 1, 2")
def failure_categories(spark, sf):
    f = _failures(system_b, spark, sf).filter("top1_failure").select(F.col("query_id").alias("caption_id"))
    found = diagnostics.categories(diagnostics.caption_features(_query_captions(spark, sf))).join(f, "caption_id", "left_semi")
    return found.groupBy("category", "label_source").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("caption_id").alias("queries"))


@query(f"with {E}, {REL}, {B}, {judged_sql('b')}, {margin_sql('b')} select query_id, margin, margin_class from bm")
def score_margin_classes(spark, sf):
    top = system_b(spark, sf)
    return diagnostics.margin_classes(top, hits_of(spark, sf, top))


CONF = f"""c as (select query_id, round(max(score), 6) as top1, round(max(case when rank = 1 then score end) - max(case when rank = 2 then score end), 6) as margin,
 round(max(case when rank = 1 then exp(score) end) / sum(exp(score)), 6) as softmax_top1, round(case when count(*) > 1 then 1 - (ln(sum(exp(score))) - sum(exp(score) * score) / sum(exp(score))) / ln(count(*)) end, 6) as certainty from b group by 1)"""


@query(f"with {E}, {B}, {CONF} select * from c")
def confidence_proxies(spark, sf):
    return diagnostics.confidence(system_b(spark, sf))


#: (id, score, label): confidence of the weaker system's first candidate and whether it is right.
TARGET = f"{E}, {REL}, {B}, {per_sql('b')}, {CONF}, t as (select query_id as id, top1 as score, (first_rank is not null and first_rank = 1)::int as label from c join bp using (query_id))"


def targets(spark, sf):
    b = system_b(spark, sf)
    per = per_query(spark, sf, b).select("query_id", F.coalesce(F.col("first_rank") == 1, F.lit(False)).cast("int").alias("label"))
    return diagnostics.confidence(b).join(per, "query_id").select(F.col("query_id").alias("id"), F.col("top1").alias("score"), "label")


@query(f"with {TARGET}, r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from t) select round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) as roc_auc from r")
def roc_auc(spark, sf):
    return stats.roc_auc(targets(spark, sf))


PREFIX = f"{TARGET}, p as (select *, row_number() over (order by score desc, id) as rank, sum(label) over (order by score desc, id) as pos from t)"


@query(f"with {PREFIX} select round(sum(case when label = 1 then pos / rank end) / sum(label), 6) as pr_auc from p")
def pr_auc(spark, sf):
    return stats.pr_auc(targets(spark, sf))


@query(f"with {PREFIX} select rank, round(rank / (select count(*) from t), 6) as coverage, round(1 - pos / rank, 6) as risk from p")
def risk_coverage_curve(spark, sf):
    return stats.risk_coverage(targets(spark, sf))


@query(f"with {PREFIX} select round(avg(1 - pos / rank), 6) as aurc from p")
def aurc(spark, sf):
    return stats.aurc(targets(spark, sf))


@query(f"with {TARGET} select least(floor(score * 10), 9)::bigint as bin, count(*) as n, round(avg(score), 6) as confidence, round(avg(label), 6) as accuracy, round(abs(avg(score) - avg(label)), 6) as gap from t group by 1")
def reliability_bins(spark, sf):
    return stats.reliability(targets(spark, sf))


@query(f"with {TARGET}, g as (select least(floor(score * 10), 9) as bin, count(*) as n, avg(score) as c, avg(label) as a, sum((score - label) * (score - label)) as sq from t group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) as ece, round(sum(sq) / sum(n), 6) as brier from g")
def ece_brier(spark, sf):
    return stats.ece_brier(targets(spark, sf))


@query(f"with {TARGET}, h as (select threshold, count(*) as n, sum((score >= threshold)::int)::bigint as accepted, sum(case when score >= threshold then label end) as r from t, (values (0.5::double), (0.6::double), (0.7::double), (0.8::double), (0.99::double)) x(threshold) group by 1) select threshold, accepted, round(accepted / n, 6) as coverage, round(r / nullif(accepted, 0), 6) as accuracy, round(1 - r / nullif(accepted, 0), 6) as risk from h")
def selective_metrics(spark, sf):
    return stats.selective(targets(spark, sf), [0.5, 0.6, 0.7, 0.8, 0.99])


@query(f"with {TARGET}, o as (select score, row_number() over (order by score) - 1 as place, count(*) over () as n from t), g as (select target::double as target, greatest(0, ceil(target::double * n) - 1) as x, least(n - 1, floor((1.0 - target::double) * n)) as y from (values (0.5), (0.8), (0.9), (1.0)) v(target), (select count(*) as n from t)) select target, round(a.score, 6) as as_published, round(b.score, 6) as corrected from g join o a on a.place = x join o b on b.place = y")
def selective_thresholds(spark, sf):
    return stats.threshold_for_coverage(targets(spark, sf), [0.5, 0.8, 0.9, 1.0])


@query(f"with {TARGET}, ed as (select min(score) as lo, max(score) as hi from t), g as (select least(floor((score - lo) / ((hi - lo) / 10)), 9) as bin, sum(label) as p, sum(1 - label) as q from t, ed group by 1) select round(sum(least(p / (select sum(p) from g), q / (select sum(q) from g))), 6) as overlap from g")
def distribution_overlap(spark, sf):
    return stats.distribution_overlap(targets(spark, sf))


@query()
def platt_calibration(spark, sf):
    rows = targets(spark, sf)
    return stats.calibrated(rows, stats.platt(rows)).select("id", "label", F.round("score", 6).alias("score"), F.round("calibrated", 6).alias("calibrated"))


DRAW = "('0x' || substr(sha256('42:' || b::varchar || ':' || place::varchar), 1, 8))::bigint"
VALUES = f"{E}, {REL}, {B}, {per_sql('b')}, val as (select row_number() over (order by query_id) - 1 as place, rr as value from bp)"


def _values(spark, sf):
    from ..operators.ordering import numbered

    return numbered(per_b(spark, sf).select("query_id", F.col("rr").alias("value")), "query_id").select("place", "value")


@query(
    f"""with {VALUES}, d as (select b, {DRAW} % (select count(*) from val) as pick from val, generate_series(0, 199) g(b)), m as (select b, avg(value) as m from d join val on val.place = d.pick group by 1)
select round((select avg(value) from val), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high, round(list_sort(list(m))[4 + 1], 6) as floor_low, round(list_sort(list(m))[194 + 1], 6) as floor_high from m"""
)
def bootstrap_ci_hash(spark, sf):
    return stats.bootstrap(_values(spark, sf), 200)


DELTAS = f"{BOTH}, dl as (select row_number() over (order by query_id) - 1 as place, bp.rr - ap.rr as delta from ap join bp using (query_id))"


def _deltas(spark, sf):
    from ..operators.ordering import numbered

    return numbered(metrics.paired(per_a(spark, sf), per_b(spark, sf), "rr"), "query_id").select("place", "delta")


@query(f"with {DELTAS}, m as (select b, avg(case when {DRAW} % 2 = 0 then delta else -delta end) as m from dl, generate_series(0, 199) g(b) group by 1), o as (select avg(delta) as d from dl) select round(max(d), 6) as observed, round((sum((abs(m) >= abs(d) - 1e-15)::int) + 1) / 201.0, 6) as p_value from m, o")
def permutation_sign_flip_hash(spark, sf):
    return stats.sign_flip(_deltas(spark, sf), 200)


HOLM = "('a', 0.04::double), ('b', 0.001::double), ('c', 0.8::double), ('d', 0.02::double)"


@query(f"with h(name, p) as (values {HOLM}) select name, p, round(max(s) over (order by p, name), 6) as adjusted from (select *, least(1.0, (count(*) over () - row_number() over (order by p, name) + 1) * p) as s from h)")
def holm_bonferroni(spark, sf):
    return stats.holm(spark.createDataFrame([("a", 0.04), ("b", 0.001), ("c", 0.8), ("d", 0.02)], "name string, p double"))


@query(f"with {BOTH}, x as (select query_id % 3 as seed, m as metric, case when m = 'rr' then bp.rr - ap.rr else bp.hit_at_1 - ap.hit_at_1 end as value from ap join bp using (query_id), (values ('rr'), ('hit_at_1')) v(m)), s as (select metric, seed, avg(value) as value from x group by 1, 2) select metric, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, round(min(value), 6) as least, round(max(value), 6) as greatest, case when min(value) > 0 then 'ROBUST' when max(value) < 0 then 'NOT SUPPORTED' when max(abs(value)) <= 1e-12 then 'NO CLEAR DIFFERENCE' when min(value) < 0 and max(value) > 0 then 'SEED-SENSITIVE' else 'DIRECTIONALLY CONSISTENT BUT UNCERTAIN' end as stability from s group by 1")
def seed_summary(spark, sf):
    a, b, parts = per_a(spark, sf), per_b(spark, sf), []
    for m in ("rr", "hit_at_1"):
        parts.append(metrics.paired(a, b, m).groupBy((F.col("query_id") % 3).alias("seed")).agg(F.avg("delta").alias("value")).withColumn("metric", F.lit(m)))
    return stats.seed_summary(parts[0].unionByName(parts[1]))


@query(f"with {E}, {REL}, {B}, {per_sql('b')}, r as (select e.label::varchar as label, (query_id % 20 = 0)::varchar as half, hit_at_1, rr from bp join e on bp.query_id = e.id), u as (select 'label' as family, label, hit_at_1, rr from r union all select 'half', half, hit_at_1, rr from r) select family, label, count(*) as n, round(avg(hit_at_1), 6) as hit_at_1, round(avg(rr), 6) as rr from u group by 1, 2")
def group_performance(spark, sf):
    return _groups(spark, sf)


def _groups(spark, sf):
    v = vectors(spark, sf).select(F.col("id").alias("query_id"), "label")
    rows = per_b(spark, sf).join(v, "query_id").withColumn("half", F.col("query_id") % 20 == 0)
    return diagnostics.group_performance(rows, ["label", "half"], ["hit_at_1", "rr"])


@query(f"with g as ({Q['group_performance'][1]}) select family, arg_max(label, (rr, label)) as best, arg_min(label, (rr, label)) as worst, round(max(rr) - min(rr), 6) as gap, count(*) as labels from g where n >= 3 group by 1")
def disparity(spark, sf):
    return diagnostics.disparity(_groups(spark, sf), "rr", 3)


def flagship(spark, sf):
    return vector_topk(spark, sf)


