"""Comparisons of systems, cohorts, effects, gates and perturbations over the tables.

The full system sees whole vectors, the light one 32 dimensions, the zero system 16.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import jaccard, pieces, taxonomy_words, without_token
from ..operators import comparison as cmp
from ..operators import diagnostics, metrics, ranking, stats
from ..operators.ordering import numbered
from . import vector_queries as vq
from .text_queries import C, CATEGORY, PIECES, TIDY, TX, captions, features_sql, table
from .vector_queries import BOTH, CONF, DRAW, E, K, REL, A, B, cos_sql, judged_sql, per_sql, top_sql

Q: dict = {}
LIGHT = top_sql("c", cos_sql("q.v[1:32]", "c.v[1:32]"))
THREE = f"{E}, {REL}, {A}, {B}, {LIGHT}, {per_sql('a')}, {per_sql('b')}, {per_sql('c')}"


def query(sql=None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


def light(spark, sf):
    v = vq.vectors(spark, sf).withColumn("embedding", F.slice("embedding", 1, 32))
    return ranking.exact_top_k(v, vq.asked(v), K, exclude_self=True)


def _three(spark, sf):
    """(query_id, zero, full, light): first relevant ranks."""
    parts = {"full": vq.system_a(spark, sf), "zero": vq.system_b(spark, sf), "light": light(spark, sf)}
    each = [vq.per_query(spark, sf, r).select("query_id", F.col("first_rank").alias(n)) for n, r in parts.items()]
    return reduce(lambda x, y: x.join(y, "query_id"), each)


@query(
    f"with {THREE}, u as (select 'full' as system, query_id, first_rank from ap union all select 'zero', query_id, first_rank from bp union all select 'light', query_id, first_rank from cp)"
    " select system, count(*) as queries, round(avg(coalesce(first_rank <= 1, false)::int), 6) as r_at_1, round(avg(coalesce(first_rank <= 5, false)::int), 6) as r_at_5, round(quantile_cont(first_rank, 0.5), 6) as median_rank, count(*) - count(first_rank) as misses from u group by 1"
)
def three_system_ranks(spark, sf):
    wide = _three(spark, sf)
    long = wide.select("query_id", F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("first_rank")) for s in ("full", "zero", "light")])).alias("x"))
    return cmp.system_ranks(long.select("query_id", "x.*"))


@query(f"with {BOTH} select count(*) as joint_hits, round(avg(bp.first_rank - ap.first_rank), 6) as mean_delta from ap join bp using (query_id) where ap.first_rank is not null and bp.first_rank is not null")
def joint_rank_delta(spark, sf):
    return cmp.joint_rank_delta(vq.per_a(spark, sf), vq.per_b(spark, sf))


WINS = """case when cp.first_rank < ap.first_rank then 'light_beats_full' when cp.first_rank < bp.first_rank then 'light_fixes_zero'
 when ap.first_rank < bp.first_rank and (cp.first_rank is null or cp.first_rank >= bp.first_rank) then 'full_only_fix'
 when (cp.first_rank is null and bp.first_rank is not null) or cp.first_rank > bp.first_rank then 'light_degraded' else 'unchanged' end"""


@query(f"with {THREE} select {WINS} as category, count(*) as queries, min(query_id) as first_query from ap join bp using (query_id) join cp using (query_id) group by 1")
def three_way_wins(spark, sf):
    t = _three(spark, sf).withColumn("category", cmp.three_way(F.col("zero"), F.col("full"), F.col("light")))
    return cmp.exemplars(t)


KEPT = ("hit_at_1", "rr", "ndcg_at_10")


@query(
    f"with {THREE}, m as ("
    + " union all ".join(f"select '{m}' as metric, (select avg({m}) from bp) as z, (select avg({m}) from ap) as f, (select avg({m}) from cp) as l" for m in KEPT)
    + ") select metric, round(z, 6) as zero, round(f, 6) as full_, round(l, 6) as light, case when f - z > 1e-8 then round((l - z) / (f - z), 6) end as retained from m"
)
def retention_fraction(spark, sf):
    systems = {"z": vq.system_b(spark, sf), "f": vq.system_a(spark, sf), "l": light(spark, sf)}
    means = {n: vq.per_query(spark, sf, r).agg(*[F.avg(m).alias(f"{n}_{m}") for m in KEPT]) for n, r in systems.items()}
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), means.values())  # one row each
    entries = [F.struct(F.lit(m).alias("metric"), *[F.col(f"{n}_{m}").alias(n) for n in systems]) for m in KEPT]
    parts = one.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    kept = F.round(cmp.retention(F.col("z"), F.col("f"), F.col("l")), 6)
    return parts.select("metric", F.round("z", 6).alias("zero"), F.round("f", 6).alias("full_"), F.round("l", 6).alias("light"), kept.alias("retained"))


# vectors rounded to 3 places stand for a smaller number format
SMALL = "list_transform({x}, lambda z: round(z, 3))"
HALF = top_sql("h", cos_sql("q.r", "c.r"), source="er").replace("er q, e c", "er q, er c")
HALVES = f"{E}, er as (select id, v, {SMALL.format(x='v')} as r from e), {A}, {HALF}"


def _small(spark, sf):
    v = vq.vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("double")))
    return ranking.exact_top_k(v, vq.asked(v), K, exclude_self=True)


@query(
    f"""with {HALVES}, j as (select a.candidate_id as x, h.candidate_id as y, abs(a.score - h.score) as d from a full outer join h on a.query_id = h.query_id and a.rank = h.rank)
select coalesce(bool_and(coalesce(x = y, false)), true) as ids_equal, round(max(d), 6) as max_score_delta, max(d) <= 0.01 as equivalent from j"""
)
def merge_equivalence(spark, sf):
    return cmp.equivalence(vq.system_a(spark, sf), _small(spark, sf), 0.01)


@query(
    f"""with {HALVES}, j as (select coalesce(a.query_id, h.query_id) as query_id, a.rank as l, h.rank as r from a full outer join h on a.query_id = h.query_id and a.candidate_id = h.candidate_id),
p as (select query_id, bool_and(coalesce(l = r, false))::int as same, max(case when l = 1 and r = 1 then 1 else 0 end) as first, sum((l is not null and r is not null)::int) / greatest(count(l), 1) as o from j group by 1)
select count(*) as queries, round(avg(same), 6) as ranking_agreement, round(avg(first), 6) as top1_agreement, round(avg(o), 6) as mean_overlap from p"""
)
def small_format_agreement(spark, sf):
    return cmp.agreement(vq.system_a(spark, sf), _small(spark, sf))


CAPS = f"cq as (select doc_id as caption_id, coalesce(text, '') as text from documents), tw as (select caption_id, list_distinct({TX('text')}) as t from cq)"


@query(
    f"""with {BOTH}, {CAPS}, l as (select rel.query_id, max(len(list_intersect(x.t, y.t)) / greatest(1, len(list_distinct(list_concat(x.t, y.t))))) as likeness from rel join tw x on x.caption_id = rel.query_id join tw y on y.caption_id = rel.candidate_id group by 1)
select count(*) as queries, coalesce(sum((ap.hit_at_10 > 0 and bp.hit_at_10 = 0)::int), 0)::bigint as dense_wins, coalesce(sum((bp.hit_at_10 > 0 and ap.hit_at_10 = 0)::int), 0)::bigint as lexical_wins,
 sum(((ap.hit_at_10 > 0) = (bp.hit_at_10 > 0))::int)::bigint as ties, sum((coalesce(likeness, 0) <= 0.2)::int)::bigint as low_overlap from ap join bp using (query_id) left join l using (query_id)"""
)
def lexical_dense_wins(spark, sf):
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(taxonomy_words(F.coalesce("text", F.lit("")))).alias("tokens"))
    sets = lambda v: v.select("id", F.col("label").alias("group")).join(words, "id")
    v = vq.vectors(spark, sf)
    alike = cmp.sets_alike(sets(vq.asked(v)), sets(v), 0.2)
    hit = lambda p: p.select("query_id", (F.col("hit_at_10") > 0).alias("hit"))
    return cmp.lexical_dense(hit(vq.per_a(spark, sf)), hit(vq.per_b(spark, sf)), alike)


@query(f"with {E}, {REL}, {B}, {per_sql('b')} select case when hit_at_1 > 0 then 'success' else 'failure' end as category, min(query_id) as first_query, count(*) as queries from bp group by 1")
def top1_exemplars(spark, sf):
    return cmp.exemplars(vq.per_b(spark, sf).withColumn("category", F.when(F.col("hit_at_1") > 0, "success").otherwise("failure")))


# a query's target is the relevant candidate with the smallest id
@query(
    f"""with {E}, {REL}, {A}, g as (select rel.*, candidate_id = min(candidate_id) over (partition by query_id) as t from rel), h as (select g.query_id, g.t, a.rank from g left join a using (query_id, candidate_id)),
p as (select query_id, """
    + ", ".join(f"max((coalesce(rank <= {k}, false) and t)::int) as t{k}, max(coalesce(rank <= {k}, false)::int) as a{k}" for k in (5, 10))
    + " from h group by 1) select count(*) as queries, "
    + ", ".join(f"round(avg(t{k}), 6) as recall_at_{k}, round(avg(a{k}), 6) as any_recall_at_{k}" for k in (5, 10))
    + " from p"
)
def composed_recall(spark, sf):
    rel = vq.qrels(spark, sf)
    goal = rel.groupBy("query_id").agg(F.min("candidate_id").alias("goal"))
    goals = rel.join(goal, "query_id").select("query_id", "candidate_id", (F.col("candidate_id") == F.col("goal")).alias("is_target"))
    return cmp.composed_metrics(vq.system_a(spark, sf), goals, (5, 10))


@query(
    f"with {E}, {REL}, {A}, {per_sql('a')} select "
    + ", ".join(f"round(avg(hit_at_{k}), 6) as hit_recall_at_{k}, round(avg(recall_at_{k}), 6) as fraction_recall_at_{k}" for k in (1, 5, 10))
    + ", round(avg(first_rank), 6) as mean_rank, round(quantile_cont(first_rank, 0.5), 6) as median_rank from ap"
)
def legacy_recall(spark, sf):
    both = [x for k in (1, 5, 10) for x in (F.round(F.avg(f"hit_at_{k}"), 6).alias(f"hit_recall_at_{k}"), F.round(F.avg(f"recall_at_{k}"), 6).alias(f"fraction_recall_at_{k}"))]
    return vq.per_a(spark, sf).agg(*both, F.round(F.avg("first_rank"), 6).alias("mean_rank"), F.round(F.percentile("first_rank", 0.5), 6).alias("median_rank"))


ASPECTS = [("even", "query_id % 20 = 0"), ("third", "query_id % 30 = 0"), ("any", "true")]


@query(f"with {E}, {REL}, {A}, {per_sql('a')}, x as (" + " union all ".join(f"select '{n}' as aspect, * from ap where {c}" for n, c in ASPECTS) + ") select aspect, count(*) as queries, round(avg(hit_at_10), 6) as hit_at_10, round(avg(rr), 6) as rr from x group by 1")
def aspect_breakdown(spark, sf):
    aspects = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in ASPECTS]))
    return vq.per_a(spark, sf).withColumn("aspect", F.explode(aspects)).groupBy("aspect").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit_at_10"), 6).alias("hit_at_10"), F.round(F.avg("rr"), 6).alias("rr"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75, round(min(value), 6) as least, round(max(value), 6) as greatest from events where value is not null and isfinite(value) group by 1")
def quartile_summary(spark, sf):
    return cmp.quartiles(table(spark, sf, "events"), ["event_type"], "value")


@query("select event_type, sum((value > 50)::int)::bigint as count, count(*) as total, round(sum((value > 50)::int) / greatest(count(*), 1), 6) as rate from events group by 1")
def frequency_with_rate(spark, sf):
    return cmp.frequency(table(spark, sf, "events"), ["event_type"], F.col("value") > 50)


TARGETS = f"{E}, {REL}, {B}, {per_sql('b')}, {CONF}, t as (select query_id, e.label, top1 as confidence, coalesce(first_rank = 1, false) as ok from c join bp using (query_id) join e on e.id = query_id)"


def _confident(spark, sf):
    label = vq.vectors(spark, sf).select(F.col("id").alias("query_id"), "label")
    return vq.targets(spark, sf).select(F.col("id").alias("query_id"), F.col("score").alias("confidence"), (F.col("label") == 1).alias("right")).join(label, "query_id")


@query(
    f"with {TARGETS} select label, count(*) as n, round(avg(confidence), 6) as confidence, round(avg(ok::int), 6) as accuracy, round(avg((not ok and confidence >= 0.8)::int), 6) as confident_errors, count(*) >= 20 as eligible, round(avg(confidence) - (select avg(confidence) from t), 6) as gap from t group by 1"
)
def confidence_disparity(spark, sf):
    return cmp.confidence_disparity(_confident(spark, sf), "label")


@query(f"with {TARGETS} select * from (select label, query_id, confidence, row_number() over (partition by label order by confidence desc, query_id) as place from t where not ok and confidence >= 0.6) where place <= 5")
def high_confidence_errors(spark, sf):
    return cmp.high_confidence_errors(_confident(spark, sf), ["label"], 0.6).select("label", "query_id", "confidence", "place")


@query(
    f"""with {TARGETS}, cq as (select doc_id as caption_id, coalesce(text, '') as text from documents), {features_sql('cq').replace('nv as', 'n_v as').replace('join nv', 'join n_v')}, k as ({CATEGORY})
select category, count(*) as failures, round(avg(confidence), 6) as confidence, round(quantile_cont(confidence, 0.5), 6) as median_confidence, sum((confidence >= 0.6)::int)::bigint as confident_errors from k join t on t.query_id = k.caption_id where not ok group by 1"""
)
def taxonomy_confidence(spark, sf):
    wrong = _confident(spark, sf).filter(~F.col("right")).select(F.col("query_id").alias("caption_id"), "confidence")
    found = diagnostics.categories(diagnostics.caption_features(vq._query_captions(spark, sf))).join(wrong, "caption_id")
    c = F.col("confidence")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("failures"), F.round(F.avg(c), 6).alias("confidence"), F.round(F.percentile(c, 0.5), 6).alias("median_confidence"), F.count_if(c >= 0.6).alias("confident_errors"))


@query(
    f"with {BOTH}, u as (select 'full' as system, * from ap union all select 'zero', * from bp) select round(avg(case when system = 'full' then hit_at_1 end) - avg(case when system = 'zero' then hit_at_1 end), 6) as hit_at_1_delta,"
    " round(avg(case when system = 'full' then rr end) - avg(case when system = 'zero' then rr end), 6) as rr_delta from u"
)
def system_delta(spark, sf):
    both = vq.per_a(spark, sf).withColumn("system", F.lit("full")).unionByName(vq.per_b(spark, sf).withColumn("system", F.lit("zero")))
    wide = both.groupBy().pivot("system", ["full", "zero"]).agg(F.avg("hit_at_1").alias("h"), F.avg("rr").alias("r"))
    return wide.select(F.round(F.col("full_h") - F.col("zero_h"), 6).alias("hit_at_1_delta"), F.round(F.col("full_r") - F.col("zero_r"), 6).alias("rr_delta"))


@query("with p as (select l_orderkey, l_linenumber, nullif(l_discount, 0) as encode, nullif(l_tax, 0) as search from lineitem) select l_orderkey, l_linenumber, case when encode is null and search is null then null else round(coalesce(encode, 0) + coalesce(search, 0), 6) end::double as total from p")
def latency_composition(spark, sf):
    p = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif(F.col("l_discount"), F.lit(0)).cast("double").alias("encode"), F.nullif(F.col("l_tax"), F.lit(0)).cast("double").alias("search"))
    total = F.coalesce("encode", F.lit(0.0)) + F.coalesce("search", F.lit(0.0))
    return p.select("l_orderkey", "l_linenumber", F.when(F.coalesce("encode", "search").isNotNull(), F.round(total, 6)).alias("total"))


RANKED = "rank() over (partition by b order by score) + (count(*) over (partition by b, score) - 1) / 2.0"


@query(
    f"""with {vq.TARGET}, val as (select row_number() over (order by id) - 1 as place, score, label from t), d as (select b, {DRAW} % (select count(*) from val) as pick from val, generate_series(0, 49) g(b)),
s as (select b, score, label from d join val on val.place = d.pick), r as (select *, {RANKED} as rk from s),
u as (select b, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc from r group by 1)
select count(auc) as usable, round(avg(auc), 6) as mean, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high from u"""
)
def auc_bootstrap(spark, sf):
    rows = numbered(vq.targets(spark, sf), "id").select("place", "score", "label")
    return stats.auc_bootstrap(rows, 50)


@query(
    f"""with {E}, {REL}, {B}, {per_sql('b')}, val as (select label, row_number() over (partition by label order by query_id) - 1 as place, count(*) over (partition by label) as n, rr as value from bp join e on e.id = bp.query_id),
d as (select label, b, ('0x' || substr(sha256('42:' || label::varchar || ':' || b::varchar || ':' || place::varchar), 1, 8))::bigint % n as pick from val, generate_series(0, 99) g(b)),
m as (select d.label, b, avg(value) as m from d join val on val.label = d.label and val.place = d.pick group by 1, 2), h as (select label, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by 1)
select label, count(*) as n, round(avg(value), 6) as mean, any_value(low) as low, any_value(high) as high from val join h using (label) group by 1"""
)
def group_bootstrap(spark, sf):
    label = vq.vectors(spark, sf).select(F.col("id").alias("query_id"), "label")
    return stats.group_bootstrap(vq.per_b(spark, sf).join(label, "query_id").select("label", F.col("query_id").alias("id"), F.col("rr").alias("value")), "label", 100)


@query(
    f"""with {BOTH}, s as (select m as metric, query_id % 3 as seed, avg(case when m = 'rr' then ap.rr - bp.rr else ap.hit_at_1 - bp.hit_at_1 end) as d from ap join bp using (query_id), (values ('rr'), ('hit_at_1')) v(m) group by 1, 2),
l as (select metric, case when max(abs(d)) <= 1e-9 then 'no clear difference' when min(d) > 1e-9 then 'positive' when max(d) < -1e-9 then 'negative' else 'mixed / seed-sensitive' end as effect from s group by 1)
select metric, effect, case when effect = 'positive' and metric <> 'rr' then 'KEEP' when effect = 'negative' then 'REMOVE / NOT RECOMMENDED' else 'OPTIONAL' end as component from l"""
)
def effect_labels(spark, sf):
    both = [metrics.paired(vq.per_b(spark, sf), vq.per_a(spark, sf), m).groupBy((F.col("query_id") % 3).alias("seed")).agg(F.avg("delta").alias("d")).withColumn("metric", F.lit(m)) for m in ("rr", "hit_at_1")]
    effects = both[0].unionByName(both[1]).groupBy("metric").agg(cmp.effect_label(F.collect_list("d")).alias("effect"))
    return effects.withColumn("component", cmp.component_label(F.col("effect"), F.col("metric") == "rr"))


@query(
    f"""with {vq.DELTAS}, d as (select b, {DRAW} % (select count(*) from dl) as pick from dl, generate_series(0, 199) g(b)), m as (select b, avg(delta) as m from d join dl on dl.place = d.pick group by 1)
select round((select avg(delta) from dl), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m"""
)
def paired_delta_interval(spark, sf):
    return stats.bootstrap(vq._deltas(spark, sf).withColumnRenamed("delta", "value"), 200).select("mean", "low", "high")


PROXIES = ("top1", "margin", "softmax_top1", "certainty")


@query(
    f"with {E}, {REL}, {B}, {per_sql('b')}, {CONF}, l as (select c.*, coalesce(first_rank = 1, false)::int as label from c join bp using (query_id)), x as ("
    + " union all ".join(f"select {i} as o, '{p}' as proxy, {p} as score, label from l" for i, p in enumerate(PROXIES))
    + "), r as (select *, rank() over (partition by proxy order by score) + (count(*) over (partition by proxy, score) - 1) / 2.0 as rk from x),"
    " u as (select o, proxy, round((sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) as auc from r group by 1, 2)"
    " select proxy, auc, o = (select o from u order by auc desc nulls last, o limit 1) as selected from u"
)
def proxy_selection(spark, sf):
    conf = diagnostics.confidence(vq.system_b(spark, sf))
    right = vq.targets(spark, sf).select(F.col("id").alias("query_id"), "label")
    rows = conf.join(right, "query_id")
    each = [stats.roc_auc(rows.select(F.col(p).alias("score"), "label")).select(F.lit(i).alias("o"), F.lit(p).alias("proxy"), F.col("roc_auc").alias("auc")) for i, p in enumerate(PROXIES)]
    every = reduce(lambda x, y: x.unionByName(y), each)
    best = F.broadcast(every.agg(F.max_by("o", F.struct(F.coalesce("auc", F.lit(-1.0)), -F.col("o"))).alias("best")))
    return every.crossJoin(best).select("proxy", "auc", (F.col("o") == F.col("best")).alias("selected"))


# cohorts


@query("with o as (select vec_id, row_number() over (order by sha256('7' || chr(0) || vec_id::varchar)) as p, count(*) over () as n from embeddings) select vec_id, p <= least(greatest(1, round_even(n * 0.3, 0)), n - 1) as chosen from o")
def selection_holdout(spark, sf):
    return cmp.first_share(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.3, 7)


@query(
    """with r as (select p_partkey as id, p_size / 25 as ratio from part), c as (select *, case when ratio <= 0.75 or ratio >= 1.3333333333333333 then 'shifted' when ratio between 0.9 and 1.1 then 'control' end as cohort from r),
n as (select *, row_number() over (partition by cohort order by id) as p from c where cohort is not null), t as (select least(5, (select count(*) from c where cohort = 'shifted'), (select count(*) from c where cohort = 'control')) as t)
select cohort, id, round(ratio, 6) as ratio from n, t where p <= t"""
)
def shift_cohorts(spark, sf):
    return cmp.shift_cohorts(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("width"), F.lit(25).alias("height")))


@query("with o as (select vec_id, row_number() over (order by vec_id) - 1 as place, count(*) over () as n from embeddings) select place, vec_id from o where place in (select round_even(i * (n - 1) / 4.0, 0) from generate_series(0, 4) g(i))")
def evenly_spaced(spark, sf):
    return cmp.evenly_spaced(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 5)


@query(
    f"""with {TARGETS}, u as (select query_id, 0 as priority from (select query_id from t where not ok and confidence >= 0.6 order by confidence desc, query_id limit 2) union all select query_id, 1 from (select query_id from t where not ok order by query_id limit 2)
 union all select query_id, 2 from (select query_id from t where ok order by query_id limit 2) union all select query_id, 3 from t) select query_id, min(priority) as priority from u group by 1 order by 2, 1 limit 10"""
)
def explanation_cohort(spark, sf):
    t = _confident(spark, sf)
    wrong = t.filter(~F.col("right"))
    sure = wrong.filter(F.col("confidence") >= 0.6).orderBy(F.desc("confidence"), "query_id").limit(2)
    return cmp.priority_union([sure, wrong.orderBy("query_id").limit(2), t.filter("right").orderBy("query_id").limit(2), t], "query_id", 10)


@query(f"with {E}, {A}, {B}, x as (select distinct query_id, candidate_id from a), y as (select distinct query_id, candidate_id from b) select 'full_only' as side, count(*) as pairs from (select * from x except select * from y) union all select 'zero_only', count(*) from (select * from y except select * from x)")
def missing_ids(spark, sf):
    x, y = (s(spark, sf).select("query_id", "candidate_id") for s in (vq.system_a, vq.system_b))
    side = lambda p, q, n: p.join(q, ["query_id", "candidate_id"], "left_anti").agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(n).alias("side"), "pairs")
    return side(x, y, "full_only").unionByName(side(y, x, "zero_only"))


@query(f"with {E}, {A} select a.* from a where query_id in (select o_orderkey from orders)")
def stated_queries(spark, sf):
    chosen = table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("query_id"))
    return vq.system_a(spark, sf).join(chosen, "query_id", "left_semi")


# mining


@query(f"with {E}, {vq.NEG}, f as (select query_id, candidate_id, score, rank from n where rank = 1), h as (select *, row_number() over (order by sha256('9' || chr(0) || query_id::varchar)) as p, count(*) over () as c from f) select query_id, candidate_id from h where p <= greatest(1, ceil(c * 0.25))")
def hard_ratio_subset(spark, sf):
    first = vq._negatives(spark, sf).filter("rank = 1").select("query_id", "candidate_id")
    return cmp.hard_subset(first, "query_id", 0.25, 9).select("query_id", "candidate_id")


WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower(trim({x})), '\\s+'), lambda w: w <> ''))"


@query(
    f"""with {E}, {vq.NEG}, p as (select query_id, candidate_id, {WORDSET.format(x="coalesce(x.text, '')")} as a, {WORDSET.format(x="coalesce(y.text, '')")} as b from n join documents x on x.doc_id = query_id join documents y on y.doc_id = candidate_id where rank = 1)
select query_id, candidate_id, case when len(list_distinct(list_concat(a, b))) = 0 then 0 else round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) end as likeness from p"""
)
def mining_lexical_screen(spark, sf):
    text = lambda k, n: table(spark, sf, "documents").select(F.col("doc_id").alias(k), F.col("text").alias(n))
    pairs = vq._negatives(spark, sf).filter("rank = 1").join(text("query_id", "x"), "query_id").join(text("candidate_id", "y"), "candidate_id")
    return cmp.lexical_screen(pairs, "x", "y").select("query_id", "candidate_id", "likeness")


BAD = "(1, 1, 0.5::double, 1), (2, 3, 'nan'::double, 1), (4, 5, 0.5::double, 0), (6, 7, 0.5::double, 1), (6, 8, 0.5::double, 2), (9, 10, 0.9::double, 1)"


@query(f"with m(query_id, candidate_id, score, rank) as (values {BAD}) select distinct query_id, finding from (select query_id, 'same_as_positive' as finding from m where query_id = candidate_id union all select query_id, 'rank_not_positive' from m where rank <= 0 union all select query_id, 'score_not_finite' from m where not isfinite(score) union all select query_id, 'duplicate_positive' from m group by 1 having count(*) > 1)")
def mined_manifest_findings(spark, sf):
    rows = [(1, 1, 0.5, 1), (2, 3, float("nan"), 1), (4, 5, 0.5, 0), (6, 7, 0.5, 1), (6, 8, 0.5, 2), (9, 10, 0.9, 1)]
    return cmp.mined_findings(spark.createDataFrame(rows, "query_id int, candidate_id int, score double, rank int"))


@query(f"with {C} select group_id, arg_min(caption_id, sha256('42' || chr(0) || caption_id)) as caption_id from c group by 1")
def chosen_captions(spark, sf):
    return cmp.chosen_caption(captions(spark, sf))


# rules and gates


@query("select * from (values ('hit', 'out_of_range'), ('mean_rank', 'out_of_range'), ('gone', 'missing'), ('odd', 'not_finite'), ('odd', 'out_of_range'), ('low', 'bad_k')) v(metric, finding)")
def metric_findings(spark, sf):
    rows = [("hit", 1.5, 1), ("mean_rank", 0.5, 1), ("gone", None, 1), ("odd", float("inf"), 1), ("low", 0.5, 0), ("fine", 0.5, 1), ("median_rank", 3.0, 1)]
    return cmp.metric_findings(spark.createDataFrame(rows, "metric string, value double, k int"))


@query("with r as (select conv_id * 1000 + turn as request_id, text as query, (turn * 40) as top_k from conversations) select request_id, 'blank' as finding from r where trim(regexp_replace(coalesce(query, ''), '\\s+', ' ', 'g')) = '' union all select request_id, 'too_long' from r where length(coalesce(query, '')) > 1000 union all select request_id, 'top_k' from r where top_k is null or top_k not between 1 and 50")
def request_findings(spark, sf):
    r = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("query"), (F.col("turn") * 40).alias("top_k"))
    return cmp.request_findings(r)


GATE = "select event_type as name, round(avg(value), 6) as mean, round(quantile_cont(value, 0.95), 6) as p95 from events where user_id % 2 = {h} group by 1"


@query(f"with c as ({GATE.format(h=0)}), b as ({GATE.format(h=1)}) select c.name, c.mean, c.p95, coalesce(c.mean <= 2 * b.mean and c.p95 <= 3 * b.p95, true) as passed from c left join b using (name)")
def latency_gate(spark, sf):
    side = lambda h: diagnostics.latency(table(spark, sf, "events").filter(F.col("user_id") % 2 == h).withColumnRenamed("event_type", "name"), ["name"], "value").select("name", "mean", "p95")
    return cmp.latency_gate(side(0), side(1))


@query(f"with {E}, {A}, {B}, u as (select 0 as run, query_id, rank, candidate_id from a union all select 1, query_id, rank, candidate_id from b), i as (select run, query_id, list(candidate_id order by rank) as ids from u group by 1, 2) select query_id, count(*) as runs, count(distinct ids) = 1 as consistent from i group by 1")
def consistency_gate(spark, sf):
    runs = [s(spark, sf).select(F.lit(i).alias("run"), "query_id", "rank", "candidate_id") for i, s in enumerate((vq.system_a, vq.system_b))]
    return cmp.consistency_gate(runs[0].unionByName(runs[1]))


# perturbation: a turn against the other turns of its conversation, the next one relevant

TOKENSET = lambda x: f"list_distinct({TX(x)})"
TURNS = f"tu as (select conv_id, turn, coalesce(text, '') as text, {TOKENSET('coalesce(text, chr(32))')} as t from conversations)"


def _judged(variants):
    """SQL: score and rank of the next turn among the other turns, for variants (conv_id, turn, at, token, t)."""
    return f"""(with s as (select v.conv_id, v.turn, v.i, v.token, o.turn as other, case when len(list_distinct(list_concat(v.t, o.t))) = 0 then 0 else round(len(list_intersect(v.t, o.t)) / len(list_distinct(list_concat(v.t, o.t))), 6) end as score
 from {variants} v join tu o on o.conv_id = v.conv_id and o.turn <> v.turn), r as (select *, row_number() over (partition by conv_id, turn, i order by score desc, other) as rank from s) select conv_id * 1000 + turn as query_id, i, token, score, rank from r where other = turn + 1)"""


DELTA = f"""{TURNS}, pc as (select conv_id, turn, {PIECES} as t from tu where turn = 0), oc as (select conv_id, turn, t, unnest(generate_series(1, len(t))) as i from pc),
va as (select conv_id, turn, i - 1 as place, t[i] as token, case when {TIDY} = '' then '[MASK]' else {TIDY} end as text from oc), vt as (select conv_id, turn, place as i, token, {TOKENSET('text')} as t from va), b0 as (select conv_id, turn, 0 as i, '' as token, t from tu where turn = 0),
ju as {_judged('vt')}, jb as {_judged('b0')}, de as (select ju.query_id, ju.i, ju.token, round(jb.score - ju.score, 6) as score_delta, ju.rank - jb.rank as rank_delta from ju join jb using (query_id))"""


def _deltas(spark, sf):
    words = lambda x: F.array_distinct(taxonomy_words(x))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    first = turns.filter("turn = 0").withColumn("pieces", pieces(F.col("text")))
    each = first.select("conv_id", "turn", "pieces", F.posexplode("pieces").alias("at", "token"))
    variants = each.select("conv_id", "turn", F.col("at").cast("long").alias("at"), "token", words(without_token(F.col("pieces"), F.col("at"))).alias("t"))
    plain = first.select("conv_id", "turn", F.lit(0).cast("long").alias("at"), F.lit("").alias("token"), words(F.col("text")).alias("t"))
    others = turns.select("conv_id", F.col("turn").alias("other"), words(F.col("text")).alias("o"))

    def judged(v):
        pairs = v.join(others, "conv_id").filter("other <> turn").withColumn("score", F.round(jaccard(F.col("t"), F.col("o")), 6))
        # a conversation's turns are few
        scores = pairs.groupBy("conv_id", "turn", "at", "token").agg(F.max(F.when(F.col("other") == F.col("turn") + 1, F.col("score"))).alias("score"), F.collect_list(F.struct("score", "other")).alias("all"))
        better = F.size(F.filter("all", lambda x: (x["score"] > F.col("score")) | ((x["score"] == F.col("score")) & (x["other"] < F.col("turn") + 1))))
        return scores.filter("score is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "at", "token", "score", (better + 1).cast("long").alias("rank"))

    return cmp.importance(judged(plain).drop("at", "token"), judged(variants))


@query(f"with {DELTA} select query_id, i as at, token, score_delta, rank_delta from de")
def token_importance(spark, sf):
    return _deltas(spark, sf)


@query(f"with {DELTA} select query_id, count(*) as variants, arg_max(token, (score_delta, i::varchar)) as most_sensitive, arg_min(token, (score_delta, i::varchar)) as least_sensitive, round(max(score_delta) - min(score_delta), 6) as score_gap, max(rank_delta) - min(rank_delta) as rank_gap, max(score_delta) >= min(score_delta) as supported from de group by 1")
def faithfulness(spark, sf):
    return cmp.faithfulness(_deltas(spark, sf))


@query(f"with {DELTA}, p as (select *, row_number() over (partition by query_id order by abs(score_delta) desc, i) as p from de) select query_id, string_agg(token, ' ' order by p) as tokens from p where p <= 3 group by 1")
def top_tokens_by_effect(spark, sf):
    return cmp.top_tokens(_deltas(spark, sf))


# approximate search: one row a configuration


def _probe_sql(n):
    return vq.CELLS.replace("where n <= 9", f"where n <= {n}")


PROBES = (1, 4, 8, 10)
FID = "select a.query_id, sum((a.rank <= 10 and i.rank <= 10)::int) / 10 as f10 from a left join i using (query_id, candidate_id) group by 1"
GRID = " union all ".join(f"select * from (with {E}, {A}, {_probe_sql(n)}, f as ({FID}) select 'ivf_{n:02}' as config, round(avg(coalesce(f10, 0)), 6) as fidelity, {n} as cost from f)" for n in PROBES) + " union all select 'exact', 1.0, 100"


def _configs(spark, sf):
    v, exact = vq.vectors(spark, sf).withColumn("cell", F.col("label")), vq.system_a(spark, sf)
    cells = ranking.centroids(v, "cell")
    rows = [ranking.fidelity(exact, ranking.cell_top_k(v, vq.asked(v), cells, K, n)).select(F.lit(f"ivf_{n:02}").alias("config"), F.col("fidelity_at_10").alias("fidelity"), F.lit(n).alias("cost")) for n in PROBES]
    return reduce(lambda x, y: x.unionByName(y), rows).unionByName(spark.createDataFrame([("exact", 1.0, 100)], "config string, fidelity double, cost int"))


@query(GRID)
def ann_config_grid(spark, sf):
    return _configs(spark, sf)


@query(f"with g as ({GRID}) select config, fidelity, cost from g where fidelity >= 0.99 or config = 'exact' order by (fidelity >= 0.99) desc, cost, config <> 'exact', config limit 1")
def ann_config_selection(spark, sf):
    return cmp.select_config(_configs(spark, sf))


# losses, evaluated over stated batches of 16 pairs of neighbouring vectors


@query(
    f"""with {E}, {vq.NEXT}, p as (select id // 16 as batch, id, v, w from e2), z as (select l.batch, l.id as i, r.id as j, least(14.285714285714286, 100) * list_dot_product(l.v, r.w) / (sqrt(list_dot_product(l.v, l.v)) * sqrt(list_dot_product(r.w, r.w))) as z from p l join p r using (batch)),
x as (select batch, i, ln(sum(exp(z))) - max(case when i = j then z end) as l from z group by 1, 2 union all select batch, j, ln(sum(exp(z))) - max(case when i = j then z end) from z group by 1, 2)
select batch, (count(*) / 2)::bigint as n, round(avg(l), 6) as loss from x group by 1"""
)
def contrastive_loss(spark, sf):
    v = vq.with_next(spark, sf)
    pairs = v.select(F.floor(F.col("id") / 16).alias("batch"), "id", F.col("embedding").alias("left"), F.col("next_embedding").alias("right"))
    return cmp.contrastive_loss(pairs, V.cosine)
