"""Hand-computed values of the retrieval, evaluation, statistics, profile and source operators."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.functions.vectors import well_formed
from lodequery.operators import comparison, diagnostics, lexical, metrics, profile, ranking, stats
from lodequery.operators.ordering import numbered
from lodequery.sources import records


def ranking_of(spark, ids, query=1):
    return spark.createDataFrame([(query, c, 1.0 - i / 100, i + 1) for i, c in enumerate(ids)], "query_id long, candidate_id long, score double, rank long")


def relevant(spark, ids, query=1):
    return spark.createDataFrame([(query, c, 1.0) for c in ids], "query_id long, candidate_id long, gain double")


def test_metrics_by_hand(spark):
    a, b, x = 10, 11, 99
    r = metrics.per_query(ranking_of(spark, [a, x, b]), relevant(spark, [a, b]), ks=(1, 2)).first()
    assert r.precision_at_1 == 1 and r.recall_at_2 == 0.5 and r.rr == 1
    assert r.ap == pytest.approx((1 + 2 / 3) / 2)
    assert r.ndcg_at_2 == pytest.approx(1 / (1 + 1 / math.log2(3)))
    r = metrics.per_query(ranking_of(spark, [1, 2, 3, 4, a]), relevant(spark, [a]), ks=(5,)).first()
    assert (r.precision_at_5, r.recall_at_5, r.ap, r.first_rank) == (0.2, 1.0, 0.2, 5)
    assert r.ndcg_at_5 == pytest.approx(1 / math.log2(6))
    r = metrics.per_query(ranking_of(spark, [a, b]), relevant(spark, [a], query=2)).first()
    assert r.n_rel == 0 and r.rr is None and r.ap is None and r.ndcg_at_1 is None
    m = metrics.macro(metrics.per_query(ranking_of(spark, [a, b]), relevant(spark, [a], query=2))).first()
    assert (m.queries_total, m.queries_evaluated, m.queries_without_relevance) == (1, 0, 1)


def test_truncated_map(spark):
    r = metrics.truncated_map(ranking_of(spark, [20, 40, 30]), relevant(spark, [20, 30]), ks=(3,)).first()
    assert r.map_at_3 == pytest.approx((1 + 2 / 3) / 2)


def test_ties_go_by_id(spark):
    s = spark.createDataFrame([(1, 2, 1.0), (1, 1, 1.0), (1, 3, 2.0)], "query_id long, candidate_id long, score double")
    assert [r.candidate_id for r in ranking.rank_within(s).orderBy("rank").collect()] == [3, 1, 2]
    wrong = spark.createDataFrame([(1, 2, 1.0, 1), (1, 1, 1.0, 2), (1, 1, float("nan"), 3)], "query_id long, candidate_id long, score double, rank long")
    assert {r.finding for r in metrics.ranking_findings(wrong).collect()} >= {"order", "duplicate", "score"}


def test_movement(spark):
    rows = [(8, 2, "major_improvement"), (2, 3, "minor_regression"), (2, 2, "unchanged"), (None, 3, "major_improvement"), (3, None, "major_regression"), (None, None, "censored"), (None, 7, "censored"), (9, None, "censored")]
    df = spark.createDataFrame(rows, "a int, b int, want string")
    assert df.filter(metrics.movement(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_stability(spark):
    r = metrics.stability(ranking_of(spark, [1, 2, 3, 4, 5]), ranking_of(spark, [2, 1, 3, 4, 5]), relevant(spark, [1]), 5).first()
    assert (r.top1_kept, r.overlap, r.displacement) == (0, 1.0, 1)


def test_paired_systems_must_align(spark):
    a, b = (spark.createDataFrame([(i, 1.0)], "query_id long, m double") for i in (1, 2))
    with pytest.raises(Exception, match="same queries"):
        metrics.paired(a, b, "m").collect()
    d = spark.createDataFrame([(0.5, 0.6), (0.5, 0.5), (0.5, 0.4)], "a double, b double").withColumn("delta", F.col("b") - F.col("a"))
    r = metrics.win_loss_tie(d).first()
    assert (r.wins, r.losses, r.ties) == (1, 1, 1)


def test_statistics_by_hand(spark):
    p = spark.createDataFrame([("x", 0.04), ("y", 0.001), ("z", 0.8)], "name string, p double")
    assert {r.name: r.adjusted for r in stats.holm(p).collect()} == {"y": 0.003, "x": 0.08, "z": 0.8}
    rows = spark.createDataFrame([(1, 0.05, 1), (2, 0.15, 0), (3, 0.95, 1)], "id long, score double, label int")
    assert sorted(r.bin for r in stats.reliability(rows).collect()) == [0, 1, 9]
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.2, 1), (4, 0.1, 0)], "id long, score double, label int")
    r = stats.selective(rows, [0.8]).first()
    assert (r.accepted, r.coverage, r.accuracy, r.risk) == (2, 0.5, 0.5, 0.5)
    rows = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.2, 0), (4, 0.1, 0)], "id long, score double, label int")
    assert stats.aurc(rows).first()[0] == pytest.approx(0.208333, abs=1e-6)
    assert stats.roc_auc(rows).first()[0] == 1.0 and stats.pr_auc(rows).first()[0] == 1.0
    assert stats.roc_auc(rows.withColumn("label", F.lit(1))).first()[0] is None
    seeds = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0), ("one", -1.0)], "metric string, value double")
    got = {r.metric: r for r in stats.seed_summary(seeds).collect()}
    assert (got["m"]["mean"], got["m"].sd, got["m"].stability) == (2.0, 1.0, "ROBUST") and got["one"].sd == 0.0


def test_platt_orders_and_fits(spark):
    rows = spark.createDataFrame([(i, i / 100, int(i > 40 or i % 7 == 0)) for i in range(100)], "id long, score double, label int")
    model = stats.platt(rows)
    out = stats.calibrated(rows, model)
    assert model[1] > 0
    assert out.agg(F.avg("calibrated")).first()[0] == pytest.approx(rows.agg(F.avg("label")).first()[0], abs=0.02)
    assert stats.platt(rows.withColumn("label", F.lit(1)))[1] == 0.0


def test_lexical_search(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "blue car"), (3, "red apple tree")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "red apple"), (2, "unseen"), (3, "")], "doc_id long, text string")
    got = lexical.tfidf_search(lexical.tfidf_index(docs), q, 10).collect()
    assert {r.query_id for r in got} == {1} and {r.candidate_id for r in got} == {1, 3}
    docs = spark.createDataFrame([(1, "red apple apple"), (2, "blue car"), (3, "red apple tree")], "doc_id long, text string")
    got = lexical.bm25_search(lexical.bm25_index(docs), q, 10).orderBy("query_id", "rank").collect()
    assert got[0].candidate_id == 1 and {r.query_id for r in got} == {1}
    with pytest.raises(ValueError):
        lexical.bm25_search(lexical.bm25_index(docs), q, 10, b=2.0)


def test_vector_search(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9), 0.0, 0.0]) for i in range(10)] + [(90, [0.0] * 4), (91, None), (92, [float("nan")] * 4), (93, [])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "id long, embedding array<float>")
    got = ranking.exact_top_k(v, q, 100).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == list(range(10))
    assert [r.candidate_id for r in ranking.exact_top_k(v, q, 2, exclude_self=True).orderBy("rank").collect()] == [1, 2]
    assert ranking.exact_top_k(v, q.limit(0), 3).count() == 0
    assert v.filter(well_formed(F.col("embedding"))).count() == 10
    assert ranking.exact_top_k(v, v, 1, block=3).count() == 10


def test_approximate_search_recalls(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(600)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    q = v.filter("id % 20 = 0")
    exact = ranking.exact_top_k(v, q, 10, exclude_self=True)
    placed, cells = ranking.kmeans_index(v)
    assert placed.count() == 600
    assert ranking.fidelity(exact, ranking.cell_top_k(placed, q, cells, 10, 12)).first().fidelity_at_10 >= 0.9
    assert ranking.fidelity(exact, ranking.sign_top_k(v, q, 10)).first().fidelity_at_10 >= 0.9


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", ["kmeans_ivf_topk", "lsh_ann_topk", "ivf_label_centroid_topk"])
def test_index_queries_recall_on_their_table(spark, name, size):
    from lodequery.plans import vector_queries

    sf = f"/root/testdata/{size}"
    assert ranking.fidelity(vector_queries.system_a(spark, sf), getattr(vector_queries, name)(spark, sf)).first().fidelity_at_10 >= 0.9


def test_hard_negatives_skip_the_forbidden(spark):
    v = spark.createDataFrame([(i, [math.cos(i / 9), math.sin(i / 9)]) for i in range(10)], "id long, embedding array<float>")
    bad = spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "query_id long, candidate_id long")
    got = ranking.hard_negatives(v, v.filter("id = 0"), bad, 2).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == [3, 4]


def test_negatives_of_many_labels(spark, tmp_path):
    from lodequery.plans import vector_queries

    rows = [(i, i // 2, [math.cos(i / 999), math.sin(i / 999)]) for i in range(2400)]  # 1,200 labels
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_queries.hard_negative_pool(spark, str(tmp_path)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.floor(F.col("query_id") / 2) == F.floor(F.col("candidate_id") / 2)).alias("own")).collect()
    assert sorted(r.query_id for r in got) == list(range(0, 2400, 10)) and {(r.n, r.own) for r in got} == {(20, 0)}


def test_numbering_is_global(spark):
    df = spark.createDataFrame([(float(x % 50), x) for x in range(500)], "k double, id long").repartition(7)
    got = numbered(df, "k", "id").orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_text_functions(spark):
    df = spark.createDataFrame([("  Café IN  the  Park! ", "A dog, isn't it?")], "a string, b string")
    r = df.select(T.normalize_text(F.col("a")).alias("n"), T.words(F.col("b")).alias("w"), T.pieces(F.col("b")).alias("p"), T.shorten(F.col("b"), 0.4).alias("s"), T.punctuation_low(F.col("b")).alias("l"),
                  T.case_low(F.col("b")).alias("c"), T.ngrams(T.words(F.col("b")), 2).alias("g"), T.punctuation_count(F.col("b")).alias("k")).first()
    assert r.n == "café in the park!" and r.w == ["a", "dog", "isn't", "it"] and r.p[-1] == "?" and r.s == "A dog,"
    assert r.l == "A dog, isn't it" and r.c == "a dog, isn't it?" and r.g == ["a dog", "dog isn't", "isn't it"] and r.k == 3
    one = spark.createDataFrame([("alone",), ("",)], "t string").select(T.delete_words(F.col("t"), F.lit(3), 0.3).alias("d"), T.typo(F.col("t"), F.lit(0)).alias("y"), T.jaccard(F.array(), F.array(), 1.0).alias("j")).collect()
    assert [r.d for r in one] == ["alone", ""] and one[0].y == "laone" and one[1].y == "" and one[0].j == 1.0


def test_corruptions_by_hand(spark):
    one = lambda c, **cols: spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(c).first()[0]
    # of three words or more the first stays: seed 3 of 4 places begins at the last and goes round
    assert one(T.delete_words(F.col("t"), F.lit(3), None), t="a b c d e") == "a b c d"
    assert one(T.delete_words(F.col("t"), F.lit(3), 0.3), t="a b c d e") == "a c d"
    assert one(T.delete_words(F.col("t"), F.lit(1), None), t="a b") == "a" and one(T.delete_words(F.col("t"), F.lit(1), None), t=" a ") == " a "
    # places 0, 1, 2 of "abcd"; seed 17 swaps 2 and marks (1 + 1) % 3 = 2, which is taken; seed 0 marks 1, next to 0; seed 34 marks 0
    assert [one(T.typo(F.col("t"), F.lit(s), True), t="abcd") for s in (17, 0, 35)] == ["abdc", "bacd", "xbdc"]
    assert one(T.without_token(T.pieces(F.col("t")), F.lit(1)), t="( a b ) 5 % {x} !") == "(b) 5% {x}!"
    assert one(T.without_token(T.pieces(F.col("t")), F.lit(0)), t="a") == "[MASK]"
    import hashlib

    assert one(T.stable_seed(F.col("a"), F.col("b")), a="x", b="y") == int.from_bytes(hashlib.sha256(b"x\0y").digest()[:4], "big")
    kinds = ["dog", "Eating", "blue", "on", "the", "car", "x"]
    want = ["object_heuristic", "action_heuristic", "attribute_heuristic", "spatial_heuristic", "stopword_like_heuristic", "other_token", "other_token"]
    assert [one(T.token_category(F.col("t")), t=k) for k in kinds] == want


def test_caption_features_by_hand(spark):
    rows = [("a", "Two red dogs and a dog run on 3 boats"), ("b", "a man"), ("c", ""), ("d", "zzz yyy a man run on it"), ("e", "zzz yyy two red dogs run on it")]
    got = {r.caption_id: r for r in diagnostics.caption_features(spark.createDataFrame(rows, "caption_id string, text string")).collect()}
    a = got["a"]
    assert (a.word_count, a.number_terms, a.attribute_terms, a.action_terms, a.spatial_terms, a.object_terms) == (10, ["3", "two"], ["red"], ["run"], ["on"], ["dog"])
    assert not a.multiple_object_terms and a.rare_token_count == 4 and a.rare_token_fraction == 0.4  # and, dog, 3, boats
    assert got["b"].short_caption and got["b"].object_terms == ["man"] and got["c"].word_count == 0 and not got["c"].rare_token_present
    kinds = {(r.caption_id, r.category) for r in diagnostics.categories(diagnostics.caption_features(spark.createDataFrame([*rows, ("f", "it it it it")], "caption_id string, text string"))).collect()}
    assert {k for i, k in kinds if i == "a"} == {"object_confusion", "attribute_confusion", "action_confusion", "counting_quantity", "spatial_relation", "lexical_ambiguity"}
    assert {k for i, k in kinds if i == "c"} == {"short_underspecified_query"} and {k for i, k in kinds if i == "f"} == {"other_unclassified"}


def test_strata_by_hand(spark):
    c = spark.createDataFrame([("a", "Two dogs and a dog"), ("b", "the of"), ("c", "dog and cat"), ("d", " "), ("e", "dog")], "caption_id string, text string")
    train = spark.createDataFrame([("t", "dog " * 60 + "cat " * 5)], "caption_id string, text string")
    got = {r.caption_id: (r.length, r.rarity, r.complexity) for r in diagnostics.caption_strata(c, train).collect()}
    many, one = "multi_object_or_structured", "single_object_or_simple"
    assert got == {"a": ("short", "rare", many), "b": ("short", "unknown", one), "c": ("short", "medium", many), "e": ("short", "common", one)}


def test_margins_by_hand(spark):
    r = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.89, 2), (2, 10, 0.9, 1), (2, 11, 0.86, 2), (3, 10, 0.9, 1), (3, 11, 0.5, 2), (4, 10, 0.9, 1), (5, 11, 0.7, 1)], "query_id long, candidate_id long, score double, rank long")
    q = spark.createDataFrame([(i, 11, 1.0) for i in (1, 2, 3, 4, 5)], "query_id long, candidate_id long, gain double")
    got = {x.query_id: x.margin_class for x in diagnostics.margin_classes(r, q).collect()}
    assert got == {1: "near_miss", 2: "ambiguous_close", 3: "confident_wrong", 4: "target_not_in_retained_prefix", 5: "correct_top1"}


def test_line_findings_by_hand(spark):
    lines = ["-----BEGIN RSA PRIVATE KEY-----", "ghp-abcdefghijklmnop12", "client_secret: abcdefghijklmnop", "password=short", "token = abcdefghijklmnopqrst", "a /Users/me/x", "x/home/me"]
    got = {(r.line, r.finding) for r in diagnostics.line_findings(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()}
    assert got == {(1, "private_key"), (2, "token_prefix"), (3, "credential_assignment"), (6, "absolute_path")}


def test_histogram_cells_of_odd_sizes():
    red, blue = (255, 0, 0), (0, 0, 255)
    h = records.colour_histogram([[red], [red], [blue]], bins=1, grid=2)
    assert sum(h) == pytest.approx(1.0)
    # rows 0 and 1 are in the upper cells, row 2 in the lower ones
    two = records.colour_histogram([[red], [red], [blue]], bins=2, grid=2)
    upper, lower = two[6:12], two[18:24]
    assert upper[1] > 0 and upper[0] == 0 and lower[0] > 0 and lower[1] == 0


def test_profile_by_hand(spark):
    c = spark.createDataFrame([("1#0", 1, "A dog."), ("1#1", 1, "one two three four"), ("2#0", 2, " a   dog. "), ("2#1", 2, "")], "caption_id string, group_id long, text string")
    s = profile.caption_statistics(c, short=3, long=3).first()
    assert (s.captions, s.short, s.long, s.empty) == (4, 3, 1, 1)
    d = profile.duplicate_groups(c).collect()
    assert len(d) == 1 and d[0].cross_group
    g = spark.createDataFrame([(i,) for i in range(20)], "group_id long")
    split = profile.split_groups(g)
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 16, "validation": 2, "test": 2}
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, profile.split_groups(g.repartition(5)).collect()))
    leak = c.withColumn("split", F.when(F.col("caption_id") == "1#0", "train").otherwise("test"))
    assert {r.kind: r.n for r in profile.leakage(leak).collect()} == {"group": 1, "text": 1}
    assert profile.tier(g, 5).count() == 5 and profile.stratified_tier(split, 10).count() == 10


def test_manifest_rules(spark):
    rows = [("ok", "train", [("ok#0", "x")]), ("bad/id", "unknown", []), ("same", None, [("s#0", " ")]), ("same", None, [("s#0", "a"), ("s#0", "A ")]), (None, None, None)]
    df = spark.createDataFrame(rows, "group_id string, split string, captions array<struct<caption_id:string,text:string>>")
    found = {(r.group_id, r.rule) for r in profile.findings(df).collect()}
    assert {("bad/id", "invalid_id"), ("bad/id", "invalid_split"), ("bad/id", "no_captions"), ("same", "duplicate_id"), ("same", "empty_text"), ("same", "duplicate_text"), ("same", "duplicate_caption_id"), (None, "invalid_id")} <= found
    assert not [x for x in found if x[0] == "ok"]


def test_strata_pareto_disparity(spark):
    sizes = spark.createDataFrame([(100, 100, "near_square"), (200, 100, "wide_or_tall_extreme"), (100, 200, "wide_or_tall_extreme"), (120, 100, "moderate_aspect")], "w int, h int, want string")
    assert sizes.filter(diagnostics.aspect_strata(F.col("w"), F.col("h")) != F.col("want")).count() == 0
    p = spark.createDataFrame([("slow_best", 0.99, 10.0), ("fast_good", 0.98, 2.0), ("worse", 0.97, 5.0)], "name string, quality double, cost double")
    assert {r.name for r in diagnostics.pareto(p).collect()} == {"slow_best", "fast_good"}
    g = spark.createDataFrame([("f", "a", 30, 0.8), ("f", "b", 30, 0.6), ("f", "c", 3, 0.1)], "family string, label string, n long, top1 double")
    r = diagnostics.disparity(g, "top1").first()
    assert (r.best, r.worst, r.gap) == ("a", "b", pytest.approx(0.2))
    assert spark.range(1).select(diagnostics.severity(F.lit(None).cast("long"), F.lit(10))).first()[0] == "high"
    assert spark.range(1).select(diagnostics.severity(F.lit(None).cast("long"), F.lit(3))).first()[0] == "low"
    log = spark.createDataFrame([("read /home/me/x token=abc",)], "m string").select(diagnostics.redact_log(F.col("m"))).first()[0]
    assert log == "read [path] token=[redacted]"


PAGE = """<a href="http://h/123.jpg">x</a><ul><li> one  two </li><li>b</li></ul> Image Not Found <ul><li>c</li></ul><a href=456.jpg></a><ul><li>d</li></ul>"""


def test_caption_pages(spark):
    got = records.caption_pages(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).collect()
    assert [r.group_id for r in got] == ["123", "missing-source-image-000002", "456"]
    assert got[0].captions[0].caption_id == "123#0" and got[0].captions[0].text == "one two" and got[1].filename is None


def test_json_sources(spark, tmp_path):
    coco = tmp_path / "coco.json"
    coco.write_text('{"images":[{"id":2,"file_name":"b"},{"id":10,"file_name":"c"},{"id":1,"file_name":"a"}],"annotations":[{"id":11,"image_id":2,"caption":" x "},{"id":9,"image_id":2,"caption":"y"},{"id":3,"image_id":1,"caption":"z"}]}')
    got = records.coco_captions(spark, str(coco)).collect()
    assert [r.group_id for r in got] == ["1", "2", "10"] and got[1].captions[0].caption_id == "coco2017_val#11" and got[2].captions == []
    rank = tmp_path / "rank.json"
    rank.write_text('{"task":"t","system_id":"s","queries":[{"query_id":"q","candidate_ids":["a","b"],"scores":[2.0,1.0],"relevant_ids":["a"]}]}')
    assert [(r.candidate_id, r.rank, r.task) for r in records.rankings(spark, str(rank)).collect()] == [("a", 1, "t"), ("b", 2, "t")]
    composed = tmp_path / "composed.json"
    composed.write_text('[{"id":1,"reference_img_id":"007","relative_caption":"red","target_img_id":"8","gt_img_ids":["8","9"]},{"id":2,"reference_img_id":"8","relative_caption":" ","target_img_id":"5","gt_img_ids":["8","8"]}]')
    got = {r.id: r for r in records.composed_queries(spark, str(composed)).collect()}
    assert got[1].findings == [] and got[1].reference_img_id == "7"
    assert set(got[2].findings) == {"empty_modification", "reference_in_ground_truth", "target_not_in_ground_truth", "repeated_ground_truth"}


def test_manifest_and_index_guard(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    records.save_index(v, str(tmp_path / "i"), kind="exact")
    assert records.load_index(spark, str(tmp_path / "i"), kind="exact").count() == 2
    with pytest.raises(ValueError):
        records.load_index(spark, str(tmp_path / "i"), kind="ivf")
    v.limit(1).write.mode("overwrite").parquet(str(tmp_path / "i" / "records"))
    with pytest.raises(ValueError):
        records.read_manifest(spark, str(tmp_path / "i"))
    assert records.content_digest(v) == records.content_digest(v.repartition(3))


def test_images(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    red, blue = b"P6\n2 1\n255\n" + bytes([255, 0, 0] * 2), b"P6\n2 1\n255\n" + bytes([0, 0, 255] * 2)
    for name, data in (("a.png", png), ("r.ppm", red), ("b.ppm", blue), ("x.txt", b"not an image")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in records.images(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["x.txt"].width) == (640, 480, None)
    r, b = got["r.ppm"].histogram, got["b.ppm"].histogram
    assert len(r) == 120 and sum(r) == pytest.approx(1.0)
    pair = spark.createDataFrame([(r, r), (r, b)], "a array<double>, b array<double>").select(records.intersection(F.col("a"), F.col("b")).alias("i")).collect()
    assert pair[0].i == pytest.approx(1.0) and pair[1].i < 0.5
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x00\x00\x00"
    assert records.image_header(jpeg) == ("jpeg", 32, 16) and records.image_header(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4)


def test_settings():
    base = {"search": {"k": 10, "alpha": 0.5}, "name": "x"}
    assert records.settings("name = 'y'\n[search]\nalpha = 1", base) == {"search": {"k": 10, "alpha": 1}, "name": "y"}
    for text in ("other = 1", "[search]\nk = 'ten'", "search = 3", "[search]\nk = 0"):
        with pytest.raises(ValueError):
            records.settings(text, base, {"search.k": 1})


def test_protected_labels(spark):
    g = spark.createDataFrame([("Gender", 1), ("fine", 2)], "label string, AGE int")
    assert {tuple(r) for r in comparison.protected_labels(g, "label").collect()} == {("AGE", "column"), ("Gender", "label")}


def test_streams_match_batches(spark, tmp_path):
    from lodequery.streaming import events

    rows = spark.sql("select id as event_id, timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 37) as ts, id % 3 as user_id, 'k' as event_type, 1.0 as value from range(200)")
    rows.write.parquet(str(tmp_path / "e"))
    live = events.drain(events.counters(events.unique(events.read(spark, str(tmp_path / "e")))), "start", "event_type")
    assert sorted(live.collect()) == sorted(events.counters(rows).collect())
    assert events.sessions(rows).agg(F.sum("n")).first()[0] == 200


def test_index_searches_make_no_row_for_a_pair(spark):
    """Probed cells and shared keys by brute force, small chunks and ties included; candidates are compared inside blocks."""
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    x[100:110] = x[0]  # ties, cut by id
    v = spark.createDataFrame([(i, int(i % 7), x[i].tolist()) for i in range(500)], "id long, cell int, embedding array<float>").repartition(3)
    q = v.filter("id % 20 = 0")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    centres = np.array([unit[c::7].mean(0) for c in range(7)])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    want = set()
    for i in range(0, 500, 20):
        probed = np.argsort(-np.round(centres @ unit[i], 6), kind="stable")[:3]
        found = [(-round(float(s), 6), j) for j, s in enumerate(unit @ unit[i]) if j != i and j % 7 in probed]
        want |= {(i, j, rank) for rank, (_, j) in enumerate(sorted(found)[:10], 1)}
    got = ranking.cell_top_k(v, q, ranking.centroids(v, "cell"), 10, 3)
    assert {(r.query_id, r.candidate_id, r.rank) for r in got.collect()} == want
    for df in (got, ranking.sign_top_k(v, q, 10)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "query_id#" not in plan.split("MapInArrow", 1)[1].split("\n", 1)[1]


def test_corruptions_grow_with_the_text(spark):
    """A text's words, pairs of letters and seed are computed once, not once for each word or place: no lambda holds a digest."""
    import re

    for make in (lambda x, s: T.typo(x, s, high=True), lambda x, s: T.delete_words(x, s, 0.3), lambda x, s: T.delete_words(x, s, None)):
        df = spark.createDataFrame([("ab cé 漢字 𝒳𝒴 x",), ("",), ("a",)], "x string").select(make(F.col("x"), T.stable_seed(F.lit(5), F.col("x"))).alias("y"))
        assert len(re.findall(r"sha2\(", df._jdf.queryExecution().optimizedPlan().toString())) == 1
        assert [r.y for r in df.collect()][1:] == ["", "a"]


def test_sets_alike_matches_a_loop(spark):
    """Each query's find is over the bound and exact; equal ids, other groups, nulls and a likeness of just the bound don't count."""
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i % 3 if i % 11 else None, r.sample(words, r.choice([0, 1, 2, 5, 12, 30]))) for i in range(300)]
    rows += [(1000, 7, list("abcde")), (1001, 7, ["a"]), (1000, 7, list("abcde")), (1010, 8, list("abcd")), (1011, 8, ["a"]), (1020, 9, None), (None, 8, list("abcd"))]
    table = spark.createDataFrame(rows, "id long, group int, tokens array<string>").repartition(3)
    for slab in (700, 1 << 20):
        got = {x.query_id: x.likeness for x in comparison.sets_alike(table.filter("id % 10 = 0"), table, 0.2, slab).collect()}
        for i, g, t in rows:
            if i is None or i % 10:
                continue
            each = {len({*t} & {*u}) / len({*t} | {*u}) for j, h, u in rows if t and u and j is not None and j != i and g is not None and h == g}
            assert (i in got) == any(x > 0.2 for x in each), i
            assert i not in got or min(abs(got[i] - x) for x in each) < 1e-12
    assert 1000 not in got and got[1010] == 0.25


def test_lexical_dense_wins_lists_no_pairs_of_a_label(spark, tmp_path, monkeypatch):
    from lodequery.plans import comparison_queries
    from lodequery.plans import vector_queries as vq

    monkeypatch.delattr(vq, "qrels")  # a row for each pair of a label
    spark.createDataFrame([(i, i % 3, [1.0 * i, 1.0] * 16) for i in range(40)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"one two {i % 7} three" if i < 30 else None) for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = comparison_queries.lexical_dense_wins(spark, str(tmp_path))
    assert (df.first().queries, df.first().low_overlap) == (4, 1)
