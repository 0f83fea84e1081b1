"""Failure analysis, strata, disparity, efficiency and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicons
from ..functions.text import jaccard, normalize_text, pieces, strata_words, taxonomy_words, token_category, without_token

def _in(tokens: str, lexicon: list[str]) -> Column:
    """The distinct tokens of a lexicon, sorted."""
    return F.array_sort(F.array_distinct(F.array_intersect(tokens, F.array(*[F.lit(w) for w in lexicon]))))


FLAGS = ["has_number_or_count_term", "has_attribute_term", "has_action_term", "has_spatial_term", "has_object_term", "multiple_object_terms", "short_caption", "rare_token_present"]


def caption_features(captions: DataFrame, rare_at_most: int = 1) -> DataFrame:
    """Sizes, rare tokens (by their count in these captions), terms of each lexicon and flags of every caption; an empty one has none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = captions.select("caption_id", F.length(text).cast("long").alias("character_count"), taxonomy_words(text).alias("tokens"))
    each = t.select("caption_id", F.explode("tokens").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = each.join(counts.filter(F.col("n") <= rare_at_most), "token").groupBy("caption_id").agg(F.count(F.lit(1)).alias("rare"))
    n = F.size("tokens").cast("long")
    digits = F.filter("tokens", lambda w: w.rlike("^[0-9]+$"))
    both = F.array_sort(F.array_union(_in("tokens", lexicons.NUMBER_WORDS), digits))
    terms = {"number": both} | {k: _in("tokens", getattr(lexicons, f"{k.upper()}_WORDS")) for k in ("attribute", "action", "spatial", "object")}
    rows = t.join(rare, "caption_id", "left").select(
        "caption_id",
        n.alias("word_count"),
        "character_count",
        F.size(F.array_distinct("tokens")).cast("long").alias("unique_token_count"),
        F.coalesce("rare", F.lit(0)).cast("long").alias("rare_token_count"),
        *[c.alias(f"{k}_terms") for k, c in terms.items()],
    )
    has = lambda k: F.size(f"{k}_terms") > 0
    flags = [has("number"), has("attribute"), has("action"), has("spatial"), has("object"), F.size("object_terms") >= 2, F.col("word_count") <= 3, F.col("rare_token_count") > 0]
    rows = rows.withColumn("rare_token_fraction", F.round(F.col("rare_token_count") / F.greatest(F.col("word_count"), F.lit(1)), 6))
    return rows.withColumns(dict(zip(FLAGS, flags, strict=True)))


#: The category that a flag suggests.
CATEGORIES = {
    "has_object_term": "object_confusion",
    "has_attribute_term": "attribute_confusion",
    "has_action_term": "action_confusion",
    "has_number_or_count_term": "counting_quantity",
    "has_spatial_term": "spatial_relation",
    "short_caption": "short_underspecified_query",
    "multiple_object_terms": "multiple_object_confusion",
    "rare_token_present": "lexical_ambiguity",
}


def categories(features: DataFrame) -> DataFrame:
    """(caption_id, category, label_source) of every flag that holds; without any, other_unclassified by rule."""
    found = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for flag, name in CATEGORIES.items()]))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_unclassified")))
    source = F.when(F.col("category") == "other_unclassified", "mechanical").otherwise("heuristic")
    return features.select("caption_id", F.explode(found).alias("category")).withColumn("label_source", source)


def caption_set_features(captions: DataFrame) -> DataFrame:
    """Per group: captions, extremes and mean of their words, and their mean pairwise likeness (0 for a single one)."""
    n = captions.select("group_id", F.size(taxonomy_words(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("n"))
    sizes = n.groupBy("group_id").agg(F.min("n").alias("min_words"), F.max("n").alias("max_words"), F.round(F.avg("n"), 6).alias("mean_words"))
    alike = pairwise_jaccard(captions).select("group_id", "captions", F.coalesce("mean_jaccard", F.lit(0.0)).alias("mean_jaccard"))
    return sizes.join(alike, "group_id")


def set_categories(sets: DataFrame) -> DataFrame:
    """(group_id, category, label_source): several captions make relevance ambiguous, unlike ones the scene."""
    found = F.array_compact(
        F.array(
            F.when(F.col("captions") > 1, F.struct(F.lit("annotation_relevance_ambiguity").alias("category"), F.lit("mechanical_context").alias("label_source"))),
            F.when(F.col("mean_jaccard") < 0.15, F.struct(F.lit("scene_context_confusion").alias("category"), F.lit("heuristic").alias("label_source"))),
        )
    )
    none = F.array(F.struct(F.lit("other_unclassified").alias("category"), F.lit("mechanical").alias("label_source")))
    return sets.select("group_id", F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("c")).select("group_id", "c.*")


def severity(first_rank: Column, returned: Column) -> Column:
    """By the first relevant rank, or where there is none by one past what was returned."""
    at = F.coalesce(first_rank, returned + 1)
    return F.when(at == 1, "success").when(at <= 5, "low").when(at <= 10, "medium").otherwise("high")


def failures(per_query: DataFrame) -> DataFrame:
    """per_query (query_id, first_rank, returned): a relevant rank that is missing counts as one past what that query returned."""
    at = F.coalesce(F.col("first_rank"), F.col("returned") + 1)
    return per_query.select(
        "query_id",
        "first_rank",
        (at != 1).alias("top1_failure"),
        (at > 5).alias("top5_failure"),
        (at > 10).alias("severe_failure"),
        severity(F.col("first_rank"), F.col("returned")).alias("severity"),
    )


FAILURES = ["top1_failure", "top5_failure", "severe_failure"]


def failure_summary(f: DataFrame, by: list[str]) -> DataFrame:
    """Failure counts and rates, severities and margin classes; f has failures' columns, margin_class and by."""
    return f.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.count_if(F.col(c)).alias(c) for c in FAILURES],
        *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in FAILURES],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in ("success", "low", "medium", "high")],
        *[F.count_if(F.col("margin_class") == m).alias(m) for m in MARGINS],
    )


def failures_by_feature(f: DataFrame, features: DataFrame) -> DataFrame:
    """(feature, value, queries, failures and their rates) by length of the caption and by the flags that hold; f has caption_id."""
    n = F.col("word_count")
    length = F.when(n <= 3, "short_0_3").when(n <= 8, "medium_4_8").otherwise("long_9_plus")
    flags = ["has_number_or_count_term", "has_attribute_term", "has_action_term", "has_spatial_term", "multiple_object_terms", "rare_token_present"]
    entry = lambda feature, value: F.struct(F.lit(feature).alias("feature"), value.alias("value"))
    entries = F.array_compact(F.array(entry("caption_length_bin", length), *[F.when(F.col(x), entry(x, F.lit("true"))) for x in flags]))
    long = f.join(features, "caption_id").select(*FAILURES, F.explode(entries).alias("e"))
    rates = [F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in FAILURES]
    return long.groupBy("e.feature", "e.value").agg(F.count(F.lit(1)).alias("queries"), *[F.count_if(F.col(c)).alias(c) for c in FAILURES], *rates)


MARGINS = ["correct_top1", "near_miss", "ambiguous_close", "confident_wrong", "target_not_in_retained_prefix"]


def margin_classes(rankings: DataFrame, qrels: DataFrame, near: float = 0.02, close: float = 0.05) -> DataFrame:
    """Per query: the first candidate's score less the best relevant one, and its class; a relevant first candidate is correct."""
    from .metrics import with_relevance

    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    per = with_relevance(rankings, qrels).groupBy("query_id").agg(first("score").alias("top"), first("hit").alias("right"), F.max(F.when(F.col("hit") == 1, F.col("score"))).alias("rel"))
    margin = F.round(F.col("top") - F.col("rel"), 6)
    wrong = F.when(margin <= near, "near_miss").when(margin <= close, "ambiguous_close").otherwise("confident_wrong")
    kind = F.when(F.col("rel").isNull(), "target_not_in_retained_prefix").when(F.col("right") == 1, "correct_top1").otherwise(wrong)
    return per.select("query_id", margin.alias("margin"), kind.alias("margin_class"))


def confidence(rankings: DataFrame) -> DataFrame:
    """Per query: best score, margin to the second, softmax share of the first, and 1 - normalised entropy."""
    e = rankings.withColumn("e", F.exp("score"))
    per = e.groupBy("query_id").agg(
        F.max("score").alias("top1"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"),
        F.max(F.when(F.col("rank") == 1, F.col("e"))).alias("e1"),
        F.sum("e").alias("z"),
        F.sum(F.col("e") * F.col("score")).alias("es"),
        F.count(F.lit(1)).alias("n"),
    )
    entropy = F.log("z") - F.col("es") / F.col("z")
    return per.select(
        "query_id",
        F.round("top1", 6).alias("top1"),
        F.round(F.col("s1") - F.col("s2"), 6).alias("margin"),
        F.round(F.col("e1") / F.col("z"), 6).alias("softmax_top1"),
        F.round(F.when(F.col("n") > 1, 1.0 - entropy / F.log("n")), 6).alias("certainty"),
    )


def caption_strata(captions: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """(caption_id, words, length, content_words, rarest, rarity, objects, complexity) of captions that have words or marks.

    rarest is the least count, among the tokens of the training captions, of the words that aren't stopwords.
    """
    kept = captions.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    t = kept.select("caption_id", strata_words(F.col("text")).alias("tokens"))
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    t = t.withColumn("content", F.filter("tokens", lambda w: ~w.isin(lexicons.STRATA_STOPWORDS)))
    source = t if training is None else training.select(strata_words(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    counts = source.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = t.select("caption_id", F.explode("content").alias("token"))
    rarest = each.join(counts, "token", "left").groupBy("caption_id").agg(F.min(F.coalesce("n", F.lit(0))).alias("rarest"))
    n, least = F.size("tokens"), F.col("rarest")
    objects = F.size(F.array_intersect("content", listed(lexicons.STRATA_OBJECTS)))
    counted = F.arrays_overlap("content", listed(lexicons.STRATA_NUMBERS))
    many = (objects >= 2) | ((objects > 0) & (F.array_contains("tokens", "and") | counted))
    return t.join(rarest, "caption_id", "left").select(
        "caption_id",
        n.cast("long").alias("words"),
        F.when(n <= 7, "short").when(n <= 14, "medium").otherwise("long").alias("length"),
        F.size("content").cast("long").alias("content_words"),
        "rarest",
        F.when(least.isNull(), "unknown").when(least <= 4, "rare").when(least <= 49, "medium").otherwise("common").alias("rarity"),
        objects.cast("long").alias("objects"),
        F.when(many, "multi_object_or_structured").otherwise("single_object_or_simple").alias("complexity"),
    )


def aspect_strata(width: Column, height: Column) -> Column:
    """Null for sizes that aren't positive."""
    r = width / height
    kind = F.when((r <= 0.75) | (r >= 4.0 / 3.0), "wide_or_tall_extreme").when((r >= 0.9) & (r <= 1.1), "near_square").otherwise("moderate_aspect")
    return F.when((width > 0) & (height > 0), kind)


def group_performance(rows: DataFrame, families: list[str], measures: list[str]) -> DataFrame:
    """(family, label, n, mean of each measure) for every family column: grouping sets over its labels."""
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("string").alias("label")) for f in families])).alias("g")
    long = rows.select(*measures, entries)
    return long.groupBy("g.family", "g.label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(m).cast("double")), 6).alias(m) for m in measures])


def disparity(groups: DataFrame, measure: str, least: int = 20) -> DataFrame:
    """By family, among labels with enough rows: best and worst label and the gap between them."""
    ok = groups.filter(F.col("n") >= least)
    best = F.max_by("label", F.struct(F.col(measure), F.col("label"))).alias("best")
    worst = F.min_by("label", F.struct(F.col(measure), F.col("label"))).alias("worst")
    return ok.groupBy("family").agg(best, worst, F.round(F.max(measure) - F.min(measure), 6).alias("gap"), F.count(F.lit(1)).alias("labels"))


def pareto(rows: DataFrame, quality: str = "quality", cost: str = "cost") -> DataFrame:
    """Rows that no other row matches in quality and cost and beats in one.

    A running maximum over the distinct costs decides, so rows are never paired.
    """
    best = rows.groupBy(cost).agg(F.max(quality).alias("_q"))
    cheaper = W.orderBy(cost).rowsBetween(W.unboundedPreceding, -1)  # distinct costs
    front = best.withColumn("_before", F.max("_q").over(cheaper)).filter(F.col("_before").isNull() | (F.col("_q") > F.col("_before"))).drop("_before")
    return rows.join(front, cost).filter(F.col(quality) == F.col("_q")).drop("_q")


def latency(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.percentile(value, 0.5), 6).alias("median"), F.round(F.percentile(value, 0.95), 6).alias("p95")
    )


def occlusions(captions: DataFrame) -> DataFrame:
    """(caption_id, at, token, category, text): each caption without its at-th token."""
    t = captions.select("caption_id", pieces(F.coalesce(F.col("text"), F.lit(""))).alias("tokens"))
    each = t.select("caption_id", "tokens", F.posexplode("tokens").alias("at", "token"))
    return each.select("caption_id", F.col("at").cast("long").alias("at"), "token", token_category(F.col("token")).alias("category"), without_token(F.col("tokens"), F.col("at")).alias("text"))


def pairwise_jaccard(captions: DataFrame) -> DataFrame:
    """Mean likeness of all pairs of captions of a group, from the group's own array. Groups are as small as a conversation."""
    t = captions.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("caption_id", F.array_distinct(taxonomy_words(F.coalesce(F.col("text"), F.lit("")))).alias("w")))).alias("c"))
    pairs = F.flatten(F.transform("c", lambda a, i: F.transform(F.filter("c", lambda b, j: j > i), lambda b: jaccard(a["w"], b["w"], 0.0))))
    n = F.size(pairs)
    mean = F.when(n > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)
    return t.select("group_id", F.size("c").cast("long").alias("captions"), F.round(mean, 6).alias("mean_jaccard"))


#: What the audits look for in lines of text.
SECRET_LINES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "token_prefix": r"\b(?:sk|ghp|xox[baprs])-[A-Za-z0-9_-]{16,}\b",
    "credential_assignment": r"(?i)\b(?:api[_-]?key|access[_-]?token|client[_-]?secret|password)\s*[:=]\s*[\"']?[A-Za-z0-9_./+=-]{16,}",
}
HOME_PATHS = r"(?<![A-Za-z0-9])/(?:Users|Volumes|home)/[^\s`\"')]+"


def line_findings(docs: DataFrame) -> DataFrame:
    """(doc_id, line, finding): lines, from 1, with a credential or a path of one machine."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\r\n|\n|\r")).alias("at", "content"))
    rules = SECRET_LINES | {"absolute_path": HOME_PATHS}
    found = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line"), F.explode(found).alias("finding"))


def redact_log(message: Column) -> Column:
    """Paths of one machine and credentials masked."""
    masked = F.regexp_replace(message, HOME_PATHS, "[path]")
    return F.regexp_replace(masked, r"(?i)(token|password|secret|api[_-]?key)\s*[:=]\s*[^\s]+", "$1=[redacted]")


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, target) of relative Markdown links."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"\]\(([^)#\s]+)"), F.lit(1))
    return docs.select("doc_id", F.explode(found).alias("target")).filter(~F.col("target").rlike("^[a-z]+:"))


def duplicates_by_digest(rows: DataFrame, content: str, key: str) -> DataFrame:
    """(digest, n, first): contents that several rows share."""
    d = rows.select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(key).alias("k"))
    return d.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).filter("n > 1")


def text_key(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)
