"""Dataset profiling: caption statistics, duplicates, splits, tiers, validation.

captions (caption_id, group_id, text) unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexicons import STOPWORDS
from ..functions.text import normalize_text, punctuation_count, words

def numbers(c: Column, name: str) -> list[Column]:
    """Count, extremes, mean, median and outer deciles, interpolated."""
    return [
        F.count(c).alias(f"{name}_count"),
        F.min(c).alias(f"{name}_min"),
        F.max(c).alias(f"{name}_max"),
        F.round(F.avg(c), 6).alias(f"{name}_mean"),
        F.round(F.percentile(c, 0.5), 6).alias(f"{name}_median"),
        F.round(F.percentile(c, 0.1), 6).alias(f"{name}_p10"),
        F.round(F.percentile(c, 0.9), 6).alias(f"{name}_p90"),
    ]


def measured(captions: DataFrame) -> DataFrame:
    tokens = words(F.coalesce(F.col("text"), F.lit("")))
    return captions.withColumn("tokens", tokens).withColumn("n_words", F.size("tokens").cast("long")).withColumn("norm", normalize_text(F.coalesce("text", F.lit(""))))


def caption_statistics(captions: DataFrame, short: int = 3, long: int = 30) -> DataFrame:
    """One row: flags and sizes of all captions."""
    m = measured(captions)
    n = F.col("n_words")
    return m.agg(
        *numbers(n, "words"),
        F.count(F.lit(1)).alias("captions"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
        F.count_if(n <= 1).alias("near_empty"),
        F.count_if(n < short).alias("short"),
        F.count_if(n > long).alias("long"),
        F.count_if(F.coalesce("text", F.lit("")).rlike("[^\\x20-\\x7E]")).alias("unusual"),
        F.sum(punctuation_count(F.coalesce("text", F.lit("")))).alias("punctuation"),
    )


def token_frequencies(captions: DataFrame) -> DataFrame:
    """(token, n)."""
    return captions.select(F.explode(words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_statistics(captions: DataFrame) -> DataFrame:
    f = token_frequencies(captions)
    stop = F.col("token").isin(STOPWORDS)
    digits = F.col("token").rlike("^[0-9]+$")
    sums = f.agg(
        F.sum("n").alias("tokens"),
        F.count(F.lit(1)).alias("vocabulary"),
        F.count_if(F.col("n") == 1).alias("hapaxes"),
        F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("stopwords"),
        F.sum(F.when(digits, F.col("n")).otherwise(0)).alias("numeric"),
    )
    return sums.withColumn("type_token_ratio", F.round(F.col("vocabulary") / F.col("tokens"), 6)).withColumn("stopword_share", F.round(F.col("stopwords") / F.col("tokens"), 6))


def top_tokens(captions: DataFrame, k: int = 50) -> DataFrame:
    return token_frequencies(captions).orderBy(F.desc("n"), "token").limit(k)


def frequency_of_frequency(captions: DataFrame) -> DataFrame:
    return token_frequencies(captions).groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))


def length_histogram(captions: DataFrame, overflow: int = 40) -> DataFrame:
    """Captions by number of words; all from `overflow` on are one bin."""
    b = F.when(F.col("n_words") >= overflow, F.lit(f"{overflow}+")).otherwise(F.col("n_words").cast("string"))
    return measured(captions).groupBy(b.alias("words")).agg(F.count(F.lit(1)).alias("captions"))


def length_distribution(captions: DataFrame, by: str) -> DataFrame:
    return measured(captions).groupBy(by).agg(*numbers(F.col("n_words"), "words"))


def duplicate_groups(captions: DataFrame) -> DataFrame:
    """Normalised texts that several captions share; across groups, and splits if there is a `split`."""
    m = measured(captions).filter("norm <> ''")
    split = [F.count_distinct("split").alias("splits")] if "split" in captions.columns else []
    per = m.groupBy("norm").agg(F.count(F.lit(1)).alias("captions"), F.count_distinct("group_id").alias("groups"), F.min("caption_id").alias("first_caption"), *split)
    out = per.filter("captions > 1").withColumn("cross_group", F.col("groups") > 1)
    return out.withColumn("cross_split", F.col("splits") > 1) if split else out


def hash_order(c: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), c.cast("string")), 256)


def split_groups(groups: DataFrame, seed: int = 42, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """(group_id, split): whole groups by hash order, floor(n * share) each and the rest for testing; from three groups on none is empty.

    A group's place is counted from hash ranges, so no task orders all groups.
    """
    from .ordering import numbered

    ids = groups.select("group_id").distinct().withColumn("_h", hash_order(F.col("group_id"), seed))
    # the first 12 hex digits order all but ties, the whole hash orders these
    placed = numbered(ids.withColumn("_k", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double")), "_k", "_h")
    total = F.broadcast(ids.agg(F.count(F.lit(1)).alias("_n")))
    n = F.col("_n")
    n_train, n_validation = F.greatest(F.lit(1), F.floor(n * train)), F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * validation))).otherwise(F.floor(n * validation))
    n_train = F.when((n >= 3) & (n_train + n_validation >= n), n - n_validation - 1).otherwise(n_train)
    split = F.when(F.col("place") < n_train, "train").when(F.col("place") < n_train + n_validation, "validation").otherwise("test")
    return placed.crossJoin(total).select("group_id", split.alias("split"))


def tier(groups: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """The `size` groups with the smallest hashes."""
    return groups.select("group_id").distinct().orderBy(hash_order(F.col("group_id"), seed), "group_id").limit(size)


def stratified_tier(split: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """About `size` groups: from each split its rounded share (half to even), the remainder from train."""
    counts = split.groupBy("split").agg(F.count(F.lit(1)).alias("n_s"))
    quota = counts.withColumn("n", F.sum("n_s").over(W.partitionBy())).withColumn("q", F.bround(F.lit(float(size)) * F.col("n_s") / F.col("n")).cast("long"))
    rest = F.lit(size) - F.sum("q").over(W.partitionBy())
    quota = quota.withColumn("q", F.when(F.col("split") == "train", F.col("q") + rest).otherwise(F.col("q"))).select("split", "q")
    order = W.partitionBy("split").orderBy(hash_order(F.col("group_id"), seed), "group_id")
    return split.withColumn("rn", F.row_number().over(order)).join(F.broadcast(quota), "split").filter("rn <= q").select("group_id", "split")


def leakage(captions: DataFrame) -> DataFrame:
    """Groups that lie in several splits are critical, texts benign: (kind, severity, n)."""
    g = captions.groupBy("group_id").agg(F.count_distinct("split").alias("s")).filter("s > 1").agg(F.count(F.lit(1)).alias("n"))
    t = measured(captions).filter("norm <> ''").groupBy("norm").agg(F.count_distinct("split").alias("s")).filter("s > 1").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.lit("group").alias("kind"), F.lit("CRITICAL").alias("severity"), "n").unionByName(t.select(F.lit("text").alias("kind"), F.lit("benign").alias("severity"), "n"))


def findings(records: DataFrame) -> DataFrame:
    """(group_id, rule) of records (group_id string, split, captions array<struct<caption_id, text>>) that break a rule."""
    c = F.coalesce(F.col("captions"), F.array().cast("array<struct<caption_id:string,text:string>>"))
    rules = {
        "no_captions": F.size(c) == 0,
        "invalid_id": F.col("group_id").isNull() | F.col("group_id").rlike(r"[/\\]") | (F.trim(F.col("group_id")) == ""),
        "invalid_split": F.col("split").isNotNull() & ~F.col("split").isin("train", "validation", "test"),
        "duplicate_caption_id": F.size(F.array_distinct(c["caption_id"])) < F.size(c),
        "empty_caption_id": F.exists(c, lambda x: F.coalesce(F.trim(x["caption_id"]), F.lit("")) == ""),
        "empty_text": F.exists(c, lambda x: F.coalesce(F.trim(x["text"]), F.lit("")) == ""),
        "duplicate_text": F.size(F.array_distinct(F.transform(c, lambda x: normalize_text(F.coalesce(x["text"], F.lit("")))))) < F.size(c),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    single = records.select("group_id", F.explode(found).alias("rule"))
    twice = records.groupBy("group_id").count().filter("count > 1").select("group_id", F.lit("duplicate_id").alias("rule"))
    return single.unionByName(twice)


def dataset_statistics(captions: DataFrame) -> DataFrame:
    """By split: groups, captions, captions a group."""
    per = captions.groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("captions"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def alignment(groups: DataFrame, captions: DataFrame) -> DataFrame:
    """One row: groups without captions, captions without a group, caption ids that repeat."""
    bare = groups.join(captions.select("group_id").distinct(), "group_id", "left_anti").agg(F.count(F.lit(1)).alias("groups_without_captions"))
    lost = captions.join(groups.select("group_id").distinct(), "group_id", "left_anti").agg(F.count(F.lit(1)).alias("captions_without_group"))
    twice = captions.groupBy("caption_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("repeated_caption_ids"))
    return bare.crossJoin(F.broadcast(lost)).crossJoin(F.broadcast(twice))
