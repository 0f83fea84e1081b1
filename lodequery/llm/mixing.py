"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size.
Its whole part is taken outright; the fractional parts are rounded against one another:
two fractional probabilities meet, mass moves at random from one to the other until one of
them is 0 or 1, and what is left meets the next. That keeps each document's expectation and
all but the last unit of every group's sum. Groups are blocks of documents of like size (so
that mass moves between like sizes and the words taken stay near the target); each leaves one
fractional residual, and the residuals are combined in wider blocks, level by level, in a tree
of fixed fan-in until one is left for each source, which is rounded alone.

Only ids and sizes travel; all steps are DataFrame functions, and no block grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, text_of, unit

FAN_IN = 64
#: Size classes in an octave at the lowest level of the tree.
FINE = 8
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) for a table of (source, size).

    Sources are ordered by code point, null last, and take the weights in turn. Together the
    targets make up the sum of all sizes; none exceeds cap times its source's size, and what is
    cut off goes to the others by weight until none is above. That fixed point is
    min(cap * size, level * weight), so one pass over the sources in the order of cap * size /
    weight finds it. The windows hold one row a source. No rows give no rows; sources without
    words have the target 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = W.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (index + 1).cast("int"))
    caps = sums.withColumn("weight", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    every = W.partitionBy()
    before = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = caps.withColumn("level", level)
    # the first source whose cap isn't reached sets the level for itself and all after it
    reach = F.col("cap") / F.col("weight")
    ranked = ranked.withColumn("water", F.min_by(F.col("level"), F.when(reach >= F.col("level"), F.struct(reach, F.col("source").isNull(), F.col("source")))).over(every))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return ranked.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _settle(items: Column, seed: int) -> Column:
    """Sequential pivotal steps over an array of (size, hash, p, keep): every item as (at, unit, p).

    Items whose p is 0 settle at once. At most one item, the last that carries mass, keeps a
    null unit and its p; all others have taken 0 or 1. Choices hang on hashes and the seed alone.
    """
    one = "struct<at:int,unit:int,p:double>"
    step = f"struct<carry:{one},done:array<{one}>>"
    hash_at = lambda at: F.element_at(items, at + 1)["hash"]

    def meet(acc, at):
        a, p = acc["carry"], F.element_at(items, at + 1)["p"]
        total = a["p"] + p
        u = unit(hash_at(a["at"]), hash_at(at), F.lit(seed))
        low = total < 1.0
        # below 1 one row gets all the mass and the other 0; from 1 on one gets 1 and the other the rest
        a_goes_on = F.when(low, u * total < a["p"]).otherwise(u * (2.0 - total) < 1.0 - a["p"])
        out = F.struct(F.when(a_goes_on, at).otherwise(a["at"]), F.when(low, F.lit(0)).otherwise(F.lit(1)), F.lit(0.0)).cast(one)
        left = F.struct(F.when(a_goes_on, a["at"]).otherwise(at), F.lit(None).cast("int"), F.when(low, total).otherwise(total - 1.0)).cast(one)
        whole = F.struct(at, F.lit(0), F.lit(0.0)).cast(one)
        first = F.struct(at, F.lit(None).cast("int"), p).cast(one)
        add = lambda x: F.concat(acc["done"], F.array(x))
        return (
            F.when(p <= 0.0, F.struct(a.alias("carry"), add(whole).alias("done")))
            .when(a.isNull(), F.struct(first.alias("carry"), acc["done"].alias("done")))
            .otherwise(F.struct(left.alias("carry"), add(out).alias("done")))
            .cast(step)
        )

    start = F.struct(F.lit(None).cast(one), F.array().cast(f"array<{one}>")).cast(step)
    return F.aggregate(
        F.sequence(F.lit(0), F.size(items) - 1), start, meet, lambda acc: F.when(acc["carry"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["carry"])))
    )


def _level(rows: DataFrame, group: Column, fan_in: int, seed: int) -> DataFrame:
    """One level of the tree: rows (source, size, hash, p, keep) with unit, null where it's carried on."""
    rows = rows.withColumn("class", group)
    counts = rows.groupBy(F.col("source").alias("_source"), F.col("class").alias("_class")).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(counts, rows["source"].eqNullSafe(counts["_source"]) & (rows["class"] == counts["_class"]))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("hash", F.lit(seed)), F.ceil(F.col("_n") / fan_in).cast("long")))
    item = F.struct("size", "hash", "p", "keep")
    blocks = rows.groupBy("source", "class", "block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    settled = blocks.select("source", "items", F.explode(_settle(F.col("items"), seed)).alias("x"))
    got = F.element_at("items", F.col("x.at") + 1)
    return settled.select("source", got["size"].alias("size"), got["hash"].alias("hash"), F.col("x.p").alias("p"), got["keep"].alias("keep"), F.col("x.unit").alias("unit"))


def pivotal_copies(sized: DataFrame, seed: int = 7, weights=WEIGHTS, cap: float = CAP, fan_in: int = FAN_IN, carry: tuple[str, ...] = ()) -> DataFrame:
    """sized (doc_id, source, size and the carried columns) with source_size, target, copies and taken (size * copies).

    A source's rows are spread over blocks of about fan_in rows by size class and a hash, so a
    source with a third of all rows is many blocks of the usual size. Repeated rows, equal in all
    these columns, share one probability, the sum of theirs: its whole part is taken outright and
    the rest rounded, and the copies are dealt evenly to them; so a row that is repeated very
    often is one row of a block. Null sizes count as 0; no rows give no rows. Given the rows and
    the seed the result is the same in any run.
    """
    sized = materialise(sized.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), *carry), "mix-sizes")
    targets = source_targets(sized, weights, cap).withColumnRenamed("source", "_source")
    sized = sized.groupBy("doc_id", "source", "size", *carry).agg(F.count(F.lit(1)).alias("times"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    mass = rate * F.col("times")
    whole = F.floor(mass).cast("long")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["_source"])).select(
        "source",
        "size",
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"), F.lit(seed), *carry).alias("hash"),
        (mass - whole).alias("p"),
        F.struct("doc_id", "source_size", "target", "times", whole.alias("whole"), *carry).alias("keep"),
    )
    octave = F.log2(F.col("size") + 1.0)
    groups = [F.floor(octave * FINE).cast("int"), F.floor(octave).cast("int")]
    done, level = [], 0
    while True:
        wide = level >= len(groups)
        out = materialise(_level(rows, F.lit(0) if wide else groups[level], fan_in, seed + level), "mix-level")
        done.append(out.filter(F.col("unit").isNotNull()))
        left = out.filter(F.col("unit").isNull()).drop("unit")
        most = left.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        rows, level = left, level + 1
    done.append(left.withColumn("unit", (unit(F.col("hash"), F.lit(seed)) < F.col("p")).cast("int")))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    flat = every.select("keep.doc_id", "source", "size", "keep.source_size", "keep.target", (F.col("keep.whole") + F.col("unit")).alias("_copies"), F.col("keep.times").alias("_times"), *[F.col(f"keep.{c}").alias(c) for c in carry])
    # one row of each that is repeated, in two steps, so that no array grows with the repeats
    once, often = flat.filter("_times = 1").withColumn("copies", F.col("_copies")), flat.filter("_times > 1")
    often = often.withColumn("_from", F.explode(F.expr("sequence(1L, _times, 10000L)")))
    often = often.withColumn("_of", F.explode(F.expr("sequence(_from, least(_times, _from + 9999))")))
    # each of the equal rows gets its even share, and the first of them one more
    share = F.floor(F.col("_copies") / F.col("_times")).cast("long")
    often = often.withColumn("copies", share + F.when(F.col("_of") <= F.col("_copies") - share * F.col("_times"), 1).otherwise(0)).drop("_from", "_of")
    each = once.unionByName(often)
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), F.xxhash64("doc_id", "source", "text").alias("__mix_key"))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, copies, taken)."""
    return pivotal_copies(_sized(docs), seed, carry=("__mix_key",)).drop("__mix_key")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """documents as often as the mix takes them, with their own columns.

    Rows are found again by a hash of id, source and text; rows equal in these are interchangeable,
    so their copies are added up and the first such row is repeated that often.
    """
    columns = docs.columns
    tagged = docs.withColumn("__mix_key", F.xxhash64("doc_id", "source", "text"))
    copies = pivotal_copies(_sized(docs), seed, carry=("__mix_key",)).groupBy("__mix_key").agg(F.sum("copies").cast("int").alias("__mix_copies"))
    rows = tagged.dropDuplicates(["__mix_key"]).join(copies, "__mix_key").filter("__mix_copies > 0")
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select(*columns)
