"""Lexical retrieval over term tables: TF-IDF and BM25.

Fitted indexes are ordinary tables: postings (doc_id, term, ...) and one row of corpus constants.
A search joins the queries' terms with the postings; candidates without a common term never appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngram_range, words
from .ranking import rank_within


def terms(docs: DataFrame, text: str = "text", low: int = 1, high: int = 1) -> DataFrame:
    """(doc_id, term, tf). Null texts have no terms."""
    grams = ngram_range(words(F.col(text)), low, high) if (low, high) != (1, 1) else words(F.col(text))
    return docs.select("doc_id", F.explode(grams).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_index(docs: DataFrame, min_df: int = 1, max_df: float | int = 1.0, sublinear: bool = True, low: int = 1, high: int = 1) -> tuple[DataFrame, DataFrame]:
    """(postings (doc_id, term, weight), terms (term, df, idf)): L2-normalised rows.

    max_df as a float is a share of the documents, rounded down and at least 1; as an int a count.
    idf = ln((1 + N) / (1 + df)) + 1; tf = 1 + ln(tf) if sublinear.
    """
    counts = terms(docs, low=low, high=high)
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))
    most = F.greatest(F.lit(1), F.floor(F.lit(float(max_df)) * F.col("n"))) if isinstance(max_df, float) else F.lit(max_df)
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).filter((F.col("df") >= min_df) & (F.col("df") <= most))
    vocabulary = frequency.select("term", "df", idf.alias("idf"))
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = counts.join(vocabulary, "term").select("doc_id", "term", (tf * F.col("idf")).alias("w"))
    length = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, "doc_id").select("doc_id", "term", (F.col("w") / F.col("l")).alias("weight")), vocabulary


def tfidf_search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, sublinear: bool = True) -> DataFrame:
    """queries (doc_id as query id, text): cosine of the weighted terms, zero scores left out."""
    postings, vocabulary = index
    tf = 1.0 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = terms(queries).join(vocabulary, "term").select(F.col("doc_id").alias("query_id"), "term", (tf * F.col("idf")).alias("w"))
    length = raw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    q = raw.join(length, "query_id").select("query_id", "term", (F.col("w") / F.col("l")).alias("qw"))
    return _ranked(q.join(postings, "term"), F.col("qw") * F.col("weight"), k)


def bm25_index(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings (doc_id, term, tf, dl), terms (term, df), constants (n, avgdl) of one row)."""
    counts = terms(docs)
    lengths = docs.select("doc_id", F.size(words(F.coalesce(F.col("text"), F.lit("")))).cast("long").alias("dl"))
    constants = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return counts.join(lengths, "doc_id"), counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), constants


def bm25_search(index: tuple[DataFrame, DataFrame, DataFrame], queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Okapi scores over the queries' distinct terms."""
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k1 must not be negative and b must lie in [0, 1]")
    postings, frequency, constants = index
    q = terms(queries).select(F.col("doc_id").alias("query_id"), "term").join(frequency, "term")
    hit = q.join(postings, "term").crossJoin(F.broadcast(constants))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.col("avgdl")))
    return _ranked(hit, idf * gain, k)


def _ranked(hits: DataFrame, part: Column, k: int) -> DataFrame:
    scores = hits.groupBy("query_id", F.col("doc_id").alias("candidate_id")).agg(F.round(F.sum(part), 6).alias("score"))
    return rank_within(scores.filter("score <> 0"), k=k)


def index_statistics(postings: DataFrame) -> DataFrame:
    """Documents, features and estimated bytes: 16 for each posting and the terms' own."""
    per = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    sizes = per.agg(F.count(F.lit(1)).alias("features"), F.sum(F.octet_length("term") + 16 * F.col("df")).alias("bytes"))
    return sizes.crossJoin(F.broadcast(postings.agg(F.count_distinct("doc_id").alias("documents"))))
