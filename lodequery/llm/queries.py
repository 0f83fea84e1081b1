"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import licenses, lm, mixing, ngram_join, packing, quality, secrets, simhash, toxicity, warc
from .common import fold, table


def op1_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op2_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op4_simhash(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_arc_to_warc(spark, sf_dir):
    back = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lm_score(spark, sf_dir):
    docs = lm.encoded(table(spark, sf_dir, "documents"))
    return lm.score(docs, lm.fit(docs))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries():
    return {f.__name__: f for f in (op1_quality_rules, op2_secret_scan, op3_toxicity, op4_simhash, op5_license_scan, op6_ngram_join, op7_arc_to_warc, op8_packing, op9_lm_score, op10_mixing)}


def oracle_sql():
    return {"op2_secret_scan": secrets.oracle_sql(), "op5_license_scan": licenses.oracle_sql(), "op7_arc_to_warc": warc.ORACLE_SQL}
