"""Registered queries over the corpus tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from servelog.llm import (chosen_path, divergence, histogram, licenses, mixing, packing, pigeonhole,
                          positional, secret_scan, simhash, spelling, sql, surrogates, toxicity)
from servelog.llm.setup import ready
from servelog.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Labels of these documents are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = _table(spark, sf_dir, "labels")
    return toxicity.train(docs, labels.where(~held_out()).select("doc_id", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = surrogates.replace_checked(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return new.select("doc_id", F.size("entities").cast("long").alias("n_entities"),
                      F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"),
                      "text", "entities")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    labels = lambda *lists: F.array_join(F.array_sort(F.array_distinct(F.concat(*lists))), ",")
    base, own = F.col("places.label"), F.col("spans.label")
    covered = F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["covered"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        labels(base).alias("base_labels"), labels(base, own).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(covered).alias("score"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pigeonhole.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    base = [rule.kind for rule in secret_scan.BASE]
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined("spans").alias("spans"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = histogram.encoded_lengths(_table(spark, sf_dir, "documents"))
    return histogram.suffix_table(histogram.length_histogram(lengths))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional.build_index(_table(spark, sf_dir, "documents"))
    found = positional.phrase_matches(index, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(cut(spelling.words(_table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_pii_surrogates, op3_license_scan, op4_minhash_dedup, op5_vector_dedup, op6_fingerprints,
    op7_secret_scan, op8_token_counts, op9_packing, op10_mixing, op11_source_divergence, op12_decontamination,
    op13_spelling_variants)}

SQL = {"op4_minhash_dedup": sql.MINHASH, "op5_vector_dedup": sql.VECTORS, "op10_mixing": sql.MIXING,
       "op11_source_divergence": sql.DIVERGENCE, "op12_decontamination": sql.DECONTAMINATION,
       "op13_spelling_variants": sql.SPELLING}
