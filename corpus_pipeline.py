"""From raw documents to packed training sequences: the corpus operators in a row.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read
again as the next stage's ``docs``. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from servelog.llm import chosen_path, mixing, packing, surrogates, toxicity
from servelog.llm.queries import toxicity_model
from servelog.llm.setup import ready
from servelog.session import cut

#: Documents with this score and more are rejected.
TOXIC = 0.3


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC`` by a model of the labels; empty texts stay unless
    most labels are toxic."""
    ready(spark)
    model = toxicity_model(docs, spark, sf_dir)
    return docs.where(toxicity.scorer(model)(docs["text"]) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every group of near copies."""
    ready(spark)
    return chosen_path.keep_one(docs)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text."""
    ready(spark)
    return surrogates.replace_checked(docs, out="__entities").drop("__entities")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents and parts of documents as often as the mix takes them."""
    ready(spark)
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of at most 2048 ids."""
    ready(spark)
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates),
          ("pii", replace_private), ("mixing", mix_sources), ("packing", pack_sequences)]

# A trained classifier and keyed permutations are not SQL; tests hold the stages against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
