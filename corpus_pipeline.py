"""Documents to training sequences: five stages, each on all that the one before kept.

Every stage takes and returns the columns of ``documents`` (the last adds a piece's place); extra columns go along whatever
their names. Rows with a null id or text that a stage doesn't look at stay; ``run`` cuts the lineage
after each stage, so none is worked through twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm import minmax, packing, pii, quality, repeats
from threadweave.llm.queries import rated
from threadweave.session import cut, reach, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, selects."""
    reach(spark)
    return quality.select_documents(docs, rated(spark, sf_dir)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    reach(spark)
    return minmax.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 45 words or more stay where they occur first; ``n_chars`` follows the text."""
    reach(spark)
    return _measured(repeats.drop_repeats(docs), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms for personal data; ``n_chars`` follows the text."""
    reach(spark)
    return _measured(pii.pseudonymise_docs(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin, its place in it, and its text."""
    reach(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_key"))
    placed = packing.harmonic_pack(keyed, keep=("_key",))
    texts = keyed.select("_key", F.col("text").alias("_text")).dropDuplicates(["_key"])
    piece = F.substr("_text", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return placed.join(texts, "_key").withColumn("text", piece).drop("_key", "_text")


def _measured(df: DataFrame, like: DataFrame) -> DataFrame:
    if "n_chars" not in like.columns:
        return df
    return df.withColumn("n_chars", F.length("text").cast(dict(like.dtypes)["n_chars"]))


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]
#: Hashing, fitted weights, keyed permutations and suffix order are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
