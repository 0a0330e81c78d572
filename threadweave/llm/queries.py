"""The ten operators over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.llm import bpe, chat, minmax, multiindex, packing, pii, quality, repeats, topk, urlfilter
from threadweave.session import table


#: Words of hosts that the operator of a crawl has blocked: the rated part that the URL filter learns from.
BLOCKED = ("casino", "free-bets", "cheap-pills", "spam-farm", "adult", "ads-track")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of documents, each with the one that is kept."""
    return minmax.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "keeper_id", "n_links")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text again."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded")
    return coded.select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("intact"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for the URL of every page."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.host_label(F.col("url"), BLOCKED))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark passage, and the ten best others for every document whose id is divisible by 50."""
    return topk.top_k_of_both(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bin, slot and offset of every piece of every document."""
    return packing.harmonic_pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many values that were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise_docs(docs, count="n_values")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labelled documents: 0 poor, 1 good but toxic, 2 good."""
    return table(spark, sf_dir, "labels").select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects, with expected grade and tail probability."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.select_documents(docs, rated(spark, sf_dir)).drop("text")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with repaired roles, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of those whose id is divisible by 50."""
    return multiindex.nearest(table(spark, sf_dir, "embeddings"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of all maximal repeats of 45 words or more in documents, with all occurrences."""
    return repeats.find_repeats(table(spark, sf_dir, "documents")).drop("key", "cut")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_urls": op3_urls,
    "op4_topk": op4_topk,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_neighbours": op9_neighbours,
    "op10_repeats": op10_repeats,
}
ORACLES = {
    "op3_urls": urlfilter.urlfilter_sql(BLOCKED),
    "op4_topk": topk.topk_sql(),
    "op5_packing": packing.packing_sql(),
}
