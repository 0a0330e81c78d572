"""Merging of posts with equal ids, and unions of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.schema import COLUMNS


def _first(column: str) -> Column:
    """The first value that isn't null, in order of insertion."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))


def merge_posts(posts: DataFrame, keys: tuple[str, ...] = ("convo_id", "uid")) -> DataFrame:
    """One post per key: the longest text (of equal ones the first), the first author, language and
    platform that aren't null, the earliest time, and the unions of reply targets and tags. ``seq`` may be of any type that has an order."""
    merged = posts.groupBy(*keys).agg(
        F.min("seq").alias("seq"),
        F.min_by("text", F.struct(F.coalesce(-F.length("text"), F.lit(1)), "seq")).alias("text"),
        _first("author").alias("author"),
        F.min("created_at").alias("created_at"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reply_to"))), lambda x: x["reply_to"]))).alias("reply_to"),
        _first("platform").alias("platform"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tags"))), lambda x: x["tags"]))).alias("tags"),
        _first("lang").alias("lang"),
        *([] if "convo_id" in keys else [F.min_by("convo_id", "seq").alias("convo_id")]),
    )
    return merged.select(*COLUMNS)


def union_conversations(a: DataFrame, b: DataFrame, convo_id: Column | None = None) -> DataFrame:
    """a + b: b's posts first, then a's, merged by id; ``convo_id`` (default: a's, else b's) names the result's conversations."""
    shift = b.groupBy("convo_id").agg((F.max("seq") + 1).alias("_from"))
    later = a.join(shift, "convo_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_from", F.lit(0))).drop("_from")
    both = b.select(*COLUMNS).unionByName(later.select(*COLUMNS))
    return merge_posts(both if convo_id is None else both.withColumn("convo_id", convo_id))


def difference(keep: DataFrame, drop: DataFrame) -> DataFrame:
    """Posts of ``keep`` whose (convo_id, uid) isn't in ``drop``."""
    return keep.join(drop.select("convo_id", "uid").distinct(), ["convo_id", "uid"], "left_anti")


def posts_across(posts: DataFrame, user: str | None = None) -> DataFrame:
    """The posts of one author (of every author that isn't null for None) over all conversations, merged by id per author."""
    own = posts.where(F.col("author").isNotNull() if user is None else F.col("author") == user)
    order = Window.partitionBy("author", "uid").orderBy("convo_id", "seq")
    numbered = own.withColumn("seq", F.row_number().over(order).cast("bigint"))
    return merge_posts(numbered.withColumn("convo_id", F.col("author")))
