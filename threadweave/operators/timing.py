"""Orders and differences in time. Where a conversation of two or more posts has a post without a time, it has no order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.graph import KEY, edges


def _all():
    return Window.partitionBy("convo_id")


def _order():
    return _all().orderBy("created_at", "seq")


def _ordered():
    return (F.count("created_at").over(_all()) == F.count(F.lit(1)).over(_all())) | (F.count(F.lit(1)).over(_all()) == 1)


def _epoch(column: str = "created_at"):
    return F.unix_micros(column) / 1e6


def time_order(posts: DataFrame) -> DataFrame:
    """``(convo_id, uid, place)``, from 0, ties in order of insertion; no rows for a conversation without an order."""
    return posts.withColumn("_o", _ordered()).withColumn("place", F.row_number().over(_order()) - 1).where("_o").select(*KEY, "place")


def text_stream(posts: DataFrame) -> DataFrame:
    """``(convo_id, texts)``: texts in order of time, or of insertion if there is no such order."""
    at = F.when(F.col("_o"), F.col("created_at"))
    listed = posts.withColumn("_o", _ordered()).groupBy("convo_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "seq", "text"))).alias("t"))
    return listed.select("convo_id", F.transform("t", lambda x: x["text"]).alias("texts"))


def time_series(posts: DataFrame, normalize_by_first: bool = True) -> DataFrame:
    """``(convo_id, uid, place, second)``: epoch seconds in order, from the first post's on if normalized."""
    second = _epoch() - F.min(_epoch()).over(_all()) if normalize_by_first else _epoch()
    return posts.withColumn("_o", _ordered()).withColumn("place", F.row_number().over(_order()) - 1).withColumn("second", second).where("_o").select(*KEY, "place", "second")


def duration(posts: DataFrame) -> DataFrame:
    """``(convo_id, duration)``: seconds from first to last, -1 without an order."""
    whole = F.count("created_at") == F.count(F.lit(1))
    return posts.groupBy("convo_id").agg(F.when(whole, F.max(_epoch()) - F.min(_epoch())).otherwise(-1.0).alias("duration"))


def relative_age(posts: DataFrame) -> DataFrame:
    """``(convo_id, uid, relative_age)``: seconds since the conversation's first post, -1 without an order."""
    age = F.when(_ordered() & F.col("created_at").isNotNull(), _epoch() - F.min(_epoch()).over(_all())).otherwise(-1.0)
    return posts.select(*KEY, age.alias("relative_age"))


def response_time(posts: DataFrame) -> DataFrame:
    """``(convo_id, uid, response_time)``: seconds between a post and the parent nearest in time, -1 if there is none with a time."""
    mine = posts.select(*KEY, _epoch().alias("_t"))
    theirs = posts.select("convo_id", F.col("uid").alias("parent"), _epoch().alias("_p"))
    gaps = edges(posts).withColumnRenamed("child", "uid").join(mine, KEY).join(theirs, ["convo_id", "parent"]).groupBy(*KEY).agg(F.min(F.abs(F.col("_t") - F.col("_p"))).alias("response_time"))
    return posts.select(*KEY).join(gaps, KEY, "left").withColumn("response_time", F.coalesce("response_time", F.lit(-1.0)))
