"""Redaction of user names over whole conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions import text


def redact(posts: DataFrame, assign_ints: bool = True) -> DataFrame:
    """Posts with authors and mentioned names replaced by USER<k>, numbered in order of their first place in a conversation."""
    names = posts.select("convo_id", "seq", F.posexplode(text.private_names(F.col("text"), F.col("platform"), F.col("author"))).alias("i", "name"))
    first = names.groupBy("convo_id", "name").agg(F.min(F.struct("seq", "i")).alias("at"))
    number = F.row_number().over(Window.partitionBy("convo_id").orderBy("at")) - 1
    alias = F.concat(F.lit("USER"), number.cast("string")) if assign_ints else F.lit("USER")
    listed = first.withColumn("alias", alias).groupBy("convo_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "alias"))).alias("_names"))
    joined = posts.join(listed, "convo_id", "left")
    own = F.filter("_names", lambda n: n["name"] == F.col("author"))
    changed = joined.withColumn("text", F.coalesce(text.replace_names(F.col("text"), F.transform("_names", lambda n: F.struct(n["name"].alias("name"), n["alias"].alias("alias")))), F.col("text")))
    return changed.withColumn("author", F.when(F.size(own) > 0, own[0]["alias"]).otherwise(F.col("author"))).select(*posts.columns)
