"""The universal message table and its constants."""

from __future__ import annotations

from pyspark.sql import types as T

PLATFORMS = ("4chan", "Facebook", "Reddit", "Twitter")

MESSAGE = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("reply_to", T.ArrayType(T.StringType())),
        T.StructField("platform", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("lang", T.StringType()),
    ]
)
#: A message in its conversation; ``seq`` is the order of insertion.
POSTS = T.StructType([T.StructField("convo_id", T.StringType()), T.StructField("seq", T.LongType()), *MESSAGE.fields])
FIELDS = [f.name for f in MESSAGE.fields]
COLUMNS = POSTS.fieldNames()
