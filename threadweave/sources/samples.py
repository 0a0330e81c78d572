"""Raw files of every kind from the table of conversations, and what their readers make of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.session import checkpoint_dir, file_system
from threadweave.sources import readers
from threadweave.sources.adapters import conversation_posts


SHIFT = 1_000_000  #: added to the ids of 4chan posts, where 0 is no post


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"


def write_files(lines: DataFrame, path: str, around: tuple[str, str, str] = ("", "\n", "\n")) -> None:
    """Write ``(name, value)``: the values of a name are the lines of the file ``path/name``, in no certain order. ``around``: what comes before, between and after them. Every task writes the files of its
    names, one at a time, into the folder that all share; a file has its name only when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        known, held, n, part, out = set(), None, 0, None, None

        first, between, last = (x.encode() for x in around)

        def close():
            if out is not None:
                out.write(last)
                out.close()
                fs.move(part, f"{root}/{held}")

        fs.create_dir(f"{root}/_unfinished")
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != held:
                    close()
                    held, n, part = name, n + 1, f"{root}/_unfinished/{uuid.uuid4().hex}"
                    parent = f"{root}/{name}".rpartition("/")[0]
                    if parent not in known:
                        fs.create_dir(parent)
                        known = known | {parent} if len(known) < 10_000 else {parent}
                    out = fs.open_output_stream(part)
                    out.write(first)
                else:
                    out.write(between)
                out.write(value.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    lines.select("name", "value").repartition("name").sortWithinPartitions("name").mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    fs, root = file_system(path)
    fs.delete_dir(f"{root}/_unfinished")


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_posts(spark, sf, rich=False).withColumn("text", F.trim("text")).withColumn("conv", F.col("convo_id").cast("bigint"))


def _to():
    return F.try_element_at("reply_to", F.lit(1))


OBJECT = "{", ",", "}"  #: around members


def _members(posts: DataFrame, name: str, key: str, value) -> DataFrame:
    """``(name, value)``: the members of an object from a key to a value per name, as JSON."""
    one = F.to_json(F.create_map(F.col(key), value))
    return posts.select(F.col(name).alias("name"), F.substring(one, F.lit(2), F.length(one) - 2).alias("value"))


def _tweet():
    made = F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    return F.struct(F.col("uid").cast("bigint").alias("id"), F.col("text").alias("full_text"), made.alias("created_at"), "lang", _to().cast("bigint").alias("in_reply_to_status_id"), F.struct(F.col("author").alias("screen_name")).alias("user"))


def universal(spark: SparkSession, sf: str) -> DataFrame:
    path, posts = folder(spark), conversation_posts(spark, sf)
    write_files(readers.universal_json(posts).select(F.concat(F.lit("u"), F.col("convo_id").cast("bigint") % 4, F.lit(".json")).alias("name"), "value"), path)
    return readers.read_universal(spark, f"{path}/u")


def tweets(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    write_files(_posts(spark, sf).select(F.concat(F.lit("t"), F.col("conv") % 3, F.lit(".json")).alias("name"), F.to_json(_tweet()).alias("value")), path)
    return readers.read_tweets(spark, f"{path}/t")


def tweet_threads(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    named = _posts(spark, sf).withColumn("name", F.concat(F.lit("a_topic"), F.col("conv") % 3, F.lit("-tweets.json")))
    write_files(_members(named, "name", "uid", _tweet()), path, OBJECT)
    return readers.read_tweet_threads(spark, f"{path}/")


def chan(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    named = _posts(spark, sf).withColumn("name", F.concat(F.lit("0"), F.col("conv") % 4, F.lit(".json")))
    escaped = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    post = F.struct(
        (F.col("uid").cast("bigint") + SHIFT).alias("no"), F.coalesce(_to().cast("bigint") + SHIFT, F.lit(0)).alias("resto"), F.unix_seconds("created_at").alias("time"), F.col("author").alias("name"), escaped.alias("com")
    )
    write_files(_members(named, "name", "uid", post), path, OBJECT)
    return readers.read_chan(spark, f"{path}/")


def _reddit(conv_id: bool = False):
    return [
        F.col("uid").alias("id"), F.col("text").alias("body"), "author", F.unix_seconds("created_at").cast("double").alias("created_utc"), F.concat(F.lit("t1_"), _to()).alias("parent_id"),
    ]


def reddit(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation is a nested thing: the posts that reply to another are in the replies of the first."""
    path = folder(spark)
    posts = _posts(spark, sf).withColumn("name", F.concat(F.lit("r"), F.col("conv") % 3, F.lit(".json")))
    later = posts.where("seq > 0").groupBy("conv").agg(F.collect_list(F.struct(F.lit("t1").alias("kind"), F.struct(*_reddit()).alias("data"))).alias("c"))
    first = posts.where("seq = 0").join(later, "conv", "left")
    listing = F.when(F.col("c").isNotNull(), F.struct(F.lit("Listing").alias("kind"), F.struct(F.col("c").alias("children")).alias("data")))
    thing = F.struct(F.lit("t3").alias("kind"), F.struct(*_reddit(), listing.alias("replies")).alias("data"))
    write_files(first.select("name", F.to_json(thing).alias("value")), path)
    return readers.read_reddit(spark, f"{path}/r")


def reddit_flat(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    posts = _posts(spark, sf).withColumn("name", F.concat(F.date_format("created_at", "yyyy-MM"), F.lit(".json"))).withColumn("board", F.concat(F.lit("b"), F.col("conv") % 3))
    # a conversation stays in the month it begins in, so it is in one quarter
    month = F.first("name").over(_first())
    flat = F.struct(*_reddit(), F.col("board").alias("subreddit"), F.lit("comment").alias("type"))
    top = F.struct(F.col("uid").alias("id"), "author", F.unix_seconds("created_at").alias("created_utc"), F.lit("").alias("title"), F.col("text").alias("selftext"), F.col("board").alias("subreddit"), F.lit("submission").alias("type"))
    write_files(posts.withColumn("name", month).select("name", F.when(F.col("seq") == 0, F.to_json(top)).otherwise(F.to_json(flat)).alias("value")), path)
    return readers.read_reddit(spark, f"{path}/", flat=True)


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("convo_id").orderBy("seq")


def ad_hominem(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    posts = _posts(spark, sf)
    write_files(posts.select(F.concat(F.lit("h"), F.col("conv") % 3, F.lit(".json")).alias("name"), F.to_json(F.struct(*_reddit(), (F.col("seq") % 3).alias("violated_rule"))).alias("value")), path)
    return readers.read_ad_hominem(spark, f"{path}/*.json")


def facebook(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark)
    posts = _posts(spark, sf).withColumn("at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+0000'"))
    where = F.concat(F.lit("page"), F.col("conv") % 5, F.lit("/"), (F.col("conv") * 1000).cast("string"))
    first = posts.where("seq = 0").select(F.concat(where, F.lit("/post.json")).alias("name"), F.to_json(F.struct(F.col("uid").alias("id"), F.col("text").alias("message"), F.col("at").alias("created_time"), F.lit("status").alias("type"))).alias("value"))
    comment = F.struct(F.col("uid").alias("id"), F.col("text").alias("message"), F.col("at").alias("created_time"), F.col("author").alias("userID"))
    later = posts.where("seq > 0").groupBy(F.concat(where, F.lit("/comments.json")).alias("name")).agg(F.to_json(F.struct(F.collect_list(comment).alias("data"))).alias("value"))
    odd = posts.where("seq = 0").select(F.concat(where, F.lit("/react.json")).alias("name"), F.lit("no json").alias("value"))
    write_files(first.unionByName(later).unionByName(odd), path)
    return readers.read_facebook(spark, f"{path}/")


def converted(spark: SparkSession, sf: str) -> DataFrame:
    """Raw tweets to universal lines in three shards, by ``convert``, and read again."""
    path = folder(spark)
    write_files(_posts(spark, sf).select(F.concat(F.lit("t"), F.col("conv") % 3, F.lit(".json")).alias("name"), F.to_json(_tweet()).alias("value")), path)
    readers.convert(spark, "Twitter", f"{path}/t", f"{path}/out", shards=3)
    lines = spark.read.text(f"{path}/out").select(F.lit("u.json").alias("name"), "value")
    write_files(lines, f"{path}/again")
    return readers.read_universal(spark, f"{path}/again/u")


SAMPLES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "universal": universal, "tweets": tweets, "tweet_threads": tweet_threads, "chan": chan, "reddit": reddit, "reddit_flat": reddit_flat, "ad_hominem": ad_hominem, "facebook": facebook, "converted": converted,
}
