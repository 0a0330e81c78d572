"""Posts tables from the tables of conversations, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.schema import COLUMNS
from threadweave.session import table

SHAPES = ("chain", "tree", "dag", "external")
LANGS = ("en", "und", "fr", "de")  #: of posts, by conversation and turn
PLACES = ("Twitter", "Reddit", "4chan", "Facebook")  #: of conversations
#: What stands after a turn's text: tags, links, names and pictures of all kinds.
TAILS = ("", " #Topic see https://ex.org/a?b=1 by @user_1 or u/reader", " \U0001f60f\U0001f44d\U0001f3fd #two #three /u/some-one >>12", " https://ex.com/x. >>7 >>8 \u2764\ufe0f \U0001f1eb\U0001f1f7 @ab, @cd")
START = 1_704_067_200


def conversation_posts(spark: SparkSession, sf_dir: str, shape: str = "tree", timed: bool = True, rich: bool = True) -> DataFrame:
    """Turns as posts; ``shape`` says what turn t replies to, ``rich`` varies languages and platforms and adds ``TAILS`` to the texts.

    chain: t-1; tree: (t-1) div 2; dag: both; external: as tree, and turn 0 of conversations with
    an even number replies to a post that isn't there. Times are a day per conversation and uneven minutes per turn.
    """
    uid = lambda t: (F.col("conv_id") * 1000 + t).cast("string")
    turn = F.col("turn")
    last, half = turn - 1, F.floor((turn - 1) / 2).cast("bigint")
    targets = {"chain": F.array(uid(last)), "tree": F.array(uid(half)), "dag": F.array_distinct(F.array(uid(last), uid(half))), "external": F.array(uid(half))}[shape]
    none = F.array().cast("array<string>")
    reply = F.when(turn > 0, targets).otherwise(F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("missing"))).otherwise(none) if shape == "external" else none)
    at = F.timestamp_seconds(F.lit(START) + F.col("conv_id") * 86_400 + turn * 60 + (turn * turn * 7) % 50)
    choose = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))
    words = F.concat("text", choose(TAILS, turn)) if rich else F.col("text")
    lang, platform = (choose(LANGS, F.col("conv_id") * 3 + F.floor(turn / 2)), choose(PLACES, F.col("conv_id"))) if rich else (F.lit("und"), F.lit("Twitter"))
    posts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("convo_id"), turn.alias("seq"), uid(turn).alias("uid"), words.alias("text"), F.col("role").alias("author"),
        (at if timed else F.lit(None).cast("timestamp")).alias("created_at"), reply.alias("reply_to"), platform.alias("platform"),
        F.array(F.concat(F.lit("role="), "role")).alias("tags"), lang.alias("lang"),
    )
    return posts.select(*COLUMNS)


def event_posts(spark: SparkSession, sf_dir: str, threshold: float = 50.0) -> DataFrame:
    """Events as posts: a user's events are a conversation, and one above the threshold replies to the one before it."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    previous = F.lag("event_id").over(order).cast("string")
    reply = F.when((F.col("value") > threshold) & previous.isNotNull(), F.array(previous)).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("convo_id"), F.row_number().over(order).cast("bigint").alias("seq"), F.col("event_id").cast("string").alias("uid"),
        F.coalesce("props", F.lit("")).alias("text"), F.col("event_type").alias("author"), F.col("ts").cast("timestamp").alias("created_at"), reply.alias("reply_to"),
        F.lit("Reddit").alias("platform"), F.array().cast("array<string>").alias("tags"), F.lit("und").alias("lang"),
    ).select(*COLUMNS)


def document_posts(spark: SparkSession, sf_dir: str, platform: str = "Twitter") -> DataFrame:
    """Documents as posts without times or replies; a source is a conversation."""
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("convo_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("uid"), F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("timestamp").alias("created_at"), none.alias("reply_to"), F.lit(platform).alias("platform"), none.alias("tags"), "lang",
    ).select(*COLUMNS)
