"""Corpus metrics over posts tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.functions.text import partition_tokens
from threadweave.operators import graph
from threadweave.operators.entropy import token_counts

SINCE = "2005-01-01 01:01:01"
YEAR = 365 * 86_400.0
#: Any character that ``str.strip`` would leave, in Java and DuckDB alike.
NOT_BLANK = r"[^\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def memberships(lang: Column) -> Column:
    """Groups that a row counts in: its language, 'all', and 'en_und' for English or unknown."""
    return F.array_compact(F.array(lang, F.lit("all"), F.when(lang.isin("en", "und"), F.lit("en_und"))))


def grouped(posts: DataFrame) -> DataFrame:
    return posts.withColumn("grp", F.explode(memberships(F.col("lang"))))


def first_language(posts: DataFrame) -> DataFrame:
    """``(convo_id, lang)`` of every conversation's first post."""
    return posts.groupBy("convo_id").agg(F.min_by("lang", "seq").alias("lang"))


def sizes(posts: DataFrame) -> DataFrame:
    """``(grp, posts, conversations, first, last, years)``: sizes and time span per language, all, and en_und.

    Conversations of one post aren't counted; a conversation counts for the language of its
    first post; times up to the beginning of 2005 are left out."""
    good = F.when(F.col("created_at") > F.lit(SINCE).cast("timestamp"), F.unix_seconds("created_at"))
    n = grouped(posts).groupBy("grp").agg(F.count(F.lit(1)).alias("posts"), F.min(good).alias("first"), F.max(good).alias("last"))
    many = posts.groupBy("convo_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("lang", "seq").alias("lang")).where("n > 1")
    c = grouped(many).groupBy("grp").agg(F.count(F.lit(1)).alias("conversations"))
    years = F.round((F.col("last") - F.col("first")) / YEAR, 9)
    return n.join(c, "grp", "left").select("grp", "posts", F.coalesce("conversations", F.lit(0)).alias("conversations"), "first", "last", years.alias("years"))


def language_distribution(posts: DataFrame, least: float = 0.005) -> DataFrame:
    """``(lang, n, share)`` of the languages above a share."""
    n = posts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return n.where(F.col("share") > least)


def anonymity(posts: DataFrame, name: str = "Anonymous") -> DataFrame:
    """``(board, ratio)`` of posts by ``name`` per conversation and in all (board null)."""
    return posts.rollup(F.col("convo_id").alias("board")).agg(F.avg(F.coalesce((F.col("author") == name).cast("int"), F.lit(0))).alias("ratio"))


def tagged(posts: DataFrame, tag: str = "AH=1") -> DataFrame:
    """``(what, tagged, n)``: posts and conversations with and without a tag; a conversation has it if any post has."""
    has = posts.select("convo_id", F.array_contains("tags", tag).alias("tagged"))
    one = has.groupBy("tagged").agg(F.count(F.lit(1)).alias("n")).select(F.lit("posts").alias("what"), "tagged", "n")
    per = has.groupBy("convo_id").agg(F.max("tagged").alias("tagged")).groupBy("tagged").agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(per.select(F.lit("conversations").alias("what"), "tagged", "n"))


def creation_histogram(posts: DataFrame, unit: str = "day", year: int | None = None) -> DataFrame:
    """``(grp, at, n)``: posts after 2005 (of a year) per unit of time, in epoch seconds."""
    good = posts.where(F.col("created_at") > F.lit(SINCE).cast("timestamp"))
    if year is not None:
        good = good.where(F.year("created_at") == year)
    own = good.groupBy("lang", F.unix_seconds(F.date_trunc(unit, "created_at")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return grouped(own).groupBy("grp", "at").agg(F.sum("n").alias("n"))


def text_histograms(posts: DataFrame) -> DataFrame:
    """``(grp, measure, value, n)`` for characters, tokens and types of posts, and the pair tokens-types. Counted per language first, then summed over groups."""
    measured = posts.where(F.trim("text") != "").withColumn("_t", partition_tokens(F.col("text")))
    wide = measured.select("lang", F.length("text").alias("chars"), F.size("_t").alias("tokens"), F.size(F.array_distinct("_t")).alias("types"))
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value")) for m in ("chars", "tokens", "types")]
    pairs.append(F.struct(F.lit("tokens-types").alias("measure"), F.concat_ws("-", "tokens", "types").alias("value")))
    own = wide.select("lang", F.inline(F.array(*pairs))).groupBy("lang", "measure", "value").agg(F.count(F.lit(1)).alias("n"))
    return grouped(own).groupBy("grp", "measure", "value").agg(F.sum("n").alias("n"))


def language_tokens(posts: DataFrame) -> DataFrame:
    """``(lang, token, n)``. Spaces are tokens by themselves, so what stands between them is counted first, and only what differs is taken apart."""
    words = posts.select("lang", F.explode(F.split("text", " ")).alias("text")).groupBy("lang", "text").agg(F.count(F.lit(1)).alias("_n"))
    own = words.select("lang", F.explode(partition_tokens(F.col("text"))).alias("token"), "_n").groupBy("lang", "token").agg(F.sum("_n").alias("n"))
    spaces = posts.where(F.col("text").isNotNull()).groupBy("lang").agg(F.sum(F.size(F.split("text", " ")) - 1).alias("n")).where("n > 0")
    return own.unionByName(spaces.select("lang", F.lit(" ").alias("token"), "n"))


def token_frequencies(posts: DataFrame) -> DataFrame:
    """``(grp, token, n)``: how often posts that aren't blank have each token, as written. Counted per language first, then summed over groups."""
    own = language_tokens(posts.where(F.col("text").rlike(NOT_BLANK)))
    return grouped(own).groupBy("grp", "token").agg(F.sum("n").alias("n"))


def text_totals(posts: DataFrame, cased: bool = True) -> DataFrame:
    """``(grp, chars, tokens, types)``: totals per group, blank posts included; ``cased=False`` folds types. Counted per language first, then summed over groups."""
    letters = F.col("token") if cased else F.lower("token")
    own = language_tokens(posts).groupBy("lang", letters.alias("token")).agg(F.sum("n").alias("n"))
    t = grouped(own).groupBy("grp", "token").agg(F.sum("n").alias("n")).groupBy("grp").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    chars = posts.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    return grouped(chars).groupBy("grp").agg(F.sum("chars").alias("chars")).join(t, "grp")


def describe(posts: DataFrame) -> DataFrame:
    """``(grp, measure, n, mean, std, least, p25, p50, p75, most)`` of characters, tokens and types of posts that aren't blank. Values are counted per language first, so no group's posts meet."""
    measured = posts.where(F.trim("text") != "").withColumn("_t", partition_tokens(F.col("text")))
    wide = measured.select("lang", F.length("text").alias("chars"), F.size("_t").alias("tokens"), F.size(F.array_distinct("_t")).alias("types"))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in ("chars", "tokens", "types")])
    own = wide.select("lang", F.inline(pairs)).groupBy("lang", "measure", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("v").cast("decimal(12,0)"), F.col("n").cast("decimal(14,0)")
    at = lambda q: F.percentile("v", q, F.col("n"))
    made = grouped(own).groupBy("grp", "measure").agg(
        F.sum("n").alias("n"), F.sum(v * n).alias("s1"), F.sum(v * v * n).alias("s2"), F.min("v").cast("double").alias("least"),
        at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max("v").cast("double").alias("most"),
    )
    mean = F.col("s1").cast("double") / F.col("n")
    # the squares about the mean, from whole numbers
    squares = (F.col("s2").cast("double") - F.col("s1").cast("double") * mean)
    std = F.when(F.col("n") > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("n") - 1)))
    return made.select("grp", "measure", "n", F.round(mean, 9).alias("mean"), F.round(std, 6).alias("std"), "least", "p25", "p50", "p75", "most")


def rank_frequency(posts: DataFrame) -> DataFrame:
    """``(convo_id, token, n, rank, log_rank, share, log_share)``: types of each conversation by frequency, ties by token."""
    freq = token_counts(posts, ("convo_id",))
    order = Window.partitionBy("convo_id").orderBy(F.desc("n"), "token")
    total = F.sum("n").over(Window.partitionBy("convo_id"))
    r = freq.withColumn("rank", F.row_number().over(order)).withColumn("share", F.col("n") / total)
    return r.select("convo_id", "token", "n", "rank", F.round(F.ln("rank"), 9).alias("log_rank"), F.round("share", 9).alias("share"), F.round(F.ln("share"), 9).alias("log_share"))


def convo_groups(posts: DataFrame) -> DataFrame:
    """``(convo_id, grp)``: a conversation of two posts or more counts for each of its languages, all, and en_und."""
    many = posts.groupBy("convo_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("convo_id")
    return grouped(posts.join(many, "convo_id").select("convo_id", "lang")).select("convo_id", "grp").distinct()


def convo_size_histograms(posts: DataFrame) -> DataFrame:
    """``(grp, measure, value, n)`` for messages, languages, users and duration of conversations."""
    seconds = F.max(F.unix_micros("created_at") / 1e6) - F.min(F.unix_micros("created_at") / 1e6)
    per = posts.groupBy("convo_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct(F.coalesce("lang", F.lit(""))).alias("langs"), F.count_distinct(F.coalesce(F.concat(F.lit("a"), "author"), F.lit(""))).alias("users"),
        F.when(F.count("created_at") == F.count(F.lit(1)), seconds).otherwise(-1.0).cast("bigint").alias("duration"),
    )
    return _histograms(per, posts, ("messages", "langs", "users", "duration"))


def convo_text_histograms(posts: DataFrame) -> DataFrame:
    """``(grp, measure, value, n)`` for characters, tokens and types of conversations."""
    t = token_counts(posts, ("convo_id",)).groupBy("convo_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    per = posts.groupBy("convo_id").agg(F.sum(F.length("text")).alias("chars")).join(t, "convo_id")
    return _histograms(per, posts, ("chars", "tokens", "types"))


def convo_novelty_histograms(posts: DataFrame) -> DataFrame:
    """``(grp, measure, value, n)`` for the pair tokens-types of conversations; 0-0 without any token."""
    t = token_counts(posts, ("convo_id",)).groupBy("convo_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    count = lambda c: F.coalesce(c, F.lit(0))
    per = posts.select("convo_id").distinct().join(t, "convo_id", "left").select("convo_id", F.concat_ws("-", count("tokens"), count("types")).alias("tokens-types"))
    return _histograms(per, posts, ("tokens-types",))


def convo_graph_histograms(posts: DataFrame) -> DataFrame:
    """``(grp, measure, value, n)`` for depth and width of conversations, and for their posts' degrees as total-in-out."""
    trees = _histograms(graph.tree_metrics(posts), posts, ("tree_depth", "tree_width"))
    d = graph.degrees(posts).select("convo_id", F.concat_ws("-", "true_degree", "in_degree", "out_degree").alias("degrees"))
    return trees.unionByName(_histograms(d, posts, ("degrees",)))


def _histograms(per: DataFrame, posts: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value")) for m in measures])
    return per.join(convo_groups(posts), "convo_id").select("grp", F.inline(pairs)).groupBy("grp", "measure", "value").agg(F.count(F.lit(1)).alias("n"))
