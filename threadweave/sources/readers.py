"""Readers of raw files into posts tables, segmented into conversations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadweave.functions import langdetect, text
from threadweave.operators.graph import derived_ids, segment
from threadweave.operators.merge import merge_posts
from threadweave.schema import COLUMNS, PLATFORMS
from threadweave.session import cut, reach, setting
from threadweave.sources import raw


class Reader(Protocol):
    """What a reader is: a function of a session and a path."""

    def __call__(self, spark: SparkSession, path: str) -> DataFrame: ...


_POOL = "\x01pool="


def _finish(rows: DataFrame, pool: Column, detect: Callable[[DataFrame], DataFrame] | None, *order: str | Column, label: Column | None = None, name: str = "pool") -> DataFrame:
    """Merge by id within a pool, detect languages, cut into components, and number the posts of each in order. ``label`` of a pool becomes the column ``name``.

    The order of insertion is a text that sorts like ``order``, so no pool, however large, is put in order as a whole."""
    if label is not None:
        kept = _finish(rows.withColumn("tags", F.array_union("tags", F.array(F.concat(F.lit(_POOL), label)))), pool, detect, *order)
        own = F.filter("tags", lambda t: t.startswith(_POOL))
        return kept.withColumn(name, F.replace(own[0], F.lit(_POOL), F.lit(""))).withColumn("tags", F.array_except("tags", own))
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = [F.lpad(c.cast("string"), 10, "0") if isinstance(o, str) and o == "place" else c.cast("string") for o, c in zip(order, columns)]
    placed = rows.withColumn("convo_id", pool).withColumn("seq", F.concat_ws("\x01", *parts))
    merged = merge_posts(placed.select(*COLUMNS))
    # written once: the rounds of ``segment`` would read and parse all files each
    cut_up = segment(cut(detect(merged) if detect else merged))
    return cut_up.withColumn("seq", F.row_number().over(Window.partitionBy("convo_id").orderBy("seq", "uid")).cast("bigint"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, line)``; ``line`` is a text that sorts lines by file and place in it: rows of a block of a file come in order, so their running numbers have it."""
    lines = reach(spark).read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    digits = lambda c: F.lpad(F.col(c).cast("string"), 19, "0")
    return lines.where(F.trim("value") != "").select("value", "file", F.concat_ws("\x01", "file", digits("block"), digits("n")).alias("line"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return reach(spark).read.text(path, wholetext=True).withColumn("file", F.input_file_name())


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, value)``: files in the pieces between their commas, those of a file in order and in one task, so that it can be followed without being held as a whole."""
    pieces = reach(spark).read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return pieces.repartition("file").sortWithinPartitions("file", "block", "n").select("file", "value")


UNIVERSAL = "array<struct<uid:string,text:string,author:string,created_at:double,reply_to:array<string>,platform:string,tags:array<string>,lang:string>>"


def read_universal(spark: SparkSession, path: str) -> DataFrame:
    """Universal JSON lines (``path*.json``): each line is the array of a conversation's messages.

    A time of 0 or null is none; an unknown platform raises; messages of one id in a line are merged."""
    lines = _lines(spark, path + "*.json").select("line", F.from_json("value", UNIVERSAL).alias("m"))
    rows = lines.select(F.col("line").alias("convo_id"), F.posexplode("m").alias("seq", "m"))
    bad = F.raise_error(F.concat(F.lit("no platform: "), F.coalesce("m.platform", F.lit("null"))))
    at = F.when(F.col("m.created_at") != 0, F.timestamp_micros(F.round(F.col("m.created_at") * 1e6).cast("bigint")))
    posts = rows.select(
        "convo_id", F.col("seq").cast("bigint").alias("seq"), "m.uid", F.coalesce("m.text", F.lit("")).alias("text"), "m.author", at.alias("created_at"),
        F.array_distinct(F.coalesce("m.reply_to", F.array())).alias("reply_to"), F.when(F.col("m.platform").isin(*PLATFORMS), F.col("m.platform")).otherwise(bad).alias("platform"),
        F.array_distinct(F.coalesce("m.tags", F.array())).alias("tags"), "m.lang",
    )
    merged = merge_posts(posts)
    return merged.join(derived_ids(merged), "convo_id").withColumn("convo_id", F.col("derived_id")).select(*COLUMNS)


def universal_json(posts: DataFrame) -> DataFrame:
    """``(convo_id, value)``: a conversation's messages as a JSON array, in order of insertion."""
    message = F.struct("uid", "text", "author", (F.unix_micros("created_at") / 1e6).alias("created_at"), "reply_to", "platform", "tags", "lang")
    listed = posts.groupBy("convo_id").agg(F.array_sort(F.collect_list(F.struct("seq", message.alias("m")))).alias("ms"))
    return listed.select("convo_id", F.to_json(F.transform("ms", lambda x: x["m"]), {"ignoreNullFields": "false"}).alias("value"))


def write_universal(posts: DataFrame, path: str, shards: int | None = None, per_file: int | None = None, by: str | None = None, mode: str = "error") -> None:
    """Write JSON lines, one conversation each: in ``shards`` files, at most ``per_file`` lines in a file, or a folder per value of ``by``. ``mode`` is Spark's: what to do if there is something already."""
    lines = universal_json(posts)
    if by is not None:
        keys = posts.groupBy("convo_id").agg(F.min(by).alias(by))
        lines = lines.join(keys, "convo_id")
    if shards:
        lines = lines.repartition(shards, "convo_id")
    writer = lines.drop("convo_id").write.mode(mode)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    (writer.partitionBy(by) if by else writer).text(path)


def parse_chan(raw_posts: DataFrame) -> DataFrame:
    """4chan posts (no, resto, time, name, com) as messages; posts without a comment are left out, a post doesn't reply to itself."""
    number = F.col("no").cast("string")
    cited = F.regexp_extract_all("text", F.lit(r">>(\d+)"), F.lit(1))
    cleaned = raw_posts.where(F.col("com").isNotNull()).withColumn("text", text.clean_chan(F.col("com")))
    thread = F.when(F.col("resto") != 0, F.array(F.col("resto").cast("string"))).otherwise(F.array().cast("array<string>"))
    plain = F.transform(cited, lambda c: F.coalesce(c.try_cast("decimal(38,0)").cast("string"), c))
    return cleaned.select(
        *[c for c in raw_posts.columns if c not in ("no", "resto", "time", "name", "com")], number.alias("uid"), "text", F.col("name").alias("author"), F.timestamp_seconds("time").alias("created_at"),
        F.array_remove(F.array_union(thread, plain), number).alias("reply_to"), F.lit("4chan").alias("platform"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("lang"),
    )


def read_chan(spark: SparkSession, path: str, detect=None) -> DataFrame:
    """Chunks ``path00.json`` to ``path99.json``, each an object from id to post; replies are followed within a chunk. Adds ``chunk``."""
    shape = "map<string,struct<no:bigint,resto:bigint,time:double,name:string,com:string>>"
    files = _files(spark, path + "[0-9][0-9].json")
    posts = files.select("file", F.explode(F.from_json("value", shape)).alias("k", "p")).select("file", "p.*")
    return _finish(parse_chan(posts), F.col("file"), detect, "uid", label=F.regexp_extract("file", r"(\d\d)\.json$", 1), name="chunk")


def read_tweets(spark: SparkSession, path: str, detect=None) -> DataFrame:
    """JSON lines of tweets (``path*.json``), all one pool."""
    rows = raw.parsed(_lines(spark, path + "*.json"), raw.tweet, {"file": "string"})
    return _finish(rows, F.lit("pool"), detect, "file", "line", "place")


def read_tweet_threads(spark: SparkSession, path: str) -> DataFrame:
    """Files ``path*tweets.json``, each an object from id to tweet, read piece by piece; replies are followed within a file. Adds ``source``, from the file's name."""
    rows = raw.parsed_members(_pieces(spark, path + "*tweets.json"), raw.tweet)
    return _finish(rows, F.col("file"), None, "place", label=_thread_source(F.col("file")), name="source")


def _thread_source(file: Column) -> Column:
    return F.replace(F.element_at(F.split(file, "_"), -1), F.lit("-tweets.json"), F.lit(""))


def read_reddit(spark: SparkSession, path: str, flat: bool = False, detect=None) -> DataFrame:
    """JSON lines of Reddit things (``path*.json``): a pool per file, or with ``flat`` monthly files YYYY-MM of flat posts, a pool per
    quarter: what comes up to and with a file of January, April, July or October."""
    lines = _lines(spark, path + "*.json")
    if not flat:
        return _finish(raw.parsed(lines, raw.reddit, {"file": "string"}), F.col("file"), detect, "line", "place")
    month = F.to_date(F.concat(F.substring(F.element_at(F.split("file", "/"), -1), 1, 7), F.lit("-01")))
    quarter = F.date_format(F.date_trunc("quarter", F.add_months(month, 2)), "yyyy-MM")
    rows = raw.parsed(lines.withColumn("quarter", quarter), raw.reddit_flat, {"quarter": "string", "file": "string"})
    return _finish(rows, F.col("quarter"), detect, "file", "line", "place")


def read_ad_hominem(spark: SparkSession, path: str, detect=None) -> DataFrame:
    """JSON lines of Reddit posts with ``violated_rule``, tagged AH=1 or AH=0, all one pool."""
    rows = raw.parsed(_lines(spark, path), raw.reddit_ad_hominem, {"file": "string"})
    return _finish(rows, F.lit("pool"), detect, "file", "line", "place")


def read_facebook(spark: SparkSession, path: str, detect=None) -> DataFrame:
    """Folders ``path<page>/<post>/{post,comments,replies,attach,react,scrape}*.json``; a pool per page.

    Files are read many to a task, for they are small. Those that aren't JSON are passed over. A post folder without a good post gets one with the text [deleted] by
    the page; comments reply to the folder's post. Other file names raise. Adds ``page``."""
    at = F.split(F.col("file"), "/")
    files = _in_folders(spark, path).select("value", "file", F.element_at(at, -3).alias("page"), F.element_at(at, -2).alias("folder"), F.element_at(at, -1).alias("name"))
    known = F.regexp_extract("name", "(post|comments|replies|attach|react|scrape)", 1)
    kind = F.when(F.col("name").startswith("post"), "post").when(known == "", F.raise_error(F.concat(F.lit("no kind of file: "), F.col("file")))).otherwise(known)

    # files are read and parsed once; one without messages leaves a row without a platform, for its folder's sake
    good = F.col("kind").isin("post", "comments", "replies") & F.try_parse_json("value").isNotNull()
    named = files.withColumn("kind", kind).select("page", "folder", F.when(good, F.col("kind")).otherwise("none").alias("kind"), F.col("file").alias("line"), F.when(good, F.col("value")).otherwise("null").alias("value"))
    keys = {"page": "string", "folder": "string", "kind": "string"}
    rows = raw.parsed(named, raw.facebook_file, keys, ("kind",))
    folder = Window.partitionBy("page", "folder")
    held = F.col("platform").isNotNull()
    post_uid = F.max_by("uid", F.when((F.col("kind") == "post") & held, F.struct("line", "place"))).over(folder)
    mark, target = F.lit(raw.OF_FOLDER), F.coalesce("_post", "folder")
    placed = rows.withColumn("_post", post_uid).withColumn("_n", F.row_number().over(folder.orderBy("line", "place")))
    placed = placed.withColumn("reply_to", F.transform("reply_to", lambda r: F.when(r == mark, target).otherwise(r)))
    none = F.array().cast("array<string>")
    missing = F.struct(
        F.lit("post").alias("kind"), F.lit("").alias("line"), F.lit(0).alias("place"), F.col("folder").alias("uid"), F.lit("[deleted]").alias("text"), F.col("page").alias("author"),
        none.alias("reply_to"), F.lit("Facebook").alias("platform"), none.alias("tags"), F.lit("en").alias("lang"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    own = F.struct("kind", "line", "place", "uid", "text", "author", "reply_to", "platform", "tags", "lang", "created_at")
    wanted = F.array_compact(F.array(F.when(held, own), F.when((F.col("_n") == 1) & F.col("_post").isNull(), missing)))
    messages = placed.select("page", "folder", F.inline(wanted))
    # ``_finish`` reads the files before it returns
    with setting(spark, "spark.sql.files.openCostInBytes", 128 << 10):
        return _finish(messages, F.col("page"), detect, "folder", F.expr("kind <> 'post'"), "line", "place", label=F.col("page"), name="page")


def _in_folders(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file)`` of the files ``path*/*/*.json``. The driver lists the folders that ``path`` names, and tasks what is in those below."""
    jvm = spark._jvm
    prefix = jvm.org.apache.hadoop.fs.Path(path + "*")
    uri = prefix.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(prefix).toUri()
    depth = len(uri.getPath().strip("/").split("/")) + 2
    inside = F.size(F.split(F.regexp_replace("file", r"^\w+:(//[^/]*)?/+", ""), "/"))
    found = reach(spark).read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path + "*/*", wholetext=True)
    return found.withColumn("file", F.input_file_name()).where(inside == depth)


READERS = {"universal": read_universal, "4chan": read_chan, "Facebook": read_facebook, "Reddit": read_reddit, "Twitter": read_tweets, "threads": read_tweet_threads, "ad_hominem": read_ad_hominem}
DETECT = langdetect.detect_languages


def convert(spark: SparkSession, kind: str, path: str, out: str, shards: int | None = None, per_file: int | None = None, by: str | None = None, mode: str = "error", **options) -> None:
    """Raw files of a kind to universal JSON lines."""
    write_universal(READERS[kind](spark, path, **options), out, shards, per_file, by, mode)
