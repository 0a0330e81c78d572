"""Harmonic packing of documents into training sequences of a fixed capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 16_384  #: characters of a sequence
CLASSES = 64  #: classes that hold exactly the pieces of 1/i of the capacity; beyond, i goes up by doubling
SHARD = 8_192  #: rows, about, whose bins are filled together


def size_class(length: Column, capacity: int, classes: int = CLASSES) -> Column:
    """Number of pieces of this length's class that a bin holds: ``capacity div length`` up to
    ``classes``, then the greatest ``classes * 2**j`` that is not above it."""
    fit = F.floor(F.lit(capacity) / length).cast("bigint")
    doubled = F.lit(classes) * F.pow(F.lit(2.0), F.floor(F.log2(fit / classes))).cast("bigint")
    return F.when(fit <= classes, fit).otherwise(doubled)


def pieces(docs: DataFrame, id_col: str, length: Column, capacity: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cut every document into pieces of at most ``capacity``; only the last may be shorter."""
    held = docs.select(F.col(id_col).alias("doc_id"), length.cast("bigint").alias("_len"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    cut = held.where("_len > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_len") / capacity).cast("int") - 1)))
    start = F.col("piece").cast("bigint") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("_len") - start).alias("length"), *[f"_k_{c}" for c in keep])


def harmonic_pack(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Place every document's pieces in bins: ``doc_id, piece, start, length, shard, size_class, bin, slot, bin_offset``.

    ``length`` defaults to the characters of ``text``; a column of token counts serves as well.
    A piece of class i is at most capacity/i long, so i of them always fit, and each class fills
    its bins with i pieces in order of the id, without looking at any other class. What is filled together is a shard,
    which a hash of id and length chooses; there is one for every ``shard_rows`` rows of ``docs``, whatever the ids
    are. No bin is shared between shards, so shards are packed by different workers at once, and each leaves at
    most one bin of a class unfilled. Only ids and lengths are shuffled, never texts; pieces alike in all are counted before that. ``keep``
    names columns (keys, say) that stay with the pieces.

    Null and empty texts take no space and give no row; a null id is packed like any other. Repeated
    rows are packed as often as they occur, ties in any order (such rows are the same). Texts
    longer than the capacity fill bins of their own, their rest is packed like any document.
    An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    size = F.length("text") if length is None else length
    shards = max(1, -(-docs.count() // shard_rows))
    cut = pieces(docs, id_col, size, capacity, keep)
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("piece").cast("string"), F.lit("|"), F.col("length").cast("string")))
    shard = F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint") % shards
    placed = cut.withColumn("shard", shard).withColumn("size_class", size_class(F.col("length"), capacity))
    counted = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy("shard", "size_class").orderBy("doc_id", "piece", "length", *[f"_k_{c}" for c in keep])
    last = counted.withColumn("_end", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = last.withColumn("_n", F.explode(F.sequence(F.col("_end") - F.col("_c"), F.col("_end") - 1)))
    binned = ranked.withColumn("bin", F.floor(F.col("_n") / F.col("size_class")).cast("bigint")).withColumn("slot", F.col("_n") % F.col("size_class"))
    within = Window.partitionBy("shard", "size_class", "bin").orderBy("slot")
    return binned.withColumn("bin_offset", F.sum("length").over(within) - F.col("length")).select(
        "doc_id", "piece", "start", "length", "shard", "size_class", "bin", "slot", "bin_offset", *[F.col(f"_k_{c}").alias(c) for c in keep]
    )


def packing_sql(source: str = "documents", capacity: int = CAPACITY, shard: int = SHARD) -> str:
    """DuckDB SQL for :func:`harmonic_pack` with its defaults."""
    mark = "md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(piece AS VARCHAR) || '|' || CAST(length AS VARCHAR))"
    return f"""
WITH cut AS (
  SELECT doc_id, CAST(p AS INTEGER) AS piece, CAST(p * {capacity} AS BIGINT) AS start,
         CAST(least({capacity}, length(text) - p * {capacity}) AS BIGINT) AS length
  FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / {capacity}.0) AS BIGINT))) AS p FROM {source} WHERE length(text) > 0)),
fit AS (SELECT *, {capacity} // length AS f, CAST(CAST('0x' || substr({mark}, 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM {source}) / {shard}.0) AS BIGINT)) AS BIGINT) AS shard FROM cut),
placed AS (SELECT doc_id, piece, start, length, shard,
    CAST(CASE WHEN f <= {CLASSES} THEN f ELSE {CLASSES} * power(2, floor(log2(f / {CLASSES}.0))) END AS BIGINT) AS size_class FROM fit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY shard, size_class ORDER BY doc_id NULLS FIRST, piece, length) - 1 AS n FROM placed)
SELECT doc_id, piece, start, length, shard, size_class, CAST(n // size_class AS BIGINT) AS bin, CAST(n % size_class AS BIGINT) AS slot,
  CAST(sum(length) OVER (PARTITION BY shard, size_class, n // size_class ORDER BY n) - length AS BIGINT) AS bin_offset
FROM ranked"""
