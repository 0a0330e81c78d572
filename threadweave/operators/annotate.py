"""Tags from annotation tables, and posts joined with sums of their conversation and author."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def annotate(posts: DataFrame, splits: list[tuple[str, DataFrame]], name: str = "label", key: str = "uid") -> DataFrame:
    """Add tags ``split=<S>`` and ``<name>=<value>`` from the first of the tables (split, (key, value)) that has a post's key.

    A key that a table has more than once counts with its least value. Spark broadcasts a
    table by its size; none is forced."""
    found: list[Column] = []
    for i, (split, table) in enumerate(splits):
        one = table.groupBy(F.col(key).cast("string").alias("uid")).agg(F.min("value").cast("string").alias(f"_v{i}"))
        posts = posts.join(one, "uid", "left")
        found.append(F.when(F.col(f"_v{i}").isNotNull(), F.array(F.lit(f"split={split}"), F.concat(F.lit(f"{name}="), f"_v{i}"))))
    none = F.array().cast("array<string>")
    tagged = posts.withColumn("tags", F.array_union("tags", F.coalesce(*found, none)))
    return tagged.drop(*[f"_v{i}" for i in range(len(splits))])


def with_context(features: DataFrame, sums: list[str]) -> DataFrame:
    """Post rows with the sums of chosen columns over their conversation (``convo_<c>``) and over their author everywhere (``author_<c>``)."""
    total = lambda keys, prefix: features.groupBy(*keys).agg(*[F.sum(f"`{c}`").alias(f"{prefix}_{c}") for c in sums])
    by_author = total(["author"], "author").withColumnRenamed("author", "_a")
    joined = features.join(total(["convo_id"], "convo"), "convo_id").join(by_author, F.col("author").eqNullSafe(F.col("_a")))
    return joined.drop("_a")
