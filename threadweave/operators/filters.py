"""Selections of posts; each takes and returns a posts table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_posts(
    posts: DataFrame,
    by_langs: Iterable[str] | None = None,
    min_chars: int = 0,
    before=None,
    after=None,
    by_tags: Iterable[str] | None = None,
    by_platform: Iterable[str] | None = None,
    by_author: str | None = None,
) -> DataFrame:
    """Posts that pass every given test.

    A null language, author or time fails the test that looks at it; before and after are strict;
    all of ``by_tags`` must be there. Empty collections and None test nothing.
    """
    tests: list[Column] = []
    if by_author is not None:
        tests.append(F.col("author") == by_author)
    if min_chars:
        tests.append(F.length("text") >= min_chars)
    if by_langs:
        tests.append(F.col("lang").isin(*by_langs))
    if before is not None:
        tests.append(F.col("created_at") < F.lit(before))
    if after is not None:
        tests.append(F.col("created_at") > F.lit(after))
    if by_tags:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, by_tags)), "tags")) == 0)
    if by_platform:
        tests.append(F.col("platform").isin(*by_platform))
    for test in tests:
        posts = posts.where(test)
    return posts


def user_posts(posts: DataFrame, user: str | None) -> DataFrame:
    """The posts of one author; none for None."""
    return posts.where(F.lit(False) if user is None else F.col("author") == user)


def matching(posts: DataFrame, predicate: Column) -> DataFrame:
    """Posts for which any predicate holds; compare authors with ``eqNullSafe`` to match null ones."""
    return posts.where(predicate)


def remove_posts(posts: DataFrame, uids: DataFrame) -> DataFrame:
    """Posts whose (convo_id, uid) isn't in ``uids``."""
    return posts.join(uids.select("convo_id", "uid").distinct(), ["convo_id", "uid"], "left_anti")


def add_to_set(posts: DataFrame, column: str, value: str) -> DataFrame:
    """Add an element to ``tags`` or ``reply_to``."""
    return posts.withColumn(column, F.array_union(column, F.array(F.lit(value))))


def remove_from_set(posts: DataFrame, column: str, value: str) -> DataFrame:
    """Take an element out of ``tags`` or ``reply_to``; a post without it raises when it is read."""
    missing = F.raise_error(F.concat(F.lit(f"{value} isn't in {column} of "), F.col("uid")))
    return posts.withColumn(column, F.when(F.array_contains(column, value), F.array_remove(column, value)).otherwise(missing))


def set_text(posts: DataFrame, text: Column) -> DataFrame:
    """Replace the text; the language is then unknown."""
    return posts.withColumn("text", text).withColumn("lang", F.lit(None).cast("string"))
