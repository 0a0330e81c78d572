"""Features of posts, of posts in their conversations, of conversations and of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.functions import harmonic, text
from threadweave.operators import entropy, graph, merge, stats, timing
from threadweave.session import cut

KEY = ["convo_id", "uid"]
MIXING = list(harmonic.KEYS)
POST_BOOLS = ["is_source"]
POST_INTS = ["?_count", "!_count", "char_count", "emoji_count", "hashtag_count", "mention_count", "out_degree", "punct_count", "token_count", "type_count", "uppercase_count", "url_count"]
POST_FLOATS = MIXING
POST_STRS = ["emojis", "hashtags", "mentions", "tokens", "urls"]
POST_CATEGORICALS = ["author", "lang", "platform"]
CONVO_POST_BOOLS = ["is_source", "is_leaf", "is_internal", "is_author_source_author"]
CONVO_POST_INTS = [*POST_INTS, "degree", "in_degree", "depth", "width"]
CONVO_POST_FLOATS = [*MIXING, "relative_age", "response_time", *entropy.NAMES]
CONVO_POST_NUMBERS = [*CONVO_POST_FLOATS, *CONVO_POST_INTS]
SUMMED_INTS = [i for i in CONVO_POST_INTS if i not in ("type_count", "depth", "width")]
COUNTED_BOOLS = {b: b.removeprefix("is_") + "_count" for b in CONVO_POST_BOOLS}
USER_BOOLS = ["is_source_author"]
USER_INTS = ["message_count", "types", *COUNTED_BOOLS.values(), *SUMMED_INTS]
POST_STATS = [f"post_{s}_{f}" for f in CONVO_POST_NUMBERS for s in stats.STATS]
USER_FLOATS = [*MIXING, "avg_user_token_entropy", *POST_STATS]
USER_STATS = [f"user_{s}_{f}" for f in [*USER_FLOATS, *USER_INTS] for s in stats.STATS]
CONVO_FLOATS = [*MIXING, "duration", "density", *POST_STATS, *USER_STATS]
CONVO_INTS = ["messages", "tree_degree", "tree_depth", "tree_width", "types", "users", *COUNTED_BOOLS.values(), *SUMMED_INTS]
ACROSS_FLOATS = [*MIXING, *POST_STATS]
ACROSS_INTS = [*USER_INTS, "source_author_count"]


def tokens() -> Column:
    return text.partition_tokens(F.col("text"))


def post_ints(posts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The twelve integer features of every post by itself, in columns of type bigint."""
    t, platform = F.col("text"), F.col("platform")
    with_tokens = posts.withColumn("_tokens", tokens())
    made = {
        "?_count": text.count(t, "[?]"), "!_count": text.count(t, "[!]"), "char_count": F.length(t),
        "emoji_count": text.count(t, text.EMOJI), "hashtag_count": text.count(t, text.HASHTAG), "mention_count": F.size(text.mentions(t, platform)),
        "out_degree": F.size(F.coalesce("reply_to", F.array())), "punct_count": text.count(t, r"""[,.?!;'"]"""),
        "token_count": F.size("_tokens"), "type_count": F.size(F.array_distinct("_tokens")), "uppercase_count": text.count(t, "[A-Z]"), "url_count": text.count(t, text.URL),
    }
    return with_tokens.select(*(keep or KEY), *[made[n].cast("bigint").alias(n) for n in POST_INTS])


def post_strings(posts: DataFrame) -> DataFrame:
    """Emojis, hashtags, mentions, tokens and URLs of every post."""
    t = F.col("text")
    return posts.select(*KEY, text.emojis(t).alias("emojis"), text.hashtags(t).alias("hashtags"), text.mentions(t, F.col("platform")).alias("mentions"), tokens().alias("tokens"), text.urls(t).alias("urls"))


def post_features(posts: DataFrame) -> DataFrame:
    """All features of posts by themselves: ids, categories, flags, floats, ints."""
    floats = posts.withColumns({"_source": F.size(F.coalesce("reply_to", F.array())) == 0, "_mixing": harmonic.mixing_of_tokens(tokens())})
    both = post_ints(floats, [*KEY, *POST_CATEGORICALS, "_source", "_mixing"])
    return both.select(*KEY, *POST_CATEGORICALS, F.col("_source").alias("is_source"), *[F.col(f"_mixing.{k}").alias(k) for k in MIXING], *[f"`{c}`" for c in POST_INTS])


def post_in_convo_features(posts: DataFrame) -> DataFrame:
    """All features of posts in their conversations, once, for every aggregate to share.

    ``degree`` is the depth, as the compared library has it; ``true_degree`` is the degree.
    """
    alone = post_features(posts).drop("is_source")
    place = entropy.with_structure(posts).drop("out_degree").withColumn("degree", F.col("depth"))
    out = alone.join(place, KEY)
    ints = [F.col(f"`{c}`").cast("bigint").alias(c) for c in CONVO_POST_INTS]
    return out.select(*KEY, *POST_CATEGORICALS, *CONVO_POST_BOOLS, *[f"`{c}`" for c in CONVO_POST_FLOATS], *ints, "true_degree")


def type_frequencies(posts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(keys, token, n)``; by author, posts without one are left out."""
    own = posts.where(F.col("author").isNotNull()) if "author" in keys else posts
    return entropy.token_counts(own, keys)


def mixing_features(posts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Harmonic fit of each group's type frequencies; zeros for a group without tokens (or a null author)."""
    fitted = type_frequencies(posts, keys).groupBy(*keys).agg(F.collect_list("n").alias("f")).withColumn("m", harmonic.mixing(F.col("f")))
    groups = posts.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    joined = groups.join(fitted, same, "left")
    return joined.select(*[F.col(f"_{k}").alias(k) for k in keys], *[F.coalesce(f"m.{x}", F.lit(0.0)).alias(x) for x in MIXING])


def summed_bools(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(*[F.sum(F.col(b).cast("bigint")).alias(n) for b, n in COUNTED_BOOLS.items()])


def summed_ints(features: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the integer features but for types, depth and width (``degree`` sums depths)."""
    return features.groupBy(*keys).agg(*[F.sum(f"`{c}`").alias(c) for c in SUMMED_INTS])


def convo_post_stats(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(convo_id, feature, value)``: five statistics of the 59 numeric post features of each conversation, long. ``passed``, here and below: what ``whole.pass_over`` gives, if it is there already."""
    return _convo_slice(posts, passed, POST_STATS)


def convo_user_stats(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(convo_id, feature, value)``: five statistics of the 320 numbers of each conversation's users, long."""
    return _convo_slice(posts, passed, USER_STATS)


def _convo_slice(posts: DataFrame, passed: DataFrame | None, names: list[str]) -> DataFrame:
    from threadweave.operators import whole

    passed = whole.pass_over(posts) if passed is None else passed
    part = F.slice("v", whole.CONVO.index(names[0]) + 1, len(names))
    return stats.named_values(passed.select("convo_id", part.alias("v")), ["convo_id"], names)


def user_numbers(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(convo_id, author, feature, value)``: the 320 numbers of each user in a conversation, long."""
    from threadweave.operators import whole

    return stats.named_values(whole.user_rows(whole.pass_over(posts) if passed is None else passed), ["convo_id", "author"], whole.USER)


def user_bools(posts: DataFrame) -> DataFrame:
    """``(convo_id, author, is_source_author)``."""
    s = graph.source_authors(posts).select(F.col("convo_id").alias("_c"), F.col("author").alias("_a"))
    users = posts.select("convo_id", "author").distinct()
    return users.join(s, (F.col("convo_id") == F.col("_c")) & F.col("author").eqNullSafe(F.col("_a")), "left").select("convo_id", "author", F.col("_c").isNotNull().alias("is_source_author"))


def convo_numbers(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(convo_id, feature, value)``: the 1925 numbers of each conversation, long."""
    from threadweave.operators import whole

    return stats.named_values(whole.pass_over(posts) if passed is None else passed, ["convo_id"], whole.CONVO)


def convo_distributions(posts: DataFrame) -> DataFrame:
    """``(convo_id, counter, value, n)``: the six counters of each conversation, long."""
    keyed = lambda df, name, column: df.select("convo_id", F.lit(name).alias("counter"), F.col(column).cast("string").alias("value"), "n")
    users = posts.groupBy("convo_id", "author").agg(F.count(F.lit(1)).alias("size")).groupBy("convo_id", "size").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        keyed(graph.degree_distribution(posts, "true_degree"), "degree_size_distribution", "degree"),
        keyed(graph.degree_distribution(posts, "in_degree"), "degree_in_size_distribution", "degree"),
        keyed(graph.degree_distribution(posts, "out_degree"), "degree_out_size_distribution", "degree"),
        keyed(graph.depth_distribution(posts), "depth_distribution", "depth"),
        keyed(type_frequencies(posts, ("convo_id",)), "type_frequency_distribution", "token"),
        keyed(users, "user_size_distribution", "size"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def user_across_numbers(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(author, feature, value)``: the 320 numbers of each user over all conversations, long. Null authors are left out."""
    from threadweave.operators import whole

    passed = cut(whole.pass_over(posts)) if passed is None else passed
    own = whole.post_rows(passed).where(F.col("author").isNotNull())
    mixed = mixing_features(merge.posts_across(posts), ("author",))
    ints = [F.sum(F.col("v")[whole.USER.index(i)]).alias(i) for i in USER_INTS]
    inside = whole.user_rows(passed).where(F.col("author").isNotNull()).groupBy("author").agg(*ints, F.sum(F.col("is_source_author").cast("double")).alias("source_author_count"))
    return (
        stats.to_long(mixed, ["author"], MIXING)
        .unionByName(stats.five_of_columns(own, CONVO_POST_NUMBERS, "post", "author"))
        .unionByName(stats.to_long(inside, ["author"], ACROSS_INTS))
    )


def user_stats_across(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(author, feature, value)``: five statistics of each user's numbers over their conversations."""
    from threadweave.operators import whole

    own = whole.user_rows(whole.pass_over(posts) if passed is None else passed).where(F.col("author").isNotNull())
    return stats.five_of_columns(own, whole.USER, "user", "author", guard=True)


def convo_stats(posts: DataFrame, passed: DataFrame | None = None) -> DataFrame:
    """``(feature, value)``: five statistics of the conversations' numbers over all of them."""
    from threadweave.operators import whole

    return stats.five_of_columns(whole.pass_over(posts) if passed is None else passed, whole.CONVO, "convo", guard=True)
