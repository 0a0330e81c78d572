"""Every named query of the core library with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadweave.functions import harmonic, text
from threadweave.operators import annotate, entropy, features, filters, graph, merge, redaction, stats, timing, vectorize, whole
from threadweave.plans import metrics
from threadweave.plans.sqlparts import ABOVE, DEGREE, DEPTH, EDGES, TOKENS, WORDS, query
from threadweave.session import cut
from threadweave.sources import samples
from threadweave.sources.adapters import conversation_posts, document_posts, event_posts

FLAGSHIP = "int_sums"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def named(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL if there is one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(f"`{c}`").cast("double"), digits))
    return df


# -- projections and filters

DOCS = "docs AS (SELECT source AS convo_id, doc_id AS seq, CAST(doc_id AS VARCHAR) AS uid, coalesce(text, '') AS text, lang FROM documents)"


@named(
    "filter_all",
    f"WITH {DOCS} SELECT convo_id, uid FROM docs WHERE lang IN ('en', 'fr') AND length(text) >= 500",
)
def filter_all(spark, sf):
    return filters.filter_posts(document_posts(spark, sf), by_langs=["en", "fr"], min_chars=500, by_platform=["Twitter"]).select("convo_id", "uid")


@named("filter_time_tags", query("SELECT convo_id, uid FROM posts WHERE sec < 1704500000 AND sec > 1704100000 AND author = 'user' AND platform IN ('Reddit', '4chan') AND lang IN ('en', 'de')"))
def filter_time_tags(spark, sf):
    import datetime as dt

    when = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    return filters.filter_posts(conversation_posts(spark, sf), before=when(1_704_500_000), after=when(1_704_100_000), by_tags=["role=user"], by_author="user", by_platform=["Reddit", "4chan"], by_langs=["en", "de"]).select("convo_id", "uid")


@named("user_posts", query("SELECT convo_id, uid FROM posts WHERE author = 'assistant'"))
def user_posts(spark, sf):
    return filters.user_posts(conversation_posts(spark, sf), "assistant").select("convo_id", "uid")


@named("sources", query("SELECT convo_id, uid FROM posts WHERE uid NOT IN (SELECT child FROM edges)", EDGES, shape="external"))
def sources(spark, sf):
    return graph.sources(conversation_posts(spark, sf, "external")).select("convo_id", "uid")


@named("remove_posts", query("SELECT convo_id, uid FROM posts p WHERE uid NOT IN (SELECT child FROM edges)", EDGES))
def remove_posts(spark, sf):
    posts = conversation_posts(spark, sf)
    replies = graph.edges(posts).select("convo_id", F.col("child").alias("uid"))
    return filters.remove_posts(posts, replies).select("convo_id", "uid")


# -- joins of the reply graph

for _kind, _relation, _sql in (
    ("parents", graph.parents, "SELECT convo_id, child AS uid, parent AS member FROM edges"),
    ("children", graph.children, "SELECT convo_id, parent AS uid, child AS member FROM edges"),
    ("siblings", graph.siblings, "SELECT DISTINCT a.convo_id, a.child AS uid, b.child AS member FROM edges a JOIN edges b ON a.convo_id = b.convo_id AND a.parent = b.parent AND a.child <> b.child"),
):
    named(_kind, query(_sql, EDGES, shape="dag"))(lambda spark, sf, r=_relation: r(conversation_posts(spark, sf, "dag")))

named("siblings_with_self", query(
    "SELECT DISTINCT a.convo_id, a.child AS uid, b.child AS member FROM edges a JOIN edges b ON a.convo_id = b.convo_id AND a.parent = b.parent UNION SELECT convo_id, uid, uid FROM posts", EDGES,
))(lambda spark, sf: graph.siblings(conversation_posts(spark, sf), True))
named("ancestors", query("SELECT * FROM above", EDGES, ABOVE, shape="dag"))(lambda spark, sf: graph.ancestors(conversation_posts(spark, sf, "dag")))
named("descendants", query("SELECT convo_id, member AS uid, uid AS member FROM above", EDGES, ABOVE, shape="dag"))(lambda spark, sf: graph.descendants(conversation_posts(spark, sf, "dag")))
named("before", query("SELECT a.convo_id, a.uid, b.uid AS member FROM posts a JOIN posts b ON a.convo_id = b.convo_id AND b.sec < a.sec"))(lambda spark, sf: graph.before_after(conversation_posts(spark, sf)))
named("after", query("SELECT a.convo_id, a.uid, b.uid AS member FROM posts a JOIN posts b ON a.convo_id = b.convo_id AND b.sec > a.sec"))(lambda spark, sf: graph.before_after(conversation_posts(spark, sf), True))
named("before_untimed", query("SELECT a.convo_id, a.uid, b.uid AS member FROM posts a JOIN posts b ON a.convo_id = b.convo_id", timed=False))(lambda spark, sf: graph.before_after(conversation_posts(spark, sf, timed=False)))
named("graph_edges", query("SELECT DISTINCT convo_id, least(child, parent) AS a, greatest(child, parent) AS b FROM edges", EDGES, shape="dag"))(lambda spark, sf: graph.as_graph(conversation_posts(spark, sf, "dag"))[1])


# -- merges

HALVES = (
    "halves AS (SELECT convo_id, seq, uid, text, author, sec, 1 AS part FROM posts WHERE author <> 'system' "
    "UNION ALL SELECT convo_id, seq, uid, substr(text, 1, 40) || '...' AS text, NULL AS author, sec + 5 AS sec, 0 AS part FROM posts WHERE author <> 'user'), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY part, seq) AS n FROM halves)"
)


@named(
    "merge_union",
    query(
        "SELECT convo_id, uid, arg_max(text, length(text) * 1000 - n) AS text, max(author) AS author, CAST(min(sec) AS BIGINT) AS sec FROM placed GROUP BY 1, 2", HALVES,
    ),
)
def merge_union(spark, sf):
    posts = conversation_posts(spark, sf)
    a = posts.where("author <> 'system'")
    b = posts.where("author <> 'user'").withColumns({"text": F.concat(F.substring("text", 1, 40), F.lit("...")), "author": F.lit(None).cast("string"), "created_at": F.col("created_at") + F.expr("interval 5 seconds")})
    return merge.union_conversations(a, b).select("convo_id", "uid", "text", "author", F.unix_seconds("created_at").alias("sec"))


@named("difference", query("SELECT convo_id, uid FROM posts WHERE author <> 'system'"))
def difference(spark, sf):
    posts = conversation_posts(spark, sf)
    return merge.difference(posts, posts.where("author = 'system'")).select("convo_id", "uid")


@named("posts_across", query("SELECT author, count(DISTINCT uid) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM posts GROUP BY 1"))
def posts_across(spark, sf):
    own = merge.posts_across(conversation_posts(spark, sf))
    return own.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


# -- graph measures

named("depth_width", query("SELECT convo_id, uid, depth, count(*) OVER (PARTITION BY convo_id, depth) AS width FROM depths", EDGES, DEPTH, shape="dag"))(
    lambda spark, sf: graph.widths(graph.depths(conversation_posts(spark, sf, "dag")))
)
named("depth_distribution", query("SELECT convo_id, depth, count(*) AS n FROM depths GROUP BY 1, 2", EDGES, DEPTH))(lambda spark, sf: graph.depth_distribution(conversation_posts(spark, sf)))
named(
    "tree_metrics",
    query(
        "SELECT a.convo_id, tree_depth, tree_width, tree_degree FROM (SELECT convo_id, max(depth) AS tree_depth, max(w) AS tree_width FROM "
        "(SELECT convo_id, depth, count(*) OVER (PARTITION BY convo_id, depth) AS w FROM depths) GROUP BY 1) a "
        "JOIN (SELECT convo_id, CAST(max(true_degree) AS BIGINT) AS tree_degree FROM degrees GROUP BY 1) USING (convo_id)",
        EDGES, DEPTH, DEGREE,
    ),
)(lambda spark, sf: graph.tree_metrics(conversation_posts(spark, sf)))
named("degrees", query("SELECT convo_id, uid, in_degree, out_degree, CAST(true_degree AS BIGINT) AS true_degree FROM degrees", EDGES, DEGREE, shape="external"))(lambda spark, sf: graph.degrees(conversation_posts(spark, sf, "external")))
for _kind in ("true_degree", "in_degree", "out_degree"):
    named(f"degree_distribution_{_kind.split('_')[0]}", query(f"SELECT convo_id, CAST({_kind} AS BIGINT) AS degree, count(*) AS n FROM degrees GROUP BY 1, 2", EDGES, DEGREE, shape="dag"))(
        lambda spark, sf, k=_kind: graph.degree_distribution(conversation_posts(spark, sf, "dag"), k)
    )
named(
    "density",
    query(
        "SELECT convo_id, round(CASE WHEN n <= 1 OR m IS NULL THEN 0.0 ELSE 2.0 * m / (n * (n - 1)) END, 9) AS density FROM (SELECT convo_id, count(*) AS n FROM posts GROUP BY 1) "
        "LEFT JOIN (SELECT convo_id, count(*) AS m FROM (SELECT DISTINCT convo_id, least(child, parent), greatest(child, parent) FROM edges) GROUP BY 1) USING (convo_id)",
        EDGES, shape="dag",
    ),
)(lambda spark, sf: _rounded(graph.density(conversation_posts(spark, sf, "dag")), "density"))
named(
    "flags",
    query(
        "SELECT d.convo_id, d.uid, out_degree = 0 AS is_source, in_degree = 0 AS is_leaf, in_degree <> 0 AND out_degree <> 0 AS is_internal, "
        "EXISTS (SELECT 1 FROM posts s WHERE s.convo_id = d.convo_id AND s.author = p.author AND s.uid NOT IN (SELECT child FROM edges)) AS is_author_source_author "
        "FROM degrees d JOIN posts p ON p.convo_id = d.convo_id AND p.uid = d.uid",
        EDGES, DEGREE, shape="external",
    ),
)(lambda spark, sf: graph.flags(conversation_posts(spark, sf, "external")))
named("derived_ids", query("SELECT convo_id, 'CONV_' || string_agg(uid, '-' ORDER BY CAST(uid AS BIGINT)) AS derived_id FROM posts WHERE uid NOT IN (SELECT child FROM edges) GROUP BY 1", EDGES))(
    lambda spark, sf: graph.derived_ids(conversation_posts(spark, sf))
)

EVENTS = (
    "ev AS (SELECT CAST(user_id AS VARCHAR) AS convo_id, CAST(event_id AS VARCHAR) AS uid, event_type AS author, value, ts, row_number() OVER w AS seq, lag(event_id) OVER w AS prev "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "runs AS (SELECT *, sum(CASE WHEN value > 50.0 AND prev IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY convo_id ORDER BY seq) AS run FROM ev)"
)


@named("components", f"WITH {EVENTS} SELECT 'CONV_' || first(uid ORDER BY seq) AS convo_id, count(*) AS n FROM runs GROUP BY runs.convo_id, run")
def components(spark, sf):
    return graph.segment(event_posts(spark, sf)).groupBy("convo_id").agg(F.count(F.lit(1)).alias("n"))


@named(
    "event_response_time",
    f"WITH {EVENTS} SELECT e.convo_id, e.uid, CASE WHEN e.value > 50.0 AND p.uid IS NOT NULL THEN round(abs(epoch_us(e.ts) - epoch_us(p.ts)) / 1e6, 6) ELSE -1.0 END AS response_time "
    "FROM ev e LEFT JOIN ev p ON p.convo_id = e.convo_id AND p.seq = e.seq - 1",
)
def event_response_time(spark, sf):
    return _rounded(timing.response_time(event_posts(spark, sf)), "response_time", digits=6)


# -- time

named("time_order", query("SELECT convo_id, uid, CAST(row_number() OVER (PARTITION BY convo_id ORDER BY sec, seq) - 1 AS INTEGER) AS place FROM posts"))(lambda spark, sf: timing.time_order(conversation_posts(spark, sf)))
named("text_stream_untimed", query("SELECT convo_id, string_agg(text, '\n' ORDER BY seq) AS stream FROM posts GROUP BY 1", timed=False))(
    lambda spark, sf: timing.text_stream(conversation_posts(spark, sf, timed=False)).select("convo_id", F.array_join("texts", "\n").alias("stream"))
)
named("text_stream", query("SELECT convo_id, string_agg(text, '\n' ORDER BY sec, seq) AS stream FROM posts GROUP BY 1"))(
    lambda spark, sf: timing.text_stream(conversation_posts(spark, sf)).select("convo_id", F.array_join("texts", "\n").alias("stream"))
)
named("time_series", query("SELECT convo_id, uid, CAST(row_number() OVER (PARTITION BY convo_id ORDER BY sec, seq) - 1 AS INTEGER) AS place, CAST(sec - min(sec) OVER (PARTITION BY convo_id) AS DOUBLE) AS second FROM posts"))(
    lambda spark, sf: timing.time_series(conversation_posts(spark, sf))
)
named("duration", query("SELECT convo_id, CAST(max(sec) - min(sec) AS DOUBLE) AS duration FROM posts GROUP BY 1"))(lambda spark, sf: timing.duration(conversation_posts(spark, sf)))
named("duration_untimed", query("SELECT convo_id, CAST(-1.0 AS DOUBLE) AS duration FROM posts GROUP BY 1", timed=False))(lambda spark, sf: timing.duration(conversation_posts(spark, sf, timed=False)))
named("relative_age", query("SELECT convo_id, uid, CAST(sec - min(sec) OVER (PARTITION BY convo_id) AS DOUBLE) AS relative_age FROM posts"))(lambda spark, sf: timing.relative_age(conversation_posts(spark, sf)))
named(
    "response_time",
    query(
        "SELECT p.convo_id, p.uid, CAST(coalesce(min(abs(p.sec - q.sec)), -1) AS DOUBLE) AS response_time FROM posts p LEFT JOIN edges e ON e.convo_id = p.convo_id AND e.child = p.uid "
        "LEFT JOIN posts q ON q.convo_id = e.convo_id AND q.uid = e.parent GROUP BY 1, 2",
        EDGES, shape="dag",
    ),
)(lambda spark, sf: timing.response_time(conversation_posts(spark, sf, "dag")))


# -- aggregates

named("messages_per_user", query("SELECT convo_id, author, count(*) AS n FROM posts GROUP BY 1, 2"))(
    lambda spark, sf: conversation_posts(spark, sf).groupBy("convo_id", "author").agg(F.count(F.lit(1)).alias("n"))
)
named("authors", query("SELECT DISTINCT convo_id, author FROM posts"))(lambda spark, sf: conversation_posts(spark, sf).select("convo_id", "author").distinct())
named("user_size_distribution", query("SELECT convo_id, CAST(size AS VARCHAR) AS value, count(*) AS n FROM (SELECT convo_id, author, count(*) AS size FROM posts GROUP BY 1, 2) GROUP BY 1, 2"))(
    lambda spark, sf: features.convo_distributions(conversation_posts(spark, sf)).where("counter = 'user_size_distribution'").select("convo_id", "value", "n")
)
named("type_freq_post", query("SELECT convo_id, uid, token, count(*) AS n FROM tok GROUP BY 1, 2, 3", TOKENS))(lambda spark, sf: entropy.token_counts(conversation_posts(spark, sf), ("convo_id", "uid")))
named("type_freq_convo", query("SELECT convo_id, token, count(*) AS n FROM tok GROUP BY 1, 2", TOKENS))(lambda spark, sf: features.type_frequencies(conversation_posts(spark, sf), ("convo_id",)))
named("type_freq_user", query("SELECT convo_id, author, token, count(*) AS n FROM tok GROUP BY 1, 2, 3", TOKENS))(lambda spark, sf: features.type_frequencies(conversation_posts(spark, sf), ("convo_id", "author")))

_URL = text.URL.replace("'", "''")
_HASHTAG = r"\B#[a-zA-Z]+\b"
_MENTIONS = (
    r"CASE platform WHEN 'Twitter' THEN regexp_extract_all(text, '(^|[^\w@])@(\w{1,15})\b') WHEN 'Reddit' THEN regexp_extract_all(text, '(^|\W)/?u/([0-9A-Z_a-z-]+)\b') "
    r"WHEN '4chan' THEN regexp_extract_all(text, '>>(\d+)') ELSE [] END"
)
INTS = (
    "ints AS (SELECT p.convo_id, p.uid, p.author, p.platform, CAST(len(regexp_extract_all(text, '[?]')) AS BIGINT) AS \"?_count\", CAST(len(regexp_extract_all(text, '[!]')) AS BIGINT) AS \"!_count\", "
    f"length(text) AS char_count, CAST(len(regexp_extract_all(text, '{text.EMOJI}')) AS BIGINT) AS emoji_count, CAST(len(regexp_extract_all(text, '{_HASHTAG}')) AS BIGINT) AS hashtag_count, "
    f"CAST(len({_MENTIONS}) AS BIGINT) AS mention_count, CAST(len(reply_to) AS BIGINT) AS out_degree, "
    "CAST(len(regexp_extract_all(text, '[,.?!;''\"]')) AS BIGINT) AS punct_count, "
    f"CAST(len(regexp_extract_all(text, '{WORDS}')) AS BIGINT) AS token_count, CAST(len(list_distinct(regexp_extract_all(text, '{WORDS}'))) AS BIGINT) AS type_count, "
    f"CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS uppercase_count, CAST(len(regexp_extract_all(text, '{_URL}')) AS BIGINT) AS url_count FROM posts p)"
)
_CELLS = ", ".join(f'"{c}"' for c in features.POST_INTS)
named("post_ints", query(f"SELECT convo_id, uid, {_CELLS} FROM ints", INTS))(lambda spark, sf: features.post_ints(conversation_posts(spark, sf)))

FULL_INTS = (
    "full_ints AS (SELECT i.*, d.in_degree, depth, depth AS degree, count(*) OVER (PARTITION BY i.convo_id, depth) AS width FROM ints i JOIN degrees d USING (convo_id, uid) JOIN depths USING (convo_id, uid))"
)


def _sums(keys: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in features.SUMMED_INTS) + f" FROM full_ints GROUP BY {keys}"


def light_features(posts: DataFrame) -> DataFrame:
    """The integer features of posts in their conversations, without fits and entropies."""
    place = graph.structure(posts).select("convo_id", "uid", "depth", "width", F.col("depth").cast("bigint").alias("degree"), "in_degree")
    return features.post_ints(posts, ["convo_id", "uid", "author"]).join(place, ["convo_id", "uid"])


named("int_sums", query(_sums("convo_id"), EDGES, DEPTH, DEGREE, INTS, FULL_INTS))(lambda spark, sf: features.summed_ints(light_features(conversation_posts(spark, sf)), ["convo_id"]))
named("int_sums_user", query(_sums("convo_id, author"), EDGES, DEPTH, DEGREE, INTS, FULL_INTS))(lambda spark, sf: features.summed_ints(light_features(conversation_posts(spark, sf)), ["convo_id", "author"]))
named(
    "bool_sums",
    query(
        "SELECT d.convo_id, CAST(sum(CASE WHEN out_degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS source_count, CAST(sum(CASE WHEN in_degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaf_count, "
        "CAST(sum(CASE WHEN in_degree <> 0 AND out_degree <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS internal_count, CAST(sum(CASE WHEN s.author IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS author_source_author_count "
        "FROM degrees d JOIN posts p USING (convo_id, uid) LEFT JOIN (SELECT DISTINCT convo_id, author FROM posts WHERE uid NOT IN (SELECT child FROM edges)) s ON s.convo_id = d.convo_id AND s.author = p.author GROUP BY 1",
        EDGES, DEGREE,
    ),
)(lambda spark, sf: features.summed_bools(graph.flags(conversation_posts(spark, sf)), ["convo_id"]))

_FEATURES = ["char_count", "token_count", "type_count", "punct_count", "depth", "width", "in_degree"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT convo_id, author, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM full_ints" for f in _FEATURES) + ")"


def _stats_sql(keys: str, prefix: str, guard: bool) -> str:
    std = "CASE WHEN count(*) <= 1 THEN 1.0 ELSE stddev_pop(value) END" if guard else "stddev_pop(value)"
    parts = {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "std": std}
    made = f"made AS (SELECT {keys}, feature, " + ", ".join(f"{e} AS {n}" for n, e in parts.items()) + f" FROM long GROUP BY {keys}, feature)"
    each = " UNION ALL ".join(f"SELECT {keys}, '{prefix}_{n}_' || feature AS feature, round({n}, 6) AS value FROM made" for n in parts)
    return query(each, EDGES, DEPTH, DEGREE, INTS, FULL_INTS, _LONG, made)


for _name, _keys, _prefix, _guard in (("post_stats", ["convo_id"], "post", False), ("user_post_stats", ["convo_id", "author"], "post", False), ("across_post_stats", ["author"], "post", True)):
    named(_name, _stats_sql(", ".join(_keys), _prefix, _guard))(
        lambda spark, sf, k=_keys, p=_prefix, g=_guard: _rounded(stats.five_stats(stats.to_long(light_features(conversation_posts(spark, sf)), k, _FEATURES), k, p, g), "value", digits=6)
    )


_USER_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT convo_id, author, '{f}' AS feature, CAST(sum({f}) AS DOUBLE) AS value FROM full_ints GROUP BY 1, 2" for f in ("char_count", "token_count", "punct_count", "in_degree")
) + ")"


def user_sums(spark, sf):
    return features.summed_ints(light_features(conversation_posts(spark, sf)), ["convo_id", "author"])


named("user_stats", _stats_sql("convo_id", "user", True).replace(_LONG, _USER_LONG))(
    lambda spark, sf: _rounded(stats.five_stats(stats.to_long(user_sums(spark, sf), ["convo_id"], ["char_count", "token_count", "punct_count", "in_degree"]), ["convo_id"], "user", True), "value", digits=6)
)
named(
    "user_across_ints",
    query(
        "SELECT author, count(DISTINCT convo_id) AS conversations, " + ", ".join(f'CAST(sum("{c}") AS BIGINT) AS "{c}"' for c in features.SUMMED_INTS)
        + ", (SELECT count(*) FROM (SELECT DISTINCT convo_id, author FROM posts WHERE uid NOT IN (SELECT child FROM edges)) s WHERE s.author = f.author) AS source_author_count FROM full_ints f GROUP BY author",
        EDGES, DEPTH, DEGREE, INTS, FULL_INTS,
    ),
)(lambda spark, sf: _across_ints(spark, sf))


def _across_ints(spark, sf):
    sums = user_sums(spark, sf).groupBy("author").agg(F.count(F.lit(1)).alias("conversations"), *[F.sum(f"`{c}`").alias(c) for c in features.SUMMED_INTS])
    source = features.user_bools(conversation_posts(spark, sf)).groupBy("author").agg(F.sum(F.col("is_source_author").cast("bigint")).alias("source_author_count"))
    return sums.join(source, "author")


named(
    "assembled",
    query(
        "SELECT convo_id, uid, char_count, token_count, CAST(sum(char_count) OVER c AS BIGINT) AS convo_char_count, CAST(sum(token_count) OVER c AS BIGINT) AS convo_token_count, "
        "CAST(sum(char_count) OVER a AS BIGINT) AS author_char_count, CAST(sum(token_count) OVER a AS BIGINT) AS author_token_count FROM ints WINDOW c AS (PARTITION BY convo_id), a AS (PARTITION BY author)",
        INTS,
    ),
)(
    lambda spark, sf: annotate.with_context(features.post_ints(conversation_posts(spark, sf), ["convo_id", "uid", "author"]).select("convo_id", "uid", "author", "char_count", "token_count"), ["char_count", "token_count"]).drop("author")
)
named(
    "annotated",
    f"WITH {DOCS} SELECT uid, CASE WHEN t.doc_id IS NOT NULL THEN 'split=TRAIN,label=' || t.quality WHEN d.doc_id IS NOT NULL THEN 'split=DEV,label=' || d.quality ELSE '' END AS tags "
    "FROM docs LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) t ON CAST(t.doc_id AS VARCHAR) = uid LEFT JOIN (SELECT * FROM labels WHERE toxic = 1) d ON CAST(d.doc_id AS VARCHAR) = uid",
)(lambda spark, sf: _annotated(spark, sf))


def _annotated(spark, sf):
    from threadweave.session import table

    part = lambda t: table(spark, sf, "labels").where(F.col("toxic") == t).select(F.col("doc_id").alias("uid"), F.col("quality").alias("value"))
    return annotate.annotate(document_posts(spark, sf), [("TRAIN", part(0)), ("DEV", part(1))]).select("uid", F.array_join("tags", ",").alias("tags"))


# -- entropy, mixing, novelty

REL = (
    "rel AS (SELECT convo_id, uid, 'full' AS split, m AS member FROM (SELECT a.convo_id, a.uid, b.uid AS m FROM posts a JOIN posts b USING (convo_id)) "
    + "".join(f"UNION SELECT convo_id, uid, '{s}', uid FROM posts " for s in entropy.SPLITS if s != "full")
    + "UNION SELECT convo_id, uid, 'ancestors', member FROM above UNION SELECT convo_id, member, 'descendants', uid FROM above "
    "UNION SELECT convo_id, child, 'parents', parent FROM edges UNION SELECT convo_id, parent, 'children', child FROM edges "
    "UNION SELECT a.convo_id, a.child, 'siblings', b.child FROM edges a JOIN edges b ON a.convo_id = b.convo_id AND a.parent = b.parent)"
)
PAIRS = (
    "names(l, r) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in entropy.PAIRS) + "), "
    "tf AS (SELECT convo_id, uid, token, count(*) AS n FROM tok GROUP BY 1, 2, 3), "
    "sizes AS (SELECT convo_id, uid, split, count(*) AS size FROM rel GROUP BY 1, 2, 3), "
    "left_side AS (SELECT rel.convo_id, rel.uid, split, token, sum(n) AS n FROM rel JOIN tf ON tf.convo_id = rel.convo_id AND tf.uid = rel.member GROUP BY 1, 2, 3, 4), "
    "left_size AS (SELECT convo_id, uid, split, sum(n) AS m FROM left_side GROUP BY 1, 2, 3), "
    "members AS (SELECT DISTINCT convo_id, uid, l, r, member FROM rel JOIN names ON split = l OR split = r), "
    "joint_size AS (SELECT convo_id, uid, l, r, count(*) AS size FROM members GROUP BY 1, 2, 3, 4), "
    "joint AS (SELECT m.convo_id, m.uid, l, r, token, sum(n) AS n FROM members m JOIN tf ON tf.convo_id = m.convo_id AND tf.uid = m.member GROUP BY 1, 2, 3, 4, 5), "
    "joint_total AS (SELECT convo_id, uid, l, r, sum(n) AS m, count(*) AS types FROM joint GROUP BY 1, 2, 3, 4), "
    "sums AS (SELECT j.convo_id, j.uid, j.l, j.r, sum(ln(j.n / t.m)) AS s FROM joint j JOIN joint_total t USING (convo_id, uid, l, r) "
    "JOIN left_side a ON a.convo_id = j.convo_id AND a.uid = j.uid AND a.split = j.l AND a.token = j.token GROUP BY 1, 2, 3, 4)"
)
ORACLES["entropy_pairs"] = query(
    "SELECT z.convo_id, z.uid, z.l || '-' || z.r AS pair, round(CASE WHEN (z.l <> 'post' AND z.size = s.size) OR t.types IS NULL OR t.types < 2 THEN 0.0 ELSE coalesce(-sums.s / (ln(t.types) * a.m), 0.0) END, 9) AS value "
    "FROM joint_size z JOIN sizes s ON s.convo_id = z.convo_id AND s.uid = z.uid AND s.split = z.l LEFT JOIN joint_total t ON t.convo_id = z.convo_id AND t.uid = z.uid AND t.l = z.l AND t.r = z.r LEFT JOIN sums ON sums.convo_id = z.convo_id AND sums.uid = z.uid AND sums.l = z.l AND sums.r = z.r "
    "LEFT JOIN left_size a ON a.convo_id = z.convo_id AND a.uid = z.uid AND a.split = z.l",
    EDGES, ABOVE, TOKENS, REL, PAIRS, shape="dag",
)


@named("entropy_pairs")
def entropy_pairs(spark, sf):
    wide = entropy.entropy_pairs(conversation_posts(spark, sf, "dag"))
    long = stats.to_long(wide, ["convo_id", "uid"], list(entropy.NAMES))
    return long.select("convo_id", "uid", F.replace("feature", F.lit("avg_token_entropy_"), F.lit("")).alias("pair"), (F.round("value", 9) + 0.0).alias("value"))


named(
    "user_entropy",
    query(
        "SELECT convo_id, author, round(CASE WHEN users < 2 OR types < 2 THEN 0.0 ELSE -s / (ln(types) * own) END, 9) AS avg_user_token_entropy FROM "
        "(SELECT o.convo_id, o.author, sum(ln(w.n / z.m)) AS s, sum(o.n) AS own, any_value(z.types) AS types FROM (SELECT convo_id, author, token, count(*) AS n FROM tok GROUP BY 1, 2, 3) o "
        "JOIN (SELECT convo_id, token, count(*) AS n FROM tok GROUP BY 1, 2) w USING (convo_id, token) "
        "JOIN (SELECT convo_id, count(*) AS m, count(DISTINCT token) AS types FROM tok GROUP BY 1) z USING (convo_id) GROUP BY 1, 2) JOIN (SELECT convo_id, count(DISTINCT author) AS users FROM posts GROUP BY 1) USING (convo_id)",
        TOKENS,
    ),
)(lambda spark, sf: _rounded(entropy.user_entropy(conversation_posts(spark, sf)), "avg_user_token_entropy"))

FREQ = "freq AS (SELECT convo_id, token, count(*) AS n FROM tok GROUP BY 1, 2)"
named(
    "novelty",
    query(
        "SELECT convo_id, n, types, round(CASE WHEN c0 IS NULL THEN 1.0 ELSE 2 / (1 / (1 + log10(n0 / n) / log10(c / c0)) + 1 / (types / (c - c0))) END, 9) AS novelty FROM "
        "(SELECT *, lag(c) OVER (PARTITION BY convo_id ORDER BY n DESC) AS c0, lag(n) OVER (PARTITION BY convo_id ORDER BY n DESC) AS n0 FROM "
        "(SELECT convo_id, n, types, sum(n * types) OVER (PARTITION BY convo_id ORDER BY n DESC) / n AS c FROM (SELECT convo_id, n, count(*) AS types FROM freq GROUP BY 1, 2)))",
        TOKENS, FREQ,
    ),
)(lambda spark, sf: _rounded(harmonic.novelty(entropy.token_counts(conversation_posts(spark, sf), ("convo_id",)), ["convo_id"]), "novelty"))


@named(
    "mixing_closed_form",
    query(
        "SELECT convo_id, round(t / m, 9) AS k1, round(CASE WHEN t > 1 THEN log10(top * (t / m)) / log10(t) ELSE 0.0 END, 9) AS theta, "
        "round(CASE WHEN t > 1 THEN (1 - log10(top * (t / m)) / log10(t)) * t ELSE 0.0 END, 6) AS N_avg, CAST(t AS DOUBLE) AS M_avg FROM "
        "(SELECT convo_id, CAST(count(*) AS DOUBLE) AS t, CAST(sum(n) AS DOUBLE) AS m, max(n) AS top FROM freq GROUP BY 1)",
        TOKENS, FREQ,
    ),
)
def mixing_closed_form(spark, sf):
    per = entropy.token_counts(conversation_posts(spark, sf), ("convo_id",)).groupBy("convo_id").agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("m"), F.max("n").alias("top"))
    made = harmonic.mixing_closed_form(F.col("t"), F.col("m"), F.col("top"))
    out = per.select("convo_id", *[c.alias(n) for n, c in made.items()])
    return _rounded(_rounded(out, "k1", "theta"), "N_avg", digits=6)


named("mixing_fit")(lambda spark, sf: _rounded(features.mixing_features(conversation_posts(spark, sf), ("convo_id",)), *features.MIXING, digits=6))
named("mixing_fit_user")(lambda spark, sf: _rounded(features.mixing_features(conversation_posts(spark, sf), ("convo_id", "author")), *features.MIXING, digits=6))


# -- text

named("post_tokens", f"WITH {DOCS} SELECT uid, array_to_string(regexp_extract_all(text, '{WORDS}'), chr(1)) AS tokens FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.array_join(text.partition_tokens(F.col("text")), "\x01").alias("tokens"))
)
named("post_tokens_no_space", f"WITH {DOCS} SELECT uid, CAST(len(regexp_extract_all(text, '{WORDS}')) - len(regexp_extract_all(text, ' ')) AS BIGINT) AS n FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.size(text.partition_tokens(F.col("text"), space=False)).cast("bigint").alias("n"))
)
named("default_tokens", rf"WITH {DOCS} SELECT uid, array_to_string(regexp_extract_all(text, '\S+'), ' ') AS tokens FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.array_join(text.default_tokens(F.col("text")), " ").alias("tokens"))
)
named("hashtags", rf"WITH {DOCS} SELECT uid, array_to_string(regexp_extract_all(text || ' #' || lang, '\B#[a-zA-Z]+\b'), ' ') AS found FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.array_join(text.hashtags(F.concat("text", F.lit(" #"), "lang")), " ").alias("found"))
)
named("urls", f"SELECT page_id, array_to_string(regexp_extract_all(html || ' ' || url, '{_URL}'), ' ') AS found FROM pages")(
    lambda spark, sf: _pages(spark, sf).select("page_id", F.array_join(text.urls(F.concat_ws(" ", "html", "url")), " ").alias("found"))
)
named("mentions", rf"WITH {DOCS} SELECT uid, array_to_string(regexp_extract_all('@' || lang || ' ' || text || ' @' || convo_id, '(^|[^\w@])@(\w{{1,15}})\b'), ' ') AS found FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.array_join(text.mentions(F.concat(F.lit("@"), "lang", F.lit(" "), "text", F.lit(" @"), "convo_id"), F.col("platform")), " ").alias("found"))
)
_PICTURES = " \U0001f60f\U0001f44d\U0001f3fd x \u2764\ufe0f \U0001f1eb\U0001f1f75\ufe0f\u20e3\u2602"
named("emojis", f"WITH {DOCS} SELECT uid, array_to_string(regexp_extract_all(substr(text, 1, 200) || '{_PICTURES}' || text, '{text.EMOJI}'), ' ') AS found FROM docs")(
    lambda spark, sf: document_posts(spark, sf).select("uid", F.array_join(text.emojis(F.concat(F.substring("text", 1, 200), F.lit(_PICTURES), "text")), " ").alias("found"))
)
_FOUND = {"emojis": f"regexp_extract_all(text, '{text.EMOJI}')", "hashtags": f"regexp_extract_all(text, '{_HASHTAG}')", "mentions": _MENTIONS, "tokens": f"regexp_extract_all(text, '{WORDS}')", "urls": f"regexp_extract_all(text, '{_URL}')"}
named("post_strings", query("SELECT convo_id, uid, " + ", ".join(f"array_to_string({e}, chr(1)) AS {n}" for n, e in _FOUND.items()) + " FROM posts"))(
    lambda spark, sf: features.post_strings(conversation_posts(spark, sf)).select("convo_id", "uid", *[F.array_join(n, "\x01").alias(n) for n in features.POST_STRS])
)
named("post_categoricals", query("SELECT convo_id, uid, author, lang, platform, len(reply_to) = 0 AS is_source FROM posts", shape="external"))(
    lambda spark, sf: features.post_features(conversation_posts(spark, sf, "external")).select("convo_id", "uid", *features.POST_CATEGORICALS, "is_source")
)
named(
    "detection_rule",
    f"WITH {DOCS} SELECT uid, CASE WHEN (lang IS NULL OR lang = 'und') AND length(text) > 0 THEN CASE WHEN n % 10 >= 5 THEN 'g' || n % 4 ELSE 'und' END ELSE lang END AS lang "
    "FROM (SELECT uid, text, seq AS n, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN 'und' ELSE lang END AS lang FROM docs)",
)(lambda spark, sf: _detection_rule(spark, sf))


def _detection_rule(spark, sf):
    posts = document_posts(spark, sf).withColumn("lang", F.when(F.col("seq") % 3 == 0, None).when(F.col("seq") % 3 == 1, "und").otherwise(F.col("lang")))
    return posts.select("uid", text.detected(F.col("lang"), F.col("text"), F.concat(F.lit("g"), F.col("seq") % 4), (F.col("seq") % 10) / 10).alias("lang"))


def _pages(spark, sf):
    from threadweave.session import table

    return table(spark, sf, "pages")


@named(
    "redact",
    query(
        "SELECT p.convo_id, p.uid, 'USER' || k AS author, '@USER' || k || ' ' || text AS text FROM posts p "
        "JOIN (SELECT convo_id, author, row_number() OVER (PARTITION BY convo_id ORDER BY min(seq)) - 1 AS k FROM posts GROUP BY 1, 2) a USING (convo_id, author)",
        rich=False,
    ),
)
def redact(spark, sf):
    posts = conversation_posts(spark, sf, rich=False).withColumn("author", F.concat(F.lit("the_"), "author")).withColumn("text", F.concat(F.lit("@"), "author", F.lit(" "), "text"))
    return redaction.redact(posts).select("convo_id", "uid", "author", "text")


@named("language_detection")
def language_detection(spark, sf):
    from threadweave.functions import langdetect

    posts = document_posts(spark, sf)
    unknown = posts.withColumn("lang", F.lit("und"))
    return langdetect.detect_languages(unknown, langdetect.naive_bayes(langdetect.train(posts))).select("uid", "lang")


# -- vectors

for _how, _expr in (("minmax", "(v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END"), ("mean", "(v - m) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END"), ("standard", "(v - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END")):
    _cells = " UNION ALL ".join(f"SELECT convo_id, uid, '{f}' AS feature, CAST(\"{f}\" AS DOUBLE) AS v FROM ints" for f in features.POST_INTS)
    named(
        f"normalize_{_how}",
        query(f"SELECT convo_id, uid, feature, round({_expr}, 9) AS value FROM cells JOIN (SELECT feature, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS s FROM cells GROUP BY 1) USING (feature)", INTS, f"cells AS ({_cells})"),
    )(lambda spark, sf, h=_how: _normalized(spark, sf, h))


def _normalized(spark, sf, how):
    long = cut(stats.to_long(features.post_ints(conversation_posts(spark, sf)), ["convo_id", "uid"], features.POST_INTS))
    fitted = vectorize.column_stats(long)
    scaled = long.join(F.broadcast(fitted), "feature").withColumn("value", vectorize.normalized(F.col("value"), how))
    return scaled.select("convo_id", "uid", "feature", (F.round("value", 9) + 0.0).alias("value"))


AGES = (
    "ages AS (SELECT convo_id, uid, CAST(sec - min(sec) OVER (PARTITION BY convo_id) AS DOUBLE) AS relative_age FROM posts), "
    "responses AS (SELECT p.convo_id, p.uid, CAST(coalesce(min(abs(p.sec - q.sec)), -1) AS DOUBLE) AS response_time FROM posts p LEFT JOIN edges e ON e.convo_id = p.convo_id AND e.child = p.uid "
    "LEFT JOIN posts q ON q.convo_id = e.convo_id AND q.uid = e.parent GROUP BY 1, 2)"
)
PAIR_VALUES = (
    "pair_values AS (SELECT z.convo_id, z.uid, 'avg_token_entropy_' || z.l || '-' || z.r AS feature, CASE WHEN (z.l <> 'post' AND z.size = s.size) OR t.types IS NULL OR t.types < 2 THEN 0.0 ELSE coalesce(-sums.s / (ln(t.types) * a.m), 0.0) END AS value "
    "FROM joint_size z JOIN sizes s ON s.convo_id = z.convo_id AND s.uid = z.uid AND s.split = z.l LEFT JOIN joint_total t ON t.convo_id = z.convo_id AND t.uid = z.uid AND t.l = z.l AND t.r = z.r LEFT JOIN sums ON sums.convo_id = z.convo_id AND sums.uid = z.uid AND sums.l = z.l AND sums.r = z.r "
    "LEFT JOIN left_size a ON a.convo_id = z.convo_id AND a.uid = z.uid AND a.split = z.l)"
)
#: The numbers of posts but for the four of the mixing fit, which is iterative.
POST_NUMBERS = (
    "post_numbers AS (SELECT convo_id, uid, author, feature, value FROM (SELECT convo_id, uid, feature, value FROM pair_values "
    "UNION ALL SELECT convo_id, uid, 'relative_age', relative_age FROM ages UNION ALL SELECT convo_id, uid, 'response_time', response_time FROM responses "
    + " ".join(f"UNION ALL SELECT convo_id, uid, '{f}', CAST(\"{f}\" AS DOUBLE) FROM full_ints" for f in features.CONVO_POST_INTS)
    + ") JOIN (SELECT convo_id, uid, author FROM posts) USING (convo_id, uid))"
)
FLAGS = (
    "marks AS (SELECT d.convo_id, d.uid, p.author, out_degree = 0 AS is_source, in_degree = 0 AS is_leaf, in_degree <> 0 AND out_degree <> 0 AS is_internal, o.author IS NOT NULL AS is_author_source_author "
    "FROM degrees d JOIN posts p ON p.convo_id = d.convo_id AND p.uid = d.uid LEFT JOIN (SELECT DISTINCT convo_id, author FROM posts WHERE uid NOT IN (SELECT child FROM edges)) o ON o.convo_id = d.convo_id AND o.author = p.author)"
)
_PARTS = (EDGES, ABOVE, DEPTH, DEGREE, TOKENS, INTS, FULL_INTS, REL, PAIRS, PAIR_VALUES, AGES, FLAGS, POST_NUMBERS)


def _five(source: str, keys: str, prefix: str, guard: bool) -> str:
    """Five statistics of the feature values of a table per group, long."""
    std = "CASE WHEN count(*) <= 1 THEN 1.0 ELSE stddev_pop(value) END" if guard else "stddev_pop(value)"
    parts = {"min": "min(value)", "max": "max(value)", "mean": "avg(value)", "median": "median(value)", "std": std}
    group = f"{keys}, " if keys else ""
    inner = f"(SELECT {group}feature, " + ", ".join(f"{e} AS {n}" for n, e in parts.items()) + f" FROM {source} GROUP BY {group}feature)"
    return " UNION ALL ".join(f"SELECT {group}'{prefix}_{n}_' || feature AS feature, {n} AS value FROM {inner}" for n in parts)


def _flag_sums(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS feature, CAST(sum(CASE WHEN {b} THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM marks GROUP BY {keys}" for b, n in features.COUNTED_BOOLS.items())


def _int_sums(keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS feature, CAST(sum(\"{c}\") AS DOUBLE) AS value FROM full_ints GROUP BY {keys}" for c in features.SUMMED_INTS)


_USER_ENTROPY = (
    "SELECT convo_id, author, 'avg_user_token_entropy' AS feature, CASE WHEN users < 2 OR types < 2 THEN 0.0 ELSE -s / (ln(types) * own) END AS value FROM "
    "(SELECT o.convo_id, o.author, sum(ln(w.n / z.m)) AS s, sum(o.n) AS own, any_value(z.types) AS types FROM (SELECT convo_id, author, token, count(*) AS n FROM tok GROUP BY 1, 2, 3) o "
    "JOIN (SELECT convo_id, token, count(*) AS n FROM tok GROUP BY 1, 2) w USING (convo_id, token) "
    "JOIN (SELECT convo_id, count(*) AS m, count(DISTINCT token) AS types FROM tok GROUP BY 1) z USING (convo_id) GROUP BY 1, 2) JOIN (SELECT convo_id, count(DISTINCT author) AS users FROM posts GROUP BY 1) USING (convo_id)"
)
USER_NUMBERS = (
    "user_numbers AS (" + " UNION ALL ".join(
        [
            "SELECT convo_id, author, 'message_count' AS feature, CAST(count(*) AS DOUBLE) AS value FROM posts GROUP BY 1, 2",
            "SELECT convo_id, author, 'types', CAST(count(DISTINCT token) AS DOUBLE) FROM tok GROUP BY 1, 2",
            _flag_sums("convo_id, author"), _int_sums("convo_id, author"), _USER_ENTROPY, _five("post_numbers", "convo_id, author", "post", False),
        ]
    ) + ")"
)
CONVO_NUMBERS = (
    "convo_numbers AS (" + " UNION ALL ".join(
        [
            "SELECT convo_id, 'messages' AS feature, CAST(count(*) AS DOUBLE) AS value FROM posts GROUP BY 1",
            "SELECT convo_id, 'users', CAST(count(DISTINCT author) AS DOUBLE) FROM posts GROUP BY 1",
            "SELECT convo_id, 'types', CAST(count(DISTINCT token) AS DOUBLE) FROM tok GROUP BY 1",
            "SELECT convo_id, 'duration', CAST(max(sec) - min(sec) AS DOUBLE) FROM posts GROUP BY 1",
            "SELECT convo_id, 'tree_depth', CAST(max(depth) AS DOUBLE) FROM depths GROUP BY 1",
            "SELECT convo_id, 'tree_width', CAST(max(n) AS DOUBLE) FROM (SELECT convo_id, count(*) AS n FROM depths GROUP BY convo_id, depth) GROUP BY 1",
            "SELECT convo_id, 'tree_degree', CAST(max(true_degree) AS DOUBLE) FROM degrees GROUP BY 1",
            "SELECT convo_id, 'density', CASE WHEN n <= 1 OR m IS NULL THEN 0.0 ELSE 2.0 * m / (n * (n - 1)) END FROM (SELECT convo_id, count(*) AS n FROM posts GROUP BY 1) "
            "LEFT JOIN (SELECT convo_id, count(*) AS m FROM (SELECT DISTINCT convo_id, least(child, parent), greatest(child, parent) FROM edges) GROUP BY 1) USING (convo_id)",
            _flag_sums("convo_id"), _int_sums("convo_id"), _five("post_numbers", "convo_id", "post", False), _five("user_numbers", "convo_id", "user", True),
        ]
    ) + ")"
)
ACROSS_NUMBERS = (
    "across_numbers AS (" + " UNION ALL ".join(
        [
            _five("post_numbers", "author", "post", False),
            f"SELECT author, feature, sum(value) AS value FROM user_numbers WHERE feature IN ({', '.join(repr(x) for x in features.USER_INTS)}) GROUP BY 1, 2",
            "SELECT author, 'source_author_count', CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS DOUBLE) FROM (SELECT convo_id, author, bool_or(is_author_source_author) AS s FROM marks GROUP BY 1, 2) GROUP BY 1",
        ]
    ) + ")"
)


def _is_fitted(name: str) -> bool:
    return not name.endswith("token_entropy") and any(name == k or name.endswith(f"_{k}") for k in features.MIXING)


def _slots(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A vector's places and values, but for those of the mixing fit, to 6 digits."""
    fitted = [i for i, n in enumerate(order) if _is_fitted(n)]
    return df.select(*keys, F.posexplode("features").alias("slot", "value")).where(~F.col("slot").isin(*fitted)).select(*keys, "slot", (F.round("value", 6) + 0.0).alias("value"))


def _slots_sql(source: str, keys: str, order: list[str], flags: str = "") -> str:
    places = ", ".join(f"('{n}', {i})" for i, n in enumerate(order) if not _is_fitted(n))
    return f"SELECT {keys}, CAST(slot AS INTEGER) AS slot, round(value, 6) + 0.0 AS value FROM (SELECT {keys}, slot, value FROM {source} JOIN (VALUES {places}) AS names(feature, slot) USING (feature){flags})"


def _flag_slots(names: list[str], keys: str, begin: int, source: str = "marks") -> str:
    return "".join(f" UNION ALL SELECT {keys}, {begin + i}, CASE WHEN {n} THEN 1.0 ELSE 0.0 END FROM {source}" for i, n in enumerate(names))


_ALONE = [*features.POST_FLOATS, *features.POST_INTS]
_SCALED = "scaled AS (SELECT {keys}, feature, {value} AS value FROM {source} JOIN (SELECT feature, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_pop(value) AS s FROM {source} GROUP BY 1) USING (feature))"
_WHOLE = [*features.CONVO_FLOATS, *features.CONVO_INTS]
_USER = [*features.USER_INTS, *features.USER_FLOATS]
_ACROSS = [*features.ACROSS_INTS, *features.ACROSS_FLOATS]
_POST_KEYS = "convo_id, uid"
named(
    "post_vectors",
    query(
        _slots_sql("scaled", _POST_KEYS, _ALONE, _flag_slots(["is_source"], _POST_KEYS, len(_ALONE))), *_PARTS,
        _SCALED.format(keys=_POST_KEYS, source="post_numbers", value="(value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END"),
    ),
)(lambda spark, sf: _slots(vectorize.PostVectorizer("minmax", in_convo=False).fit_transform(conversation_posts(spark, sf)), ["convo_id", "uid"], _ALONE))
named(
    "post_in_convo_vectors",
    query(
        _slots_sql("scaled", _POST_KEYS, features.CONVO_POST_NUMBERS, _flag_slots(features.CONVO_POST_BOOLS, _POST_KEYS, len(features.CONVO_POST_NUMBERS))), *_PARTS,
        _SCALED.format(keys=_POST_KEYS, source="post_numbers", value="(value - m) / CASE WHEN s = 0 THEN 1.0 ELSE s END"),
    ),
)(lambda spark, sf: _slots(vectorize.PostVectorizer("standard").fit_transform(conversation_posts(spark, sf)), ["convo_id", "uid"], features.CONVO_POST_NUMBERS))
named(
    "user_vectors",
    query(_slots_sql("user_numbers", "convo_id, author", _USER, _flag_slots(["is_source_author"], "convo_id, author", len(_USER), "(SELECT convo_id, author, bool_or(is_author_source_author) AS is_source_author FROM marks GROUP BY 1, 2)")), *_PARTS, USER_NUMBERS),
)(lambda spark, sf: _slots(vectorize.UserVectorizer().fit_transform(conversation_posts(spark, sf)), ["convo_id", "author"], _USER))
named(
    "user_across_vectors",
    query(
        _slots_sql("scaled", "author", _ACROSS), *_PARTS, USER_NUMBERS, ACROSS_NUMBERS, _SCALED.format(keys="author", source="across_numbers", value="(value - m) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END")
    ),
)(lambda spark, sf: _slots(vectorize.UserVectorizer("mean", across=True).fit_transform(conversation_posts(spark, sf)), ["author"], _ACROSS))
named("conversation_vectors", query(_slots_sql("convo_numbers", "convo_id", _WHOLE), *_PARTS, USER_NUMBERS, CONVO_NUMBERS))(
    lambda spark, sf: _slots(vectorize.ConversationVectorizer().fit_transform(conversation_posts(spark, sf)), ["convo_id"], _WHOLE)
)
named("conversation_vectors_standard")(lambda spark, sf: vectorize.ConversationVectorizer("standard").fit_transform(conversation_posts(spark, sf)))


def _unfitted(df: DataFrame) -> DataFrame:
    for k in features.MIXING:
        df = df.where(F.col("feature").endswith("token_entropy") | ~(F.col("feature").endswith(f"_{k}") | (F.col("feature") == k)))
    return df.withColumn("value", F.round("value", 6) + 0.0)


def _statistics(source: str, keys: str, prefix: str, *parts: str) -> str:
    return query(f"SELECT {keys + ', ' if keys else ''}feature, round(value, 6) + 0.0 AS value FROM ({_five(source, keys, prefix, True)})", *_PARTS, *parts)


named("convo_stats", _statistics("convo_numbers", "", "convo", USER_NUMBERS, CONVO_NUMBERS))(lambda spark, sf: _unfitted(features.convo_stats(conversation_posts(spark, sf))))
named("user_stats_across", _statistics("user_numbers", "author", "user", USER_NUMBERS))(lambda spark, sf: _unfitted(features.user_stats_across(conversation_posts(spark, sf))))
named("user_stats_all", _statistics("user_numbers", "convo_id", "user", USER_NUMBERS))(
    lambda spark, sf: _unfitted(features.convo_user_stats(conversation_posts(spark, sf)))
)
named("post_stats_all", query(f"SELECT convo_id, feature, round(value, 6) + 0.0 AS value FROM ({_five('post_numbers', 'convo_id', 'post', False)})", *_PARTS))(
    lambda spark, sf: _unfitted(features.convo_post_stats(conversation_posts(spark, sf)))
)
named(
    "assembled_vectors",
    query(
        "SELECT p.convo_id, p.uid, CAST(part AS INTEGER) AS part, round(total, 4) AS total FROM (SELECT convo_id, uid, author FROM posts) p JOIN ("
        "SELECT convo_id, uid, NULL AS author, 0 AS part, total FROM (SELECT convo_id, uid, sum(value) AS total FROM (" + _slots_sql("post_numbers", _POST_KEYS, _ALONE, _flag_slots(["is_source"], _POST_KEYS, len(_ALONE))) + ") GROUP BY 1, 2) "
        "UNION ALL SELECT convo_id, NULL, NULL, 1, sum(value) FROM (" + _slots_sql("convo_numbers", "convo_id", _WHOLE) + ") GROUP BY 1 "
        "UNION ALL SELECT NULL, NULL, author, 2, sum(value) FROM (" + _slots_sql("across_numbers", "author", _ACROSS) + ") GROUP BY author) v "
        "ON coalesce(v.convo_id = p.convo_id, true) AND coalesce(v.uid = p.uid, true) AND coalesce(v.author = p.author, true)",
        *_PARTS, USER_NUMBERS, CONVO_NUMBERS, ACROSS_NUMBERS,
    ),
)(lambda spark, sf: _assembled(spark, sf))


def _assembled(spark, sf):
    """Every post's vector with its conversation's and its author's, and the sums of the three parts but for the mixing fit."""
    posts = conversation_posts(spark, sf)
    passed = cut(whole.pass_over(posts))
    made = []
    for v, order in ((vectorize.PostVectorizer(in_convo=False), [*_ALONE, "is_source"]), (vectorize.ConversationVectorizer(passed=passed), _WHOLE), (vectorize.UserVectorizer(across=True, passed=passed), _ACROSS)):
        asked = F.array(*[F.lit(not _is_fitted(n)) for n in order])
        made.append(v.fit_transform(posts).withColumn("features", F.zip_with("features", asked, lambda x, a: F.when(a, F.round(x, 6)).otherwise(0.0))))
    both = vectorize.assemble(posts, *made)
    sizes = [len(_ALONE) + 1, len(_WHOLE), len(_ACROSS)]
    total = lambda i: F.aggregate(F.slice("features", sum(sizes[:i]) + 1, sizes[i]), F.lit(0.0), lambda s, x: s + x)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.round(total(i), 4).alias("total")) for i in range(3)])
    return both.select("convo_id", "uid", F.inline(parts))


# -- corpus metrics

GROUPS = "unnest(CASE WHEN lang IN ('en', 'und') THEN [lang, 'all', 'en_und'] WHEN lang IS NULL THEN ['all'] ELSE [lang, 'all'] END) AS grp"
_DOC_TOK = f"dtok AS (SELECT convo_id, uid, lang, text, regexp_extract_all(text, '{WORDS}') AS t FROM docs)"

named(
    "sizes",
    query(
        "SELECT grp, posts, coalesce(conversations, 0) AS conversations, first, last, round((last - first) / 31536000.0, 9) AS years FROM "
        f"(SELECT grp, count(*) AS posts, CAST(min(sec) AS BIGINT) AS first, CAST(max(sec) AS BIGINT) AS last FROM (SELECT sec, {GROUPS} FROM posts) GROUP BY 1) "
        f"LEFT JOIN (SELECT grp, count(*) AS conversations FROM (SELECT {GROUPS} FROM (SELECT convo_id, arg_min(lang, seq) AS lang FROM posts GROUP BY 1 HAVING count(*) > 1)) GROUP BY 1) USING (grp)"
    ),
)(lambda spark, sf: metrics.sizes(conversation_posts(spark, sf)))
named("language_distribution", f"WITH {DOCS} SELECT lang, count(*) AS n, count(*) / (SELECT count(*) FROM docs) AS share FROM docs GROUP BY 1 HAVING count(*) > 0.005 * (SELECT count(*) FROM docs)")(
    lambda spark, sf: metrics.language_distribution(document_posts(spark, sf))
)
named("anonymity", query("SELECT convo_id AS board, round(avg(CASE WHEN author = 'assistant' THEN 1 ELSE 0 END), 9) AS ratio FROM posts GROUP BY ROLLUP (convo_id)"))(
    lambda spark, sf: _rounded(metrics.anonymity(conversation_posts(spark, sf), "assistant"), "ratio")
)
named(
    "tagged_counts",
    query(
        "SELECT 'posts' AS what, author = 'system' AS tagged, count(*) AS n FROM posts GROUP BY 1, 2 UNION ALL "
        "SELECT 'conversations', tagged, count(*) FROM (SELECT convo_id, bool_or(author = 'system') AS tagged FROM posts GROUP BY 1) GROUP BY 2"
    ),
)(lambda spark, sf: metrics.tagged(conversation_posts(spark, sf), "role=system"))
named("creation_histogram", query(f"SELECT grp, CAST(sec // 86400 * 86400 AS BIGINT) AS sec, count(*) AS n FROM (SELECT sec, {GROUPS} FROM posts) GROUP BY 1, 2"))(
    lambda spark, sf: metrics.creation_histogram(conversation_posts(spark, sf)).withColumnRenamed("at", "sec")
)
named("creation_histogram_year", query(f"SELECT grp, CAST(sec // 86400 * 86400 AS BIGINT) AS sec, count(*) AS n FROM (SELECT sec, {GROUPS} FROM posts WHERE sec >= 1704067200 AND sec < 1735689600) GROUP BY 1, 2"))(
    lambda spark, sf: metrics.creation_histogram(conversation_posts(spark, sf), year=2024).withColumnRenamed("at", "sec")
)
named(
    "text_histograms",
    f"WITH {DOCS}, {_DOC_TOK}, m AS (SELECT {GROUPS}, length(text) AS chars, len(t) AS tokens, len(list_distinct(t)) AS types FROM dtok WHERE trim(text) <> '') "
    + "SELECT grp, measure, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT grp, '{c}' AS measure, CAST({c} AS VARCHAR) AS value FROM m" for c in ("chars", "tokens", "types"))
    + " UNION ALL SELECT grp, 'tokens-types', tokens || '-' || types FROM m) GROUP BY 1, 2, 3",
)(lambda spark, sf: metrics.text_histograms(document_posts(spark, sf)))
named(
    "token_frequencies",
    f"WITH {DOCS}, {_DOC_TOK} SELECT grp, token, count(*) AS n FROM (SELECT grp, unnest(t) AS token FROM (SELECT t, {GROUPS} FROM dtok WHERE regexp_matches(text, '{metrics.NOT_BLANK}'))) GROUP BY 1, 2",
)(lambda spark, sf: metrics.token_frequencies(document_posts(spark, sf)))
for _cased in (True, False):
    named(
        "text_totals" if _cased else "text_totals_folded",
        f"WITH {DOCS}, {_DOC_TOK}, w AS (SELECT grp, {'token' if _cased else 'lower(token)'} AS token FROM (SELECT {GROUPS}, unnest(t) AS token FROM (SELECT lang, t FROM dtok)) ) "
        f"SELECT grp, CAST(chars AS BIGINT) AS chars, tokens, types FROM (SELECT grp, sum(length(text)) AS chars FROM (SELECT text, {GROUPS} FROM docs) GROUP BY 1) JOIN (SELECT grp, count(*) AS tokens, count(DISTINCT token) AS types FROM w GROUP BY 1) USING (grp)".replace(
            f"SELECT {GROUPS}, unnest(t) AS token FROM (SELECT lang, t FROM dtok)", f"SELECT grp, unnest(t) AS token FROM (SELECT t, {GROUPS} FROM dtok)"
        ),
    )(lambda spark, sf, c=_cased: metrics.text_totals(document_posts(spark, sf), c))
named(
    "describe",
    f"WITH {DOCS}, {_DOC_TOK}, m AS (SELECT {GROUPS}, length(text) AS chars, len(t) AS tokens, len(list_distinct(t)) AS types FROM dtok WHERE trim(text) <> ''), "
    + "l AS (" + " UNION ALL ".join(f"SELECT grp, '{c}' AS measure, CAST({c} AS DOUBLE) AS v FROM m" for c in ("chars", "tokens", "types")) + ") "
    "SELECT grp, measure, count(*) AS n, round(avg(v), 9) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS most FROM l GROUP BY 1, 2",
)(lambda spark, sf: metrics.describe(document_posts(spark, sf)))
named(
    "rank_frequency",
    query(
        "SELECT convo_id, token, n, CAST(rank AS INTEGER) AS rank, round(ln(rank), 9) AS log_rank, round(n / total, 9) AS share, round(ln(n / total), 9) AS log_share FROM "
        "(SELECT *, row_number() OVER (PARTITION BY convo_id ORDER BY n DESC, token) AS rank, sum(n) OVER (PARTITION BY convo_id) AS total FROM freq)",
        TOKENS, FREQ,
    ),
)(lambda spark, sf: metrics.rank_frequency(conversation_posts(spark, sf)))

_MANY = f"grps AS (SELECT DISTINCT convo_id, grp FROM (SELECT convo_id, {GROUPS} FROM posts WHERE convo_id IN (SELECT convo_id FROM posts GROUP BY 1 HAVING count(*) > 1)))"


def _hist(per: str, measures: tuple[str, ...]) -> str:
    long = " UNION ALL ".join(f"SELECT convo_id, '{m}' AS measure, CAST({m} AS VARCHAR) AS value FROM per" for m in measures)
    return f"SELECT grp, measure, value, count(*) AS n FROM ({long}) JOIN grps USING (convo_id) GROUP BY 1, 2, 3", f"per AS ({per})"


_body, _per = _hist("SELECT convo_id, count(*) AS messages, count(DISTINCT lang) AS langs, count(DISTINCT author) AS users, CAST(max(sec) - min(sec) AS BIGINT) AS duration FROM posts GROUP BY 1", ("messages", "langs", "users", "duration"))
named("convo_size_histograms", query(_body, _MANY, _per))(lambda spark, sf: metrics.convo_size_histograms(conversation_posts(spark, sf)))
_body, _per = _hist("SELECT convo_id, CAST(chars AS BIGINT) AS chars, tokens, types FROM (SELECT convo_id, sum(length(text)) AS chars FROM posts GROUP BY 1) JOIN (SELECT convo_id, count(*) AS tokens, count(DISTINCT token) AS types FROM tok GROUP BY 1) USING (convo_id)", ("chars", "tokens", "types"))
named("convo_text_histograms", query(_body, TOKENS, _MANY, _per))(lambda spark, sf: metrics.convo_text_histograms(conversation_posts(spark, sf)))
_body, _per = _hist("SELECT convo_id, coalesce(tokens, 0) || '-' || coalesce(types, 0) AS \"tokens-types\" FROM (SELECT DISTINCT convo_id FROM posts) LEFT JOIN (SELECT convo_id, count(*) AS tokens, count(DISTINCT token) AS types FROM tok GROUP BY 1) USING (convo_id)", ("tokens-types",))
named("convo_novelty_histograms", query(_body.replace("CAST(tokens-types", "CAST(\"tokens-types\""), TOKENS, _MANY, _per))(lambda spark, sf: metrics.convo_novelty_histograms(conversation_posts(spark, sf)))
_body, _per = _hist("SELECT convo_id, true_degree || '-' || in_degree || '-' || out_degree AS degrees FROM degrees", ("degrees",))
named("convo_degree_histograms", query(_body, EDGES, DEGREE, _MANY, _per))(lambda spark, sf: metrics.convo_graph_histograms(conversation_posts(spark, sf)).where("measure = 'degrees'"))
named(
    "convo_graph_histograms",
    query(
        "SELECT grp, measure, value, count(*) AS n FROM (SELECT convo_id, 'tree_depth' AS measure, CAST(tree_depth AS VARCHAR) AS value FROM trees UNION ALL SELECT convo_id, 'tree_width', CAST(tree_width AS VARCHAR) FROM trees "
        "UNION ALL SELECT convo_id, 'degrees', true_degree || '-' || in_degree || '-' || out_degree FROM degrees) JOIN grps USING (convo_id) GROUP BY 1, 2, 3",
        EDGES, DEPTH, DEGREE, _MANY,
        "trees AS (SELECT convo_id, max(depth) AS tree_depth, max(w) AS tree_width FROM (SELECT convo_id, depth, count(*) OVER (PARTITION BY convo_id, depth) AS w FROM depths) GROUP BY 1)",
    ),
)(lambda spark, sf: metrics.convo_graph_histograms(conversation_posts(spark, sf)))


# -- raw files: written from the conversations, then read


def _read_back(df: DataFrame, *more: str) -> DataFrame:
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return df.select("convo_id", "uid", "text", "author", F.unix_seconds("created_at").alias("sec"), join("reply_to"), "platform", join("tags"), "lang", *more)


def _raw_sql(platform: str, author: str = "author", reply: str = "to_", tags: str = "''", lang: str = "NULL", more: str = "", text_: str = "trim(text, ' ')", shift: int = 0) -> str:
    """The posts as a reader must give them; a conversation is named by its first turn, which nothing is above."""
    return query(
        f"SELECT 'CONV_' || (CAST(first_ AS BIGINT) + {shift}) AS convo_id, CAST(CAST(uid AS BIGINT) + {shift} AS VARCHAR) AS uid, {text_} AS text, {author} AS author, CAST(sec AS BIGINT) AS sec, {reply} AS reply_to, '{platform}' AS platform, {tags} AS tags, CAST({lang} AS VARCHAR) AS lang{more} "
        "FROM (SELECT *, array_to_string(reply_to, ',') AS to_, CAST(convo_id AS BIGINT) AS conv, CAST(CAST(convo_id AS BIGINT) * 1000 AS VARCHAR) AS first_ FROM posts)",
        rich=False,
    )


_UNIVERSAL = query("SELECT 'CONV_' || CAST(CAST(convo_id AS BIGINT) * 1000 AS VARCHAR) AS convo_id, uid, text, author, CAST(sec AS BIGINT) AS sec, array_to_string(reply_to, ',') AS reply_to, platform, 'role=' || author AS tags, lang FROM posts")
_FILES: dict[str, tuple[str, tuple[str, ...]]] = {
    "universal": (_UNIVERSAL, ()),
    "tweets": (_raw_sql("Twitter", lang="'und'"), ()),
    "converted": (_raw_sql("Twitter", lang="'und'"), ()),
    "tweet_threads": (_raw_sql("Twitter", lang="'und'", more=", 'topic' || (conv % 3) AS source"), ("source",)),
    "chan": (_raw_sql("4chan", shift=samples.SHIFT, reply=f"CASE WHEN seq > 0 THEN CAST(CAST(to_ AS BIGINT) + {samples.SHIFT} AS VARCHAR) ELSE '' END", more=", '0' || (conv % 4) AS chunk"), ("chunk",)),
    "reddit": (_raw_sql("Reddit"), ()),
    "reddit_flat": (_raw_sql("Reddit", tags="'board=b' || (conv % 3)", text_="CASE WHEN seq = 0 THEN ' ' || trim(text, ' ') ELSE trim(text, ' ') END"), ()),
    "ad_hominem": (_raw_sql("Reddit", tags="CASE WHEN seq % 3 = 2 THEN 'AH=1' ELSE 'AH=0' END"), ()),
    "facebook": (_raw_sql("Facebook", author="CASE WHEN seq > 0 THEN author END", reply="CASE WHEN seq > 0 THEN first_ ELSE '' END", tags="CASE WHEN seq = 0 THEN 'type=status' ELSE '' END", more=", 'page' || (conv % 5) AS page"), ("page",)),
}
for _name, (_sql, _more) in _FILES.items():
    named(f"read_{_name}" if _name != "converted" else "convert", _sql)(lambda spark, sf, n=_name, m=_more: _read_back(samples.SAMPLES[n](spark, sf), *m))
