"""The reply graph: edges, relatives, depth, degrees, components."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.operators.components import connected_components

KEY = ["convo_id", "uid"]


def edges(posts: DataFrame) -> DataFrame:
    """``(convo_id, child, parent)``: reply targets that are posts of the same conversation, each once."""
    wanted = posts.select("convo_id", F.col("uid").alias("child"), F.explode(F.array_distinct("reply_to")).alias("parent"))
    present = posts.select("convo_id", F.col("uid").alias("parent"))
    return wanted.join(present, ["convo_id", "parent"]).select("convo_id", "child", "parent").distinct()


def as_graph(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, undirected edges): every post is a vertex, edges are pairs (a <= b) once."""
    e = edges(posts)
    return posts.select(*KEY), e.select("convo_id", F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).distinct()


def sources(posts: DataFrame) -> DataFrame:
    """Posts without a reply target inside their conversation."""
    return posts.join(edges(posts).select("convo_id", F.col("child").alias("uid")), KEY, "left_anti")


def _with_self(relation: DataFrame, posts: DataFrame, include_post: bool) -> DataFrame:
    return relation.unionByName(posts.select(*KEY, F.col("uid").alias("member"))).distinct() if include_post else relation


def parents(posts: DataFrame, include_post: bool = False) -> DataFrame:
    """``(convo_id, uid, member)`` for every post's parents."""
    return _with_self(edges(posts).select("convo_id", F.col("child").alias("uid"), F.col("parent").alias("member")), posts, include_post)


def children(posts: DataFrame, include_post: bool = False) -> DataFrame:
    """``(convo_id, uid, member)`` for every post's children."""
    return _with_self(edges(posts).select("convo_id", F.col("parent").alias("uid"), F.col("child").alias("member")), posts, include_post)


def siblings(posts: DataFrame, include_post: bool = False) -> DataFrame:
    """``(convo_id, uid, member)`` for other posts that share a parent."""
    e = edges(posts)
    other = e.select("convo_id", "parent", F.col("child").alias("member"))
    found = e.select("convo_id", "parent", F.col("child").alias("uid")).join(other, ["convo_id", "parent"]).where("uid <> member")
    return _with_self(found.select(*KEY, "member").distinct(), posts, include_post)


def places(uids: list[str], targets: list[list[str]]) -> list[list[int]]:
    """For every post of one conversation the places of those it replies to."""
    place = {u: i for i, u in enumerate(uids)}
    return [sorted({place[t] for t in ts if t in place}) for ts in targets]


def walk(up: list[list[int]]) -> tuple[list[int], list[int]]:
    """Longest path from a source of every post of one conversation, and the posts in an order in which each comes after those it
    replies to, in time linear in the replies; a cycle raises. ``up``: see ``places``."""
    waiting = [len(p) for p in up]
    down: list[list[int]] = [[] for _ in up]
    for i, ps in enumerate(up):
        for p in ps:
            down[p].append(i)
    depth, order = [0] * len(up), [i for i, n in enumerate(waiting) if not n]
    for i in order:
        for c in down[i]:
            depth[c] = max(depth[c], depth[i] + 1)
            waiting[c] -= 1
            if not waiting[c]:
                order.append(c)
    if len(order) < len(up):
        raise ValueError("a post is its own ancestor")
    return depth, order


def all_above(up: list[list[int]], order: list[int]) -> list[set[int]]:
    """The ancestors of every post; as many as there are pairs of them."""
    above: list[set[int]] = [set() for _ in up]
    for i in order:
        for p in up[i]:
            above[i] |= above[p]
            above[i].add(p)
    return above


def depths(posts: DataFrame, with_ancestors: bool = False) -> DataFrame:
    """``(convo_id, uid, depth)``: the longest path from a source; with_ancestors adds their ids as an array.

    A conversation's ids and targets meet in one row and are walked in topological order, in time
    linear in its edges (and the number of ancestors, if these are asked for): one shuffle, whatever the depth. A cycle raises.
    """
    threads = posts.groupBy("convo_id").agg(F.collect_list(F.struct("uid", F.coalesce("reply_to", F.array()).alias("to"))).alias("p"))
    shape = "convo_id string, uid string, depth int" + ", ancestors array<string>" * with_ancestors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for convo, uids, to in zip(pdf["convo_id"], pdf["u"], pdf["t"]):
                uids = list(uids)
                up = places(uids, to)
                depth, order = walk(up)
                if with_ancestors:
                    rows += [(convo, u, d, [uids[i] for i in sorted(a)]) for u, d, a in zip(uids, depth, all_above(up, order))]
                else:
                    rows += [(convo, u, d) for u, d in zip(uids, depth)]
            yield pd.DataFrame(rows, columns=["convo_id", "uid", "depth", *(["ancestors"] if with_ancestors else [])])

    return threads.select("convo_id", F.col("p.uid").alias("u"), F.col("p.to").alias("t")).mapInPandas(run, shape)


def structure(posts: DataFrame, tokens: Column | None = None, extra: Callable[[list[list[int]], list[int], list[list[str]]], list[list[float]]] | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """What a post's place in its conversation says, from one shuffle: depth, width, degrees, flags, relative age and response time.

    ``(convo_id, uid, depth, width, in_degree, out_degree, true_degree, is_source, is_leaf, is_internal, is_author_source_author,
    relative_age, response_time)``, as ``depths``, ``widths``, ``degrees``, ``flags``, ``timing.relative_age`` and
    ``timing.response_time`` give them one by one. ``extra`` adds columns ``names`` from the reply places, their order and the ``tokens``.
    """
    micros = F.unix_micros("created_at").alias("at")
    item = F.struct("seq", "uid", F.coalesce("reply_to", F.array()).alias("to"), "author", micros, (F.array().cast("array<string>") if tokens is None else tokens).alias("tok"))
    threads = posts.groupBy("convo_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    shape = (
        "convo_id string, uid string, depth int, width bigint, in_degree bigint, out_degree bigint, true_degree bigint, is_source boolean, is_leaf boolean, is_internal boolean, "
        "is_author_source_author boolean, relative_age double, response_time double" + "".join(f", `{n}` double" for n in names)
    )
    columns = [x.split()[0].strip("`") for x in shape.split(", ")]

    def one(convo: str, uids: list, to: list, authors: list, times: list, tok: list) -> list[tuple]:
        up = places(uids, to)
        depth, order = walk(up)
        width, below = Counter(depth), Counter(p for ps in up for p in ps)
        origin = {a for a, ps in zip(authors, up) if not ps}
        timed = all(t is not None for t in times)
        begin = min(times) if timed else 0
        more = extra(up, order, tok) if extra else [[]] * len(uids)
        rows = []
        for i, u in enumerate(uids):
            out, into = len(to[i]), below[i]
            gaps = [abs(times[i] - times[p]) / 1e6 for p in up[i] if times[i] is not None and times[p] is not None]
            age = (times[i] - begin) / 1e6 if timed else -1.0
            rows.append((convo, u, depth[i], width[depth[i]], into, out, into + out, out == 0, into == 0, into > 0 and out > 0, authors[i] in origin, age, min(gaps, default=-1.0), *more[i]))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for conversation in zip(*(c.to_pylist() for c in batch.columns)) for row in one(*conversation)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=columns)

    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in shape.split(", ")]
    return threads.select("convo_id", *[f"p.{x}" for x in ("uid", "to", "author", "at", "tok")]).mapInArrow(run, shape)


def ancestors(posts: DataFrame, include_post: bool = False) -> DataFrame:
    """``(convo_id, uid, member)`` for everything a post replies to, directly or not."""
    return _with_self(depths(posts, True).select(*KEY, F.explode("ancestors").alias("member")), posts, include_post)


def descendants(posts: DataFrame, include_post: bool = False) -> DataFrame:
    """The inverse of ``ancestors``."""
    turned = ancestors(posts).select("convo_id", F.col("member").alias("uid"), F.col("uid").alias("member"))
    return _with_self(turned, posts, include_post)


def before_after(posts: DataFrame, after: bool = False, strict_nulls: bool = False) -> DataFrame:
    """``(convo_id, uid, member)`` for the posts before (or after) each in time, strictly.

    A post without a time has all posts of its conversation before and after it, itself
    included, or none with ``strict_nulls``; posts without a time are never before or after another.
    """
    other = posts.select("convo_id", F.col("uid").alias("member"), F.col("created_at").alias("t"))
    mine = posts.select(*KEY, "created_at")
    test = F.col("t") > F.col("created_at") if after else F.col("t") < F.col("created_at")
    return mine.join(other, "convo_id").where(test if strict_nulls else test | F.col("created_at").isNull()).select(*KEY, "member")


def degrees(posts: DataFrame) -> DataFrame:
    """``(convo_id, uid, in_degree, out_degree, true_degree)``: replies from inside, targets (also outside ones), their sum."""
    received = edges(posts).groupBy("convo_id", F.col("parent").alias("uid")).agg(F.count(F.lit(1)).alias("in_degree"))
    out = posts.select(*KEY, F.size(F.coalesce("reply_to", F.array())).cast("bigint").alias("out_degree"))
    joined = out.join(received, KEY, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("bigint")))
    return joined.select(*KEY, "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("true_degree"))


def widths(levels: DataFrame) -> DataFrame:
    """Add ``width``, the number of posts at a post's depth, to a table with ``depth``."""
    return levels.withColumn("width", F.count(F.lit(1)).over(Window.partitionBy("convo_id", "depth")))


def depth_distribution(posts: DataFrame) -> DataFrame:
    """``(convo_id, depth, n)``."""
    return depths(posts).groupBy("convo_id", "depth").agg(F.count(F.lit(1)).alias("n"))


def tree_metrics(posts: DataFrame, place: DataFrame | None = None) -> DataFrame:
    """``(convo_id, tree_depth, tree_width, tree_degree)``: greatest depth, level size and degree. ``place``: what ``structure`` gives, if it is there already."""
    level = structure(posts) if place is None else place
    return level.groupBy("convo_id").agg(F.max("depth").alias("tree_depth"), F.max("width").alias("tree_width"), F.max("true_degree").alias("tree_degree"))


def degree_distribution(posts: DataFrame, kind: str = "true_degree") -> DataFrame:
    """``(convo_id, degree, n)`` for 'true_degree', 'in_degree' or 'out_degree'."""
    return degrees(posts).groupBy("convo_id", F.col(kind).alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def density(posts: DataFrame) -> DataFrame:
    """``(convo_id, density)``: 2m / n(n-1) of the undirected graph, self loops counted; 0 for a single post."""
    vertices, pairs = as_graph(posts)
    n = vertices.groupBy("convo_id").agg(F.count(F.lit(1)).alias("n"))
    m = pairs.groupBy("convo_id").agg(F.count(F.lit(1)).alias("m"))
    value = F.when((F.col("n") <= 1) | F.col("m").isNull(), 0.0).otherwise(2 * F.col("m") / (F.col("n") * (F.col("n") - 1)))
    return n.join(m, "convo_id", "left").select("convo_id", value.alias("density"))


def source_authors(posts: DataFrame) -> DataFrame:
    """``(convo_id, author)`` of the posts without a target inside; a null author counts."""
    return sources(posts).select("convo_id", "author").distinct()


def flags(posts: DataFrame) -> DataFrame:
    """``(convo_id, uid, is_source, is_leaf, is_internal, is_author_source_author)``.

    Here a source is a post without any reply target, also outside ones."""
    return structure(posts).select(*KEY, "is_source", "is_leaf", "is_internal", "is_author_source_author")


def numeric_first(uid: Column) -> Column:
    """Sort key: whole numbers by value, then other ids by their text."""
    n = uid.try_cast("decimal(38,0)")
    return F.struct(n.isNull().alias("word"), n.alias("n"), uid.alias("s"))


def derived_ids(posts: DataFrame) -> DataFrame:
    """``(convo_id, derived_id)``: 'CONV_' and the ids of the sources, in order, joined by hyphens."""
    first = sources(posts).groupBy("convo_id").agg(F.array_sort(F.collect_list(numeric_first(F.col("uid")))).alias("s"))
    return first.select("convo_id", F.concat(F.lit("CONV_"), F.array_join(F.transform("s", lambda x: x["s"]), "-")).alias("derived_id"))


def segment(posts: DataFrame) -> DataFrame:
    """``posts`` with each conversation cut into its connected components, which are named by ``derived_ids``.

    Components are found over all conversations at once by rounds of re-linking."""
    vertex = lambda uid: F.concat_ws("\x01", "convo_id", uid)
    linked = connected_components(edges(posts).select(vertex("child").alias("src"), vertex("parent").alias("dst")))
    keyed = posts.withColumn("_v", vertex("uid")).join(linked.withColumnRenamed("node", "_v"), "_v", "left")
    parts = keyed.withColumn("_old", F.col("convo_id")).withColumn("convo_id", F.coalesce("component", "_v"))
    named = derived_ids(parts)
    return parts.join(named, "convo_id").withColumn("convo_id", F.col("derived_id")).select(*posts.columns)
