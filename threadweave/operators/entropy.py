"""Token entropy of posts, users and splits of a conversation against each other."""

from __future__ import annotations

from collections import Counter, OrderedDict
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.functions.text import partition_tokens
from threadweave.operators.graph import all_above, structure

KEPT = 4_096  #: distributions of a conversation that are held at once
SPLITS = ("ancestors", "children", "descendants", "full", "parents", "post", "siblings")
PAIRS = tuple((a, b) for a in SPLITS for b in SPLITS if a != b and b != "post")
NAMES = tuple(f"avg_token_entropy_{a}-{b}" for a, b in PAIRS)
#: Left sides that contain the right side by construction, so the entropy is 0.
ALWAYS_ZERO = frozenset(
    [("full", b) for b in SPLITS if b not in ("full", "post")] + [("ancestors", "parents"), ("descendants", "children")]
)


def against(left: Counter, joint: Counter) -> float:
    """Negative logs of the joint shares of the left side's types, each once, per token of the
    left side and in units of the log of the joint number of types."""
    tokens, types, total = sum(left.values()), len(joint), sum(joint.values())
    if not tokens or types < 2:
        return 0.0
    # the shares' logs as differences, so that no step is taken in Python for a type
    return (len(left) * log(total) - sum(map(log, map(joint.__getitem__, left)))) / (log(types) * tokens)


def splits(up: list[list[int]], order: list[int]) -> list[dict[str, frozenset]]:
    """For every post the members (as places) of its seven splits, itself included; ``up`` and ``order`` as ``walk`` has them."""
    n = len(up)
    above = all_above(up, order)
    down: list[set[int]] = [set() for _ in range(n)]
    below: list[set[int]] = [set() for _ in range(n)]
    for i in range(n):
        for p in up[i]:
            down[p].add(i)
        for a in above[i]:
            below[a].add(i)
    everyone = frozenset(range(n))
    out = []
    for i in range(n):
        beside = set().union(*(down[p] for p in up[i])) if up[i] else set()
        sets = {"ancestors": above[i], "children": down[i], "descendants": below[i], "parents": set(up[i]), "siblings": beside}
        out.append({k: frozenset(v | {i}) for k, v in sets.items()} | {"full": everyone, "post": frozenset([i])})
    return out


def entropies(up: list[list[int]], order: list[int], tokens: list) -> list[list[float]]:
    """The 36 values of every post of one conversation.

    Distributions of equal member sets are built once, and one that has few members more than another is carried on from
    that; only the last KEPT are held, so memory doesn't grow with the square of the posts.
    """
    counts = [Counter(t) for t in tokens]
    known: OrderedDict[frozenset, Counter] = OrderedDict()

    def dist(members: frozenset, near: frozenset | None = None) -> Counter:
        if members in known:
            known.move_to_end(members)
            return known[members]
        carried = near in known and near <= members
        total = known[near].copy() if carried else Counter()
        for i in members - near if carried else members:
            total.update(counts[i])
        known[members] = total
        if len(known) > KEPT:
            known.popitem(last=False)
        return total

    done: dict[tuple, float] = {}
    out = []
    for parts in splits(up, order):
        row = []
        for a, b in PAIRS:
            left, joint = parts[a], parts[a] | parts[b]
            key = left, joint, a == "post"
            if key not in done:
                done[key] = 0.0 if a != "post" and len(joint) == len(left) else against(dist(left), dist(joint, left))
            row.append(done[key])
        out.append(row)
    return out


def entropy_pairs(posts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(convo_id, uid, avg_token_entropy_<a>-<b> ...)``: 36 columns.

    The tokens of a conversation meet in one row, so its member sets and distributions are made
    locally: one shuffle of the tokens, instead of one row for every post, pair, member and token.
    """
    return with_structure(posts, tokens).select("convo_id", "uid", *[f"`{n}`" for n in NAMES])


def with_structure(posts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``graph.structure`` and the 36 columns, from the same shuffle."""
    return structure(posts, partition_tokens(F.col("text")) if tokens is None else tokens, entropies, NAMES)


def token_counts(posts: DataFrame, keys: tuple[str, ...], tokens: Column | None = None) -> DataFrame:
    """``(keys, token, n)``."""
    tokens = partition_tokens(F.col("text")) if tokens is None else tokens
    return posts.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def user_entropy(posts: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(convo_id, author, avg_user_token_entropy)``: a user's posts against their conversation; 0 for a sole author."""
    own = token_counts(posts, ("convo_id", "author"), tokens)
    whole = own.groupBy("convo_id", "token").agg(F.sum("n").alias("all"))
    size = whole.groupBy("convo_id").agg(F.sum("all").alias("m"), F.count(F.lit(1)).alias("types"))
    authors = posts.groupBy("convo_id").agg(F.count_distinct(F.coalesce(F.concat(F.lit("a"), F.col("author")), F.lit("0"))).alias("users"))
    shares = own.join(whole, ["convo_id", "token"]).join(size, "convo_id").groupBy("convo_id", "author").agg(
        F.sum(F.ln(F.col("all") / F.col("m"))).alias("s"), F.sum("n").alias("own"), F.first("types").alias("types")
    )
    value = F.when((F.col("users") < 2) | (F.col("types") < 2), 0.0).otherwise(-F.col("s") / (F.ln("types") * F.col("own")))
    everyone = posts.select("convo_id", F.col("author").alias("a")).distinct()
    kept = shares.join(authors, "convo_id").select("convo_id", "author", value.alias("v"))
    same = (F.col("e.convo_id") == F.col("k.convo_id")) & F.col("e.a").eqNullSafe(F.col("k.author"))
    return everyone.alias("e").join(kept.alias("k"), same, "left").select(F.col("e.convo_id").alias("convo_id"), F.col("e.a").alias("author"), F.coalesce("k.v", F.lit(0.0)).alias("avg_user_token_entropy"))
