"""All numbers of posts, users and conversations from one pass over each conversation, as arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.functions import harmonic
from threadweave.functions.text import partition_tokens
from threadweave.operators import entropy, graph
from threadweave.operators import features as fx
from threadweave.operators.stats import five_of, laid_out

SLICE = 1 << 18  #: tokens of conversations that are worked through together
_M, _D = len(fx.MIXING), len(fx.CONVO_POST_NUMBERS)
_SUMMED = [fx.CONVO_POST_NUMBERS.index(i) for i in fx.SUMMED_INTS]
_DEPTH, _WIDTH = (fx.CONVO_POST_NUMBERS.index(i) for i in ("depth", "width"))
#: The numbers of a user: floats first where they are counted up for the conversation, ints first in a user's vector.
USER = [*fx.USER_INTS, *fx.USER_FLOATS]
CONVO = [*fx.CONVO_FLOATS, *fx.CONVO_INTS]


def pass_over(posts: DataFrame, users: bool = True) -> DataFrame:
    """A row per conversation: ``convo_id``; ``posts``, of (uid, author, flags, v): the numbers ``CONVO_POST_NUMBERS``, flags ``CONVO_POST_BOOLS``;
    and with ``users`` also ``users``, of (author, is_source_author, v): the numbers ``USER``; ``v``: the numbers ``CONVO`` of the conversation.

    What ``features.post_in_convo_features`` and the aggregates over it say, from one shuffle and without a row for a number.
    A cycle raises."""
    keep = ["convo_id", "seq", "uid", F.coalesce("reply_to", F.array()).alias("to"), "author", F.unix_micros("created_at").alias("at"), partition_tokens(F.col("text")).alias("tok")]
    ints = fx.post_ints(posts.select("*", *[c for c in keep if not isinstance(c, str)]), ["convo_id", "seq", "uid", "to", "author", "at", "tok"])
    item = F.struct("seq", "uid", "to", "author", "at", "tok", F.array(*[f"`{c}`" for c in fx.POST_INTS]).alias("ints"))
    threads = ints.groupBy("convo_id").agg(F.array_sort(F.collect_list(item)).alias("p"))
    shape = "convo_id string, posts array<struct<uid: string, author: string, flags: array<boolean>, v: array<double>>>"
    if users:
        shape += ", users array<struct<author: string, is_source_author: boolean, v: array<double>>>, v array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, tokens = 0, 0
            # two lists deep: the posts of a conversation, the tokens of a post
            inner = batch.column("tok").flatten()
            size = np.diff(inner.offsets.to_numpy()) if len(inner) else np.zeros(0, int)
            number = np.diff(batch.column("tok").offsets.to_numpy())
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(number)]
            for hi in range(1, batch.num_rows + 1):
                if hi == batch.num_rows or ends[hi - 1] - tokens >= SLICE:
                    yield _one_slice(batch.slice(lo, hi - lo), users)
                    lo, tokens = hi, ends[hi - 1]

    return threads.select("convo_id", *[f"p.{x}" for x in ("uid", "to", "author", "at", "tok", "ints")]).mapInArrow(run, shape)


def _one_slice(batch: pa.RecordBatch, users: bool) -> pa.RecordBatch:
    names, vectors, held = batch.column(0), [], []
    for _, uids, to, authors, times, tok, ints in zip(*(c.to_pylist() for c in batch.columns)):
        up = graph.places(uids, to)
        depth, order = graph.walk(up)
        counts = [Counter(t) for t in tok]
        width, below = Counter(depth), Counter(p for ps in up for p in ps)
        origin = {a for a, ps in zip(authors, up) if not ps}
        timed = all(t is not None for t in times)
        begin = min(times) if timed else 0
        m = np.zeros((len(uids), _D))
        flags = np.zeros((len(uids), 4), bool)
        pairs = entropy.entropies(up, order, counts)
        for i in range(len(uids)):
            gaps = [abs(times[i] - times[p]) / 1e6 for p in up[i] if times[i] is not None and times[p] is not None]
            age = (times[i] - begin) / 1e6 if timed else -1.0
            m[i, _M:] = [age, min(gaps, default=-1.0), *pairs[i], *ints[i], depth[i], below[i], depth[i], width[depth[i]]]
            flags[i] = not to[i], not below[i], below[i] > 0 and len(to[i]) > 0, authors[i] in origin
        at = len(vectors)
        vectors += [list(c.values()) for c in counts]
        people: dict = {}
        if users:
            for i, a in enumerate(authors):
                people.setdefault(a, []).append(i)
            own, whole = {a: Counter() for a in people}, Counter()
            for a, c in zip(authors, counts):
                own[a].update(c)
                whole.update(c)
            # the fit and the types of posts without an author aren't asked for
            vectors += [list(c.values()) if a is not None else [] for a, c in own.items()] + [list(whole.values())]
            shares = [entropy.against(c, whole) if len(people) > 1 else 0.0 for c in own.values()]
            degree = max(below[i] + len(to[i]) for i in range(len(uids)))
            seconds = [t / 1e6 for t in times] if timed else [0.0, -1.0]
            n = len(uids)
            single = [max(seconds) - min(seconds) if timed else -1.0, 2 * sum(map(len, up)) / (n * (n - 1)) if n > 1 else 0.0, degree, len(whole)]
        else:
            shares = single = None
        held.append((uids, authors, m, flags, at, people, origin, shares, single))
    fits = harmonic.mixing_many(vectors)
    rows, wide = [], []
    for uids, authors, m, flags, at, people, origin, shares, single in held:
        m[:, :_M] = fits[at : at + len(uids)]
        if not users:
            continue
        at += len(uids)
        each = np.zeros((len(people), len(USER)))
        for j, (a, own) in enumerate(people.items()):
            part = m[own]
            types = 0 if a is None else len(vectors[at + j])
            each[j] = [len(own), types, *flags[own].sum(0), *part[:, _SUMMED].sum(0), *fits[at + j], shares[j], *five_of(part).T.ravel()]
            rows.append((a, a in origin))
        duration, density, degree, types = single
        k = len(fx.USER_INTS)
        by_user = five_of(np.concatenate([each[:, k:], each[:, :k]], 1), guard=True).T.ravel()
        tree = [len(uids), degree, m[:, _DEPTH].max(), m[:, _WIDTH].max(), types, len(people)]
        wide.append((each, np.concatenate([fits[at + len(people)], [duration, density], five_of(m).T.ravel(), by_user, tree, flags.sum(0), m[:, _SUMMED].sum(0)])))
    flat = lambda x, t: pa.array([v for one in held for v in one[x]], t)
    numbers = [len(one[0]) for one in held]
    matrix, bits = (np.concatenate([one[x] for one in held]) for x in (2, 3))
    items = pa.StructArray.from_arrays([flat(0, pa.string()), flat(1, pa.string()), laid_out(bits), laid_out(matrix)], names=["uid", "author", "flags", "v"])
    columns = [names, _lists(numbers, items)]
    if users:
        own = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), laid_out(np.concatenate([w[0] for w in wide]))], names=["author", "is_source_author", "v"])
        columns += [_lists([len(one[5]) for one in held], own), laid_out(np.stack([w[1] for w in wide]))]
    return pa.RecordBatch.from_arrays(columns, names=["convo_id", "posts", "users", "v"][: len(columns)])


def _lists(numbers: list[int], items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(numbers)]), pa.int32()), items)


def post_rows(passed: DataFrame) -> DataFrame:
    """``(convo_id, uid, author, flags, v)``."""
    return passed.select("convo_id", F.inline("posts"))


def user_rows(passed: DataFrame) -> DataFrame:
    """``(convo_id, author, is_source_author, v)``."""
    return passed.select("convo_id", F.inline("users"))
