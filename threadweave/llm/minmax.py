"""Near-duplicate documents by min-max hashing, banding and verified groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm import wordhash as wh
from threadweave.operators.components import connected_components
from threadweave.session import cut

SHINGLE = 3  #: words
PERMUTATIONS = 64  #: each gives a minimum and a maximum, 128 values in all
ROWS = 4  #: values in a band, so 32 bands
THRESHOLD = 0.5  #: estimated Jaccard similarity of two near duplicates
BLOCK = 8_192  #: signatures of a bucket that a task compares with as many others; larger buckets are compared block by block

_rng = np.random.Generator(np.random.PCG64(77))
_XOR = _rng.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(found: wh.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows that have any, their first hash). A row with fewer than k words has one shingle of all."""
    h, first = found.hash, found.first
    n = np.diff(first)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[:-1][row] if len(h) else np.zeros(0, np.int64)
    left = n[row] - place
    out = np.zeros(len(h), np.uint64)
    for i in range(k):
        out += np.where(left > i, wh.mix(padded[i : i + len(h)] + np.uint64(i + 1)), np.uint64(0))
    keep = (left >= k) | (place == 0)
    counts = np.bincount(row[keep], minlength=len(n)) if len(h) else np.zeros(len(n), np.int64)
    rows = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[rows])[:-1]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    return wh.mix(out[keep]), rows, starts


def minmax(hashes: np.ndarray, starts: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """(rows, 2 * permutations): the least value under every permutation, then the greatest."""
    out = np.empty((2 * permutations, len(starts)), np.uint32)
    for p in range(permutations):
        value = (((hashes ^ _XOR[p]) * _MUL[p]) >> np.uint64(32)).astype(np.uint32)
        out[p], out[permutations + p] = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
    return out.T


def banded(signature: np.ndarray) -> np.ndarray:
    """The values in an order in which ROWS successive ones make a band, 16 bits of each. A band
    mixes minima and maxima of different permutations, as those of one depend on each other."""
    half = signature.shape[1] // 2
    order = np.empty(2 * half, np.int64)
    order[0::2], order[1::2] = np.arange(half), half + (np.arange(half) + half // 2) % half
    return np.ascontiguousarray((signature[:, order] & np.uint32(0xFFFF)).astype("<u2"))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE, permutations: int = PERMUTATIONS) -> DataFrame:
    """``(id, key, sig binary)``: min-max signatures, 16 bits of each value; ``key`` is a hash of id and text. Texts without a word are hashed as a whole, empty ones left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            data, at = wh.strings(batch.column(2))
            for lo, hi in wh.chunks(at):
                found = wh.words(data, at[lo : hi + 1])
                hashes, rows, starts = shingles(found, k)
                bare = np.flatnonzero((np.diff(found.first) == 0) & (np.diff(found.offsets) > 0))
                if len(bare):
                    whole = wh.words(data, at[lo : hi + 1], np.ones(256, bool), apart=False)
                    hashes = np.concatenate([hashes, whole.hash[whole.first[bare]]])
                    starts = np.concatenate([starts, len(hashes) - len(bare) + np.arange(len(bare))])
                    rows = np.concatenate([rows, bare])
                if len(rows):
                    made, which = banded(minmax(hashes, starts, permutations)), pa.array(rows + lo)
                    yield pa.RecordBatch.from_arrays([ids.take(which), keys.take(which), pa.array([x.tobytes() for x in made], pa.binary())], names=["id", "key", "sig"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t <> ''")
    return given.select("id", F.xxhash64("id", "t").alias("key"), "t").mapInArrow(run, f"id {dict(given.dtypes)['id']}, key bigint, sig binary")


def linked(sig: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row of its component, where rows are linked whose signatures agree in ``threshold`` of the values.

    A row in hand is compared with all that no component has yet, so every link between two
    components is looked at, and a group of m alike rows costs m comparisons and not m squared.
    """
    n = len(sig)
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        todo = [seed]
        free = np.flatnonzero(label < 0)
        while todo and len(free):
            near = (sig[free] == sig[todo.pop()]).mean(axis=1) >= threshold
            label[free[near]] = seed
            todo += free[near].tolist()
            free = free[~near]
    return label


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, keeper_id, n_links, key, keeper_key)`` for every document that is a near duplicate of another, but for the kept one.

    Words are runs of letters and digits, ASCII letters in lower case, and single letters of scripts without spaces; shingles are of 3 words.
    Under each of 64 permutations the least and the greatest hash are kept. Two documents are
    candidates if one of the 32 bands of 4 values agrees, and near duplicates if at least half of
    the 128 values do, an unbiased estimate of the Jaccard similarity. Groups are the connected
    components, and the least id of a group (of its rows, the least ``key``) is its keeper. ``n_links``: other rows of the same
    signature, and the other signatures that were compared with it and found alike.

    Documents of one signature are first merged to one, so thousands of exact copies cost as much as one; in a bucket, signatures are compared until
    each has its component (``linked``). Buckets are only counted where they are grouped, never collected: one of more
    than ``BLOCK`` signatures is split, and every two of its blocks meet in a task of their own, so none is left out and no task grows.
    A document is an id with a text: ``key``, a hash of both, tells rows of one id with different texts apart, and
    rows that repeat both give one row. Null ids, null and empty texts are never in a group. Texts
    of fewer than 3 words have one shingle, those without a word are compared as a whole. Ties don't occur, as only
    ids and keys order a group. An empty table gives no rows; other columns are ignored.
    """
    signed = cut(signatures(docs, id_col, text_col))
    reps = cut(signed.groupBy("sig").agg(F.min(F.struct("id", "key")).alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("sig")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(2 * PERMUTATIONS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = reps.select("h", F.explode(keys).alias("band"))
    filled = bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "band")
    # buckets of the same members are worked through once
    marks = filled.groupBy("band").agg(F.bit_xor(F.xxhash64("h", F.lit(1))).alias("a"), F.bit_xor(F.xxhash64("h", F.lit(2))).alias("b"), F.max("size").alias("size"))
    once = marks.groupBy("a", "b", "size").agg(F.min("band").alias("band")).select("band")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("h", F.lit(3)), parts.cast("bigint")).cast("int")
    members = filled.join(once, "band").select("band", "h", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    members = members.select("h", "band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))
    kind = reps.schema["rep"].dataType.simpleString()

    def link(table: pa.Table) -> pa.Table:
        ids = table.column("rep").combine_chunks()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(len(ids), -1)
        label = linked(sig, threshold)
        far = label != np.arange(len(label))
        return pa.table({"src": ids.filter(pa.array(far)), "dst": ids.take(pa.array(label[far]))})

    compared = members.join(reps.select("h", "rep", "sig"), "h").select("band", "one", "two", "rep", "sig")
    pairs = cut(compared.groupBy("band", "one", "two").applyInArrow(link, f"src {kind}, dst {kind}").distinct())
    groups = connected_components(pairs)
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    owners = reps.where("n > 1").select("rep").unionByName(groups.select(F.col("node").alias("rep"))).distinct()
    rooted = owners.join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left").select("rep", F.coalesce("component", "rep").alias("keeper"), F.coalesce("links", F.lit(0)).alias("links"))
    by_sig = reps.select("sig", "rep", "n").join(rooted, "rep").select("sig", "keeper", (F.col("links") + F.col("n") - 1).alias("n_links"))
    found = signed.join(by_sig, "sig").where("struct(id, key) <> keeper")
    return found.select(F.col("id").alias("doc_id"), F.col("keeper.id").alias("keeper_id"), "n_links", "key", F.col("keeper.key").alias("keeper_key")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the near duplicates, one row of each group left.

    Of rows that repeat an id and a text one stays, whichever; rows with a null id, a null or an empty text all stay. The columns stay as they are.
    """
    gone = near_groups(docs, id_col, text_col, threshold).select("key").distinct()
    key = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    text = F.col(f"`{text_col}`").cast("string")
    whole = F.col(f"`{id_col}`").isNotNull() & text.isNotNull() & (text != "")
    marked = docs.withColumn(key, F.when(whole, F.xxhash64(F.col(f"`{id_col}`"), text)))
    kept = marked.join(gone.withColumnRenamed("key", key), key, "left_anti")
    repeated = cut(marked.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return kept.drop(key)
    some, others = kept.join(repeated, key, "left_semi"), kept.join(repeated, key, "left_anti")
    return others.unionByName(some.dropDuplicates([key])).drop(key)
