"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.session import cut

K = 10
EVERY = 50  #: rows whose id is divisible by it are the queries
MOST_CENTROIDS = 1_024  #: of each half, so at most a million cells; fewer for tables below 16 million rows
TRAIN = 65_536  #: vectors that the codebooks are fitted on at most, those of the least hash; every row is indexed
PROBES = 200  #: queries at least whose exact neighbours set how many entries a query looks at; one in PROBED of large tables
PROBED = 20
FOUND = 0.96  #: share of those neighbours that must be among the entries looked at
CLASSES = 8  #: groups of queries by distance from the centroids, each with a number of its own
ROWS, ASKED = 16_384, 4_096  #: entries, and queries, that a task compares (about)


@dataclass
class Index:
    """Codebooks of the halves, entries in every cell, and where a cell's entries are: in ``parts`` blocks from ``block`` on."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray
    block: np.ndarray
    parts: np.ndarray
    edges: np.ndarray  #: classes by summed distance from the nearest centroids
    budgets: np.ndarray

    @property
    def n_blocks(self) -> int:
        return int((self.block + self.parts).max())

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return distances(x[:, :half], self.first), distances(x[:, half:], self.second)


def blocks(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of every cell: cells in order fill blocks of about ``rows``; a larger one is spread over several of its own."""
    flat = counts.ravel()
    parts = np.maximum(-(-flat // rows), 1)
    block, at, held = np.zeros(len(flat), np.int64), 0, 0
    for i, n in enumerate(flat.tolist()):
        if held and held + n > rows:
            at, held = at + 1, 0
        block[i] = at
        if n > rows:
            at, held = at + int(parts[i]), 0
        else:
            held += n
    return block, parts


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centroids from a seeded choice of different rows; fewer if there are fewer."""
    x = np.unique(x, axis=0)
    centers = x[np.sort(np.random.Generator(np.random.PCG64(3)).permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        near = distances(x, centers).argmin(axis=1)
        n = np.bincount(near, minlength=len(centers))
        for d in range(x.shape[1]):
            total = np.bincount(near, x[:, d], len(centers))
            centers[n > 0, d] = total[n > 0] / n[n > 0]
    return centers


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Cells in order of summed distance until they hold ``budget`` entries, by a heap over the two sorted lists."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    n1, n2, have, out = len(o1), len(o2), 0, []
    reach = [0] * n1  # per place in the first list, how far the second is taken
    heap = [(s1[0] + s2[0], 0, 0)]
    counted = counts.tolist() if isinstance(counts, np.ndarray) else counts
    while heap and have < budget:
        _, i, j = heapq.heappop(heap)
        reach[i] = j + 1
        n = counted[o1[i]][o2[j]]
        if n:
            have += n
            out.append((o1[i], o2[j]))
        if j + 1 < n2 and (i == 0 or reach[i - 1] >= j + 2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if i + 1 < n1 and reach[i + 1] == j:
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.float32).reshape(-1, dims)


def closest(x: np.ndarray, ids: np.ndarray, cells: np.ndarray, q: np.ndarray, qids: np.ndarray, masks: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query ids, entry ids, squared distances to 6 digits, cells) of the k nearest ids in each query's cells.

    ``masks``: (queries, cells) looked at or not. Of an id's entries the nearest counts, and the least ids of equal distances are kept.
    """
    x, q = x.astype(np.float64), q.astype(np.float64)
    norm, qnorm = (x**2).sum(axis=1), (q**2).sum(axis=1)
    for b in range(0, len(q), 128):
        mask = masks[b : b + 128]
        at = np.flatnonzero(mask.any(axis=0)[cells])
        if not len(at):
            continue
        d = norm[at][None, :] - 2.0 * (q[b : b + 128] @ x[at].T) + qnorm[b : b + 128, None]
        d[~mask[:, cells[at]] | (ids[at][None, :] == qids[b : b + 128, None])] = np.inf
        slack = 2e-6 + 1e-12 * (norm[at].max() + qnorm[b : b + 128])
        left, most = np.arange(len(mask)), k
        while len(left):
            part = d[left]
            whole = most >= len(at)
            limit = np.full(len(left), np.inf) if whole else np.partition(part, most - 1, axis=1)[:, most - 1] + slack[left]
            row, near = np.nonzero((part <= limit[:, None]) & np.isfinite(part))
            row = left[row]
            exact = np.round(((q[b + row] - x[at[near]]) ** 2).sum(axis=1), 6)  # by differences: exact for close pairs
            order = np.lexsort((exact, ids[at[near]], row))
            row, near, exact = row[order], near[order], exact[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (ids[at[near[1:]]] != ids[at[near[:-1]]])
            row, near, exact = row[new], near[new], exact[new]
            # an id with several entries leaves room for others
            short = np.zeros(len(mask), bool)
            short[left] = (np.bincount(row, minlength=len(mask))[left] < k) & ~whole & np.isfinite(limit)
            ok = ~short[row]
            row, near, exact = row[ok], near[ok], exact[ok]
            order = np.lexsort((ids[at[near]], exact, row))
            row, near, exact = row[order], near[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, near, exact = row[rank < k], near[rank < k], exact[rank < k]
            yield qids[b + row], ids[at[near]], exact, cells[at[near]]
            left, most = np.flatnonzero(short), most * 4


def assign(vectors: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    """``(id, v, c1, c2)``: the nearest centroids of both halves."""
    shipped = vectors.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shipped.value
        half = one.shape[1]
        for batch in batches:
            x = matrix(batch.column(1), half + two.shape[1])
            c1, c2 = distances(x[:, :half], one).argmin(axis=1), distances(x[:, half:], two).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=["id", "v", "c1", "c2"])

    return vectors.mapInArrow(run, "id bigint, v array<float>, c1 int, c2 int")


def search(cells: DataFrame, asked: DataFrame, index: Index, k: int, whole: bool) -> DataFrame:
    """``(q, n, d, cell)``: the k nearest ids of every row of ``asked`` in each block that it looks at: all of them (``whole``) or as many entries as its class asks for."""
    spark = cells.sparkSession
    shipped = spark.sparkContext.broadcast(index)
    n2, dims = len(index.second), index.first.shape[1] + index.second.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for batch in batches:
            cell = batch.column(2).to_numpy().astype(np.int64) * n2 + batch.column(3).to_numpy()
            salt = batch.column(4).to_numpy()
            block = ix.block[cell] + salt % ix.parts[cell]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], names=["id", "v", "cell", "block"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        counts = ix.counts.tolist()
        last = np.append(np.flatnonzero(np.diff(ix.block)), len(ix.block) - 1)  # the last cell that begins in each block
        head = np.append(0, last[:-1] + 1)
        everything = ix.counts.ravel() > 0
        for batch in batches:
            x = matrix(batch.column(1), dims)
            d1, d2 = ix.centred(x)
            own = np.searchsorted(ix.edges, d1.min(axis=1) + d2.min(axis=1)) if not whole else np.zeros(len(x), int)
            row, block, bits = [], [], []
            for i in range(len(x)):
                probed = everything
                if not whole:
                    probed = np.zeros(len(ix.block), bool)
                    probed[[a * n2 + b for a, b in traverse(d1[i], d2[i], counts, int(ix.budgets[own[i]]))]] = True
                for g in np.unique(np.searchsorted(last, np.flatnonzero(probed))).tolist():
                    part = probed[head[g] : last[g] + 1]
                    packed = np.packbits(part).tobytes()
                    start = int(ix.block[head[g]])
                    for e in range(int((ix.parts[head[g] : last[g] + 1]).max())):
                        row.append(i), block.append(start + e), bits.append(packed)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(block, pa.int32()), pa.array(bits, pa.binary())], names=["id", "v", "chunk", "block", "bits"]
            )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ix = shipped.value
            cell, block = left.column("cell").to_numpy(), int(left.column("block")[0].as_py())
            begins = np.unique(ix.block)
            start = begins[np.searchsorted(begins, block, "right") - 1]
            head = int(np.searchsorted(ix.block, start))
            n = int(np.searchsorted(ix.block, start, "right")) - head
            masks = np.unpackbits(np.frombuffer(b"".join(right.column("bits").to_pylist()), np.uint8).reshape(right.num_rows, -1), axis=1)[:, :n].astype(bool)
            x, q = matrix(left.column("v"), dims), matrix(right.column("v"), dims)
            out = [(a, b, d, c + head) for a, b, d, c in closest(x, left.column("id").to_numpy(), cell - head, q, right.column("id").to_numpy(), masks, k)]
        join = lambda i, kind: pa.array(np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind))
        return pa.table({"q": join(0, np.int64), "n": join(1, np.int64), "d": join(2, np.float64), "cell": join(3, np.int32)})

    salted = cells.select("id", "v", "c1", "c2", F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)).alias("salt"))
    entries = salted.mapInArrow(place, "id bigint, v array<float>, cell int, block int")
    # queries of a chunk are near each other, and a block only meets chunks that look at it
    n_chunks = max(1, -(-asked.count() // ASKED))
    ordered = asked.repartitionByRange(n_chunks, "c1", "c2", F.xxhash64("id")).select("id", "v", F.spark_partition_id().alias("chunk"))
    spread = cut(ordered).repartition(max(n_chunks, spark.sparkContext.defaultParallelism * 2), "id")
    sent = cut(spread.mapInArrow(probe, "id bigint, v array<float>, chunk int, block int, bits binary"))
    meets = sent.select(F.col("chunk").alias("to"), F.col("block").alias("by")).distinct()
    copies = entries.join(meets, F.col("block") == F.col("by")).drop("by")
    return copies.groupBy("block", "to").cogroup(sent.groupBy("block", "chunk")).applyInArrow(compare, "q bigint, n bigint, d double, cell int")


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("q", "n").agg(F.min(F.struct("d", "cell")).alias("x")).select("q", "n", "x.d", "x.cell")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))).where(F.col("rank") <= k)


def calibrate(cells: DataFrame, asked: DataFrame, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, budgets): per class of queries the entries that hold ``FOUND`` of the exact neighbours of the probes in it."""
    n = asked.count()
    share = max(PROBES / max(n, 1), 1 / PROBED)
    probes = cut(asked.where(F.pmod(F.xxhash64("id", F.lit("probe")), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else asked)
    exact = ranked(search(cells, probes, index, k, True), k).groupBy("q").agg(F.collect_list("cell").alias("cells"))
    dims, n2 = index.first.shape[1] + index.second.shape[1], len(index.second)
    shipped = cells.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        flat = ix.counts.ravel()
        for batch in batches:
            d1, d2 = ix.centred(matrix(batch.column(0), dims))
            far, need = [], []
            for i, cells in enumerate(batch.column(1).to_pylist()):
                order = (d1[i][:, None] + d2[i][None, :]).ravel().argsort(kind="stable")
                until = np.empty(len(order), np.int64)
                until[order] = np.cumsum(flat[order])
                far += [float(d1[i].min() + d2[i].min())] * len(cells)
                need += until[cells].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(far, pa.float64()), pa.array(need, pa.int64())], names=["far", "need"])

    joined = probes.join(exact, probes["id"] == exact["q"]).select("v", "cells")
    needs = cut(joined.mapInArrow(run, "far double, need bigint"))
    steps = [i / CLASSES for i in range(1, CLASSES)]
    edges = needs.agg(F.percentile_approx("far", F.array(*map(F.lit, steps)), 10_000)).first()[0]
    total = int(index.counts.sum())
    if edges is None:
        return np.zeros(0), np.array([total])
    edges = np.unique(edges)
    group = sum((F.col("far") > float(e)).cast("int") for e in edges)
    rows = needs.groupBy(group.alias("g")).agg(F.percentile_approx("need", FOUND, 10_000)).collect()
    budgets = np.full(len(edges) + 1, total)
    for g, need in rows:
        budgets[g] = need
    return edges, budgets


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``(id_col, rank, neighbour_id, distance)``: the k nearest other rows, of all, for every row whose id is divisible by ``every``, by squared Euclidean distance to 6 digits.

    Both halves of the vectors are quantised by a codebook that grows with the root of the table up to 1,024 centroids, fitted on a bounded
    sample; a pair of centroids is a cell, and every row is indexed. A heap goes through a query's pairs by
    summed distance until the cells hold the budget of entries, and all of these are reranked by
    exact distance. Budgets are set for eight classes of queries, by how far they are from the centroids: exact neighbours of one query in twenty
    (200 at least) are found by brute force, and the budget of a class covers 96 in 100 of its; data without structure get budgets near
    the whole table. Cells are kept in blocks of about 16,384 entries, a larger cell in several, and queries in chunks of about 4,096 near ones; a
    block only meets the chunks that look at it, so a task's memory doesn't grow with the table.

    Rows with a null id, a null vector, null or not finite elements, or another length than most
    are neither queries nor entries. Rows that repeat an id with one vector count once; with
    different vectors each is an entry (and a query) and the nearest counts; an id is never its own neighbour.
    Equal distances rank by the least id. Fewer than k others give fewer rows, an empty table
    none. Ids must be whole numbers; other columns are ignored.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    given = given.where(F.col("id").isNotNull() & (F.size("v") > 1) & finite)
    dims = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], f"{id_col} bigint, rank int, neighbour_id bigint, distance double")
    held = given.where(F.size("v") == dims["d"]).dropDuplicates(["id", "v"])
    n_centroids = int(min(MOST_CENTROIDS, max(1, round(dims["count"] ** 0.5 / 4))))
    sample = np.array(held.orderBy(F.xxhash64("id"), "id").limit(min(TRAIN, 64 * n_centroids)).toPandas()["v"].tolist(), np.float32)
    half = dims["d"] // 2
    first, second = kmeans(sample[:, :half], n_centroids), kmeans(sample[:, half:], n_centroids)
    cells = cut(assign(held, first, second))
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in cells.groupBy("c1", "c2").count().collect():  # at most MOST_CENTROIDS squared
        counts[r["c1"], r["c2"]] = r["count"]
    index = Index(first, second, counts, *blocks(counts, ROWS), np.zeros(0), np.zeros(0, np.int64))
    asked = cells.where(F.col("id") % every == 0)
    index.edges, index.budgets = calibrate(cells, asked, index, k)
    best = ranked(search(cells, asked, index, k, False), k)
    return best.select(F.col("q").alias(id_col), "rank", F.col("n").alias("neighbour_id"), F.col("d").alias("distance"))
