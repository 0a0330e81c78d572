"""Quality grades by ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm import wordhash as wh

BITS = 18  #: the text is hashed to 2**18 weights
MAX_LABELLED = 20_000  #: labelled rows that the fit uses at most, those of the least hash of the id
EPOCHS, BATCH, RATE, L1 = 12, 256, 0.3, 5e-5
STEPS = 4_000  #: mini-batches at least
TAIL = 0.4  #: least probability of the best grade for a document to be selected

_codes = np.arange(256)
_SPACE = ~wh.NOT_SPACE
_MARK = ~wh.ALNUM & wh.NOT_SPACE
_UPPER = (_codes >= 65) & (_codes < 91)
_LOWER = (_codes >= 97) & (_codes < 123)
_DIGIT = (_codes >= 48) & (_codes < 58)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature ids, offsets of the rows in them); no id twice in a row.

    Words in lower case that occur; runs of marks with their share of the words, by powers of
    two; and, in steps, the shares of capitals, digits and marks and of different words.
    """
    found, marks = wh.words(data, at), wh.words(data, at, _MARK)
    n = len(at) - 1
    row_w = np.repeat(np.arange(n), np.diff(found.first))
    row_m = np.repeat(np.arange(n), np.diff(marks.first))
    words = np.maximum(np.diff(found.first), 1)

    def unique(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        begin = np.flatnonzero(new)
        return r[begin], v[begin], np.diff(np.append(begin, len(r)))

    rw, vw, _ = unique(row_w, found.hash)
    rm, vm, cm = unique(row_m, marks.hash)
    level = np.floor(np.log2(cm / words[rm])).clip(-4, 2).astype(np.int64) + 10
    parts_row, parts = [rw, rm], [vw, wh.mix(vm + level.astype(np.uint64))]

    def total(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[found.data], dtype=np.int64)])[found.offsets])

    size = np.maximum(np.diff(found.offsets), 1)
    letters = np.maximum(total(_UPPER) + total(_LOWER), 1)
    different = np.bincount(rw, minlength=n) / np.minimum(words, 200 + words // 8)
    length = np.floor(np.log2(words)).astype(np.int64)
    for k, share in enumerate((total(_UPPER) / letters, total(_DIGIT) / size, total(_MARK) / size, different)):
        step = np.minimum((share * 16).astype(np.int64), 16)
        parts_row += [np.arange(n)]
        parts += [wh.mix((step + 100 * (k + 1) + 10_000 * (length if k == 3 else 0)).astype(np.uint64))]
    row, value = np.concatenate(parts_row), np.concatenate(parts)
    row, value, _ = unique(row, value >> np.uint64(64 - BITS))
    return value.astype(np.int32), np.searchsorted(row, np.arange(n + 1))


@dataclass
class OrdinalModel:
    """P(grade <= j) = 1 / (1 + exp(w.x - cuts[j])) with one weight vector for all grades."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): probability of a grade above j."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))


def fit(ids: np.ndarray, ends: np.ndarray, grades: np.ndarray, n_grades: int, epochs: int = EPOCHS, l1: float = L1) -> OrdinalModel:
    """Maximum likelihood by proximal AdaGrad over mini-batches with an L1 penalty, in an order fixed by a seed, from the cuts that the grades' shares give. Every feature of the rows takes part; which get a weight is left to the penalty."""
    dims = 1 << BITS
    # only features that occur are worked on
    used = np.flatnonzero(np.bincount(ids, minlength=dims))
    place = np.full(dims, -1, np.int64)
    place[used] = np.arange(len(used))
    ids = place[ids]
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-6)
    share = np.cumsum(np.bincount(grades, minlength=n_grades) + 0.5)[:-1] / (len(grades) + 0.5 * n_grades)
    cuts = np.log(share / (1 - share))
    c2 = np.full(n_grades - 1, 1e-6)
    edge = np.arange(n_grades + 1)
    rng = np.random.Generator(np.random.PCG64(5))
    size = np.diff(ends)
    for _ in range(max(epochs, -(-STEPS // -(-len(grades) // BATCH))) if len(grades) else 0):
        order = rng.permutation(len(grades))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            n = size[rows]
            done = np.concatenate([[0], np.cumsum(n)])
            take = np.repeat(ends[rows] - done[:-1], n) + np.arange(done[-1])
            x, owner = ids[take], np.repeat(np.arange(len(rows)), n)
            score = np.bincount(owner, w[x], len(rows))
            y = grades[rows]
            full = np.concatenate([[-40.0], cuts, [40.0]])
            up, low = full[edge[y + 1]] - score, full[edge[y]] - score
            pu, pl = 1 / (1 + np.exp(-np.clip(up, -40, 40))), 1 / (1 + np.exp(-np.clip(low, -40, 40)))
            mass = np.maximum(pu - pl, 1e-9)
            du, dl = pu * (1 - pu) / mass, pl * (1 - pl) / mass
            grad = np.bincount(x, ((du - dl) / len(rows))[owner], len(used))
            g2 += grad * grad
            rate = RATE / np.sqrt(g2)
            w -= rate * grad
            w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
            gc = np.array([(-du[y == j].sum() + dl[y == j + 1].sum()) / len(rows) for j in range(n_grades - 1)])
            c2 += gc * gc
            cuts = np.maximum.accumulate(cuts - RATE / np.sqrt(c2) * gc + 1e-6 * np.arange(n_grades - 1))
    weights = np.zeros(dims, np.float32)
    weights[used] = w
    return OrdinalModel(weights, cuts)


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 good but toxic, 2 good; null if either rating is null."""
    return F.when(quality.isNull() | toxic.isNull(), None).when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_labelled: int = MAX_LABELLED) -> OrdinalModel:
    """Fit on the documents that ``ratings`` grades (whole numbers from 0; null grades and ids are left out).

    An id rated more than once counts with its least grade, and one that occurs with several texts with the text of the least hash. At most ``max_labelled`` ids are
    used, those whose hashes are least, so the driver gets at most that many rows whatever the
    size of the corpus. Without any rated document every weight is 0.
    """
    rated = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(grade_col).cast("int").alias("_grade"))
    sample = rated.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(sample), "_id").select("_id", "_text", "_grade", F.xxhash64("_text").alias("_hash"))
    kind = dict(given.dtypes)["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = wh.strings(batch.column(1))
            for lo, hi in wh.chunks(at):
                ids, ends = features(data, at[lo : hi + 1])
                held = [batch.column(i).slice(lo, hi - lo) for i in (0, 3, 2)]
                yield pa.RecordBatch.from_arrays([*held, pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], names=["id", "h", "g", "f"])

    made = given.mapInArrow(run, f"id {kind}, h bigint, g int, f binary")
    rows = made.groupBy("id").agg(F.min(F.struct("h", "g", "f")).alias("x")).select("x.g", "x.f").toArrow()
    if rows.num_rows == 0:
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.zeros(2))
    frame = rows.sort_by([("g", "ascending"), ("f", "ascending")])
    lists = [np.frombuffer(x, np.int32) for x in frame.column("f").to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    grades = frame.column("g").to_numpy().astype(np.int64)
    return fit(np.concatenate(lists), ends, grades, max(3, int(grades.max()) + 1))


def score_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", expected: str = "expected_grade", tail: str = "p_best") -> DataFrame:
    """``docs`` with the expected grade and the probability of the best grade, rounded to 6 digits.

    Null and empty texts are graded 0 with probability 0. One row per row in a narrow step; the
    weights have a fixed size of 1 MB. Columns called as the new ones are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.cuts))

    @F.pandas_udf("e double, p double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, cuts = shipped.value
        held = OrdinalModel(weights, cuts)
        for texts in batches:
            data, at = wh.strings(pa.array(texts, pa.large_string(), from_pandas=True))
            e, p = np.zeros(len(texts)), np.zeros(len(texts))
            for lo, hi in wh.chunks(at):
                ids, ends = features(data, at[lo : hi + 1])
                score = np.bincount(np.repeat(np.arange(hi - lo), np.diff(ends)), weights[ids], hi - lo)
                above = held.tails(score)
                filled = np.diff(at[lo : hi + 1]) > 0
                e[lo:hi], p[lo:hi] = above.sum(axis=1) * filled, above[:, -1] * filled
            yield pd.DataFrame({"e": e, "p": p})

    given = docs.drop(expected, tail)
    name = "_rated" + "_" * max(map(len, docs.columns))
    rated = given.withColumn(name, rate(F.col(f"`{text_col}`").cast("string")))
    return rated.select(*[F.col(f"`{c}`") for c in given.columns], F.round(f"{name}.e", 6).alias(expected), F.round(f"{name}.p", 6).alias(tail))


def select_documents(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """The documents whose best grade has at least the probability ``tail``, with ``expected_grade`` and ``p_best``."""
    return score_documents(docs, train(docs, ratings, id_col, text_col), text_col).where(F.col("p_best") >= tail)
