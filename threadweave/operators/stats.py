"""Five statistics over long tables of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ("min", "max", "mean", "median", "std")


def to_long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """``(keys, feature, value)``: one row per feature column."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features])
    return df.select(*keys, F.inline(pairs))


def five_stats(long: DataFrame, keys: list[str], prefix: str, guard: bool = False) -> DataFrame:
    """``(keys, feature, value)`` with features ``<prefix>_<stat>_<feature>``.

    NaN is left out of all but the median, which it makes NaN; the deviation is that of a
    population, with ``guard`` 1 where there is at most one value.
    """
    v = F.when(~F.isnan("value"), F.col("value"))
    spread: Column = F.coalesce(F.stddev_pop(v), F.lit(float("nan")))
    made = long.groupBy(*keys, "feature").agg(
        F.coalesce(F.min(v), F.lit(float("nan"))).alias("min"), F.coalesce(F.max(v), F.lit(float("nan"))).alias("max"), F.coalesce(F.avg(v), F.lit(float("nan"))).alias("mean"),
        F.when(F.max(F.isnan("value")), float("nan")).otherwise(F.median(v)).alias("median"),
        (F.when(F.count(F.lit(1)) <= 1, 1.0).otherwise(spread) if guard else spread).alias("std"),
    )
    each = F.array(*[F.struct(F.concat(F.lit(f"{prefix}_{s}_"), F.col("feature")).alias("feature"), F.col(s).alias("value")) for s in STATS])
    return made.select(*keys, F.inline(each))


def five_of(values: np.ndarray, guard: bool = False) -> np.ndarray:
    """The five statistics, a row each, of every column; see ``five_stats``."""
    n = len(values)
    with np.errstate(all="ignore"):
        odd = np.isnan(values)
        if odd.any():
            known = (~odd).sum(0)
            held = np.where(odd, 0.0, values)
            least, most = np.where(odd, np.inf, values).min(0), np.where(odd, -np.inf, values).max(0)
            mean = held.sum(0) / known
            spread = np.sqrt(np.where(odd, 0.0, (values - mean) ** 2).sum(0) / known)
            least, most = np.where(known, least, np.nan), np.where(known, most, np.nan)
        else:
            least, most, mean = values.min(0), values.max(0), values.mean(0)
            spread = np.sqrt(((values - mean) ** 2).sum(0) / n)
        same = least == most  # exactly, not but for rounding
        mean, spread = np.where(same, least, mean), np.where(same, 0.0, spread)
        half = np.partition(values, [(n - 1) // 2, n // 2], axis=0)
        median = np.where(odd.any(0), np.nan, half[(n - 1) // 2] * 0.5 + half[n // 2] * 0.5)
    return np.stack([least, most, mean, median, np.ones_like(mean) if guard and n <= 1 else spread])


def laid_out(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = pa.array(matrix.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), flat)


def named_values(rows: DataFrame, keys: list[str], names: list[str], values: str = "v") -> DataFrame:
    """``(keys, feature, value)`` from an array of values."""
    pairs = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col(values).alias("value"))
    return rows.select(*keys, F.inline(pairs)).toDF(*keys, "feature", "value")


PART = 1_024  #: values of a column that are sent together
WAITING = 8_192  #: rows, of all keys, that a task holds for that


def five_of_columns(rows: DataFrame, names: list[str], prefix: str, key: str | None = None, guard: bool = False, values: str = "v") -> DataFrame:
    """``five_stats`` of the places of an array, over all rows or those of each value of a text column ``key``.

    Values are sent by column, many at once; the task of a column holds its values (8 bytes each), for the median."""
    n = len(names)
    part_shape = "key string, i int, part binary"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        waiting = 0

        def columns(k, blocks: list) -> pa.RecordBatch:
            turned = np.ascontiguousarray(np.concatenate(blocks).T)
            at = np.arange(n + 1, dtype=np.int64) * turned.shape[1] * 8
            part = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(turned)])
            return pa.RecordBatch.from_arrays([pa.array([k] * n, pa.string()), pa.array(np.arange(n), pa.int32()), part], names=["key", "i", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            codes = batch.column(0).dictionary_encode()
            place = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            for c in np.unique(place):
                own = order[np.searchsorted(place[order], c) : np.searchsorted(place[order], c, "right")]
                k = codes.dictionary[c].as_py() if c < len(codes.dictionary) else None
                blocks = held.setdefault(k, [])
                blocks.append(matrix[own])
                waiting += len(own)
                if (ready := sum(map(len, blocks))) >= PART:
                    yield columns(k, held.pop(k))
                    waiting -= ready
            if waiting > WAITING:
                for k in list(held):
                    yield columns(k, held.pop(k))
                waiting = 0
        for k, blocks in held.items():
            yield columns(k, blocks)

    def fives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict = {}
        at, blocks, count = None, [], 0

        def out() -> pa.RecordBatch:
            keys = [k for ks, _ in done.values() for k in ks]
            found = np.concatenate([five_of(np.stack(columns, 1), guard).T for _, columns in done.values()])
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), laid_out(found)], names=["key", "i", "f"])

        def end() -> int:
            column = np.concatenate(blocks)
            ks, columns = done.setdefault(len(column), ([], []))
            ks.append(at)
            columns.append(column)
            return len(column) + 100

        for batch in batches:
            for k, i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (k, i) != at:
                    count += end() if blocks else 0
                    if count > 1 << 20:
                        yield out()
                        count = 0
                    at, blocks = (k, i), []
                blocks.append(np.frombuffer(part.as_buffer(), np.float64).copy())
        if blocks:
            end()
            yield out()

    given = rows.select((F.lit(None) if key is None else F.col(key)).cast("string").alias("key"), F.col(values).alias("v"))
    columns = given.mapInArrow(parts, part_shape).repartition("key", "i").sortWithinPartitions("key", "i")
    made = columns.mapInArrow(fives, "key string, i int, f array<double>")
    each = F.arrays_zip(F.array(*[F.lit(f"{prefix}_{s}_") for s in STATS]).alias("s"), F.col("f").alias("value"))
    long = made.select("key", F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("name"), F.inline(each)).toDF("key", "name", "s", "value")
    return long.select(*([] if key is None else [F.col("key").alias(key)]), F.concat("s", "name").alias("feature"), "value")
