"""Harmonic mixing and novelty of rank-frequency vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = 0.001, 1.0
KEYS = ("k1", "theta", "entropy", "N_avg", "M_avg")
TYPE = "struct<k1:double,theta:double,entropy:double,N_avg:double,M_avg:double>"
ZERO = dict.fromkeys(KEYS, 0.0)


def bounded(k: float) -> float:
    """Beyond a bound, one percent of the range inside it."""
    if k > HIGH:
        return 0.99 * (HIGH - LOW) + LOW
    return 0.01 * (HIGH - LOW) + LOW if k < LOW else k


def plateaus(f: np.ndarray) -> np.ndarray:
    """For a descending vector, the last rank that has the same frequency."""
    return len(f) - np.searchsorted(f[::-1], f, "left")


def model(k: float, f: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """(weights, theta, N_avg, M_avg); without a model (M_avg at most 1) weights are zeros."""
    n = int(ranks[-1])
    mean_rank = n / (1 / np.arange(1, n + 1)).sum()
    m = float(f.sum()) * k
    if m <= 1:
        return np.zeros(len(f)), 0.0, 0.0, m
    theta = np.log10(f[0] * k) / np.log10(m)
    size = (1 - theta) * m
    with np.errstate(all="ignore"):
        return (ranks - theta) ** -theta * (1 - (1 + mean_rank / ranks) ** (-size / mean_rank)), float(theta), float(size), m


def loss(k: float, f: np.ndarray, ranks: np.ndarray) -> float:
    weights = model(bounded(k), f, ranks)[0]
    total = weights.sum()
    if not total:
        return 0.0
    with np.errstate(all="ignore"):
        return float(-(f * np.log10(weights / total)).sum())


def simplex(start: float, cost, tolerance: float = 0.1, rounds: int = 999) -> float:
    """Nelder and Mead's search in one dimension (reflect 1, expand 2, contract and shrink 1/2)."""
    points = [(cost(start), start), (cost(second := start * 1.05 if start else 0.00025), second)]
    points.sort(key=lambda p: p[0])
    for _ in range(rounds):
        (fb, best), (fw, worst) = points
        if abs(worst - best) <= tolerance and abs(fw - fb) <= tolerance:
            break
        step = best - worst
        reflected = cost(best + step)
        if reflected < fb:
            far = cost(best + 2 * step)
            new = (far, best + 2 * step) if far < reflected else (reflected, best + step)
        else:
            outside = reflected < fw
            at = best + step / 2 if outside else best - step / 2
            value = cost(at)
            if value <= reflected if outside else value < fw:
                new = value, at
            else:
                at = best - step / 2
                new = cost(at), at
        points = sorted([points[0], new], key=lambda p: p[0])
    return points[0][1]


def mixing_of(frequencies) -> dict[str, float]:
    """Fit of one frequency vector in any order; zeros if it is empty."""
    f = np.sort(np.asarray(frequencies, float))[::-1]
    if not len(f):
        return dict(ZERO)
    ranks = plateaus(f)
    k = bounded(simplex(len(f) / f.sum(), lambda x: loss(x, f, ranks)))
    weights, theta, size, m = model(k, f, ranks)
    if m <= 1:
        return ZERO | {"k1": float(k), "M_avg": m}
    with np.errstate(all="ignore"):
        entropy = -(f / f.sum()) @ np.log10(weights / weights.sum()) / np.log10(len(f))
    return {"k1": float(k), "theta": theta, "entropy": float(entropy), "N_avg": size, "M_avg": m}


def _profile(frequencies) -> tuple[np.ndarray, np.ndarray]:
    """The different frequencies, in descending order, and how many types have each."""
    f, n = np.unique(np.asarray(frequencies, float), return_counts=True)
    return f[::-1], n[::-1]


def mixing_many(vectors: list) -> np.ndarray:
    """The fits of many frequency vectors side by side, a row of ``KEYS`` each, as ``mixing_of`` gives them one by one: types of
    one frequency share their rank and weight, so only different frequencies are looked at, and each step of the search is taken for all vectors at once."""
    out = np.zeros((len(vectors), len(KEYS)))
    full = [i for i, v in enumerate(vectors) if len(v)]
    if not full:
        return out
    parts = [_profile(vectors[i]) for i in full]
    size = np.array([len(f) for f, _ in parts])
    f, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float)
    first = np.cumsum(size) - size
    before = np.cumsum(n)
    ranks = before - np.repeat(before[first] - n[first], size)
    types, total, top = np.add.reduceat(n, first), np.add.reduceat(n * f, first), f[first]
    mean_rank = types / np.cumsum(1 / np.arange(1, int(types.max()) + 1))[types.astype(int) - 1]
    where = np.repeat(np.arange(len(full)), size)

    def bound(k: np.ndarray) -> np.ndarray:
        return np.where(k > HIGH, 0.99 * (HIGH - LOW) + LOW, np.where(k < LOW, 0.01 * (HIGH - LOW) + LOW, k))

    def models(k: np.ndarray, some: np.ndarray):
        """(entries, where they belong among ``some``, weights, theta, N_avg, M_avg)"""
        if len(some) == len(full):
            entry, own = slice(None), where
        else:
            entry = np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
            own = np.repeat(np.arange(len(some)), size[some])
        m = total[some] * k
        good = m > 1
        with np.errstate(all="ignore"):
            theta = np.where(good, np.log10(top[some] * k) / np.log10(m), 0.0)
            amount = np.where(good, (1 - theta) * m, 0.0)
            r, t, mean = ranks[entry], theta[own], mean_rank[some][own]
            weights = np.where(good[own], (r - t) ** -t * (1 - (1 + mean / r) ** (-amount[own] / mean)), 0.0)
        return entry, own, weights, theta, amount, m

    def shares(k: np.ndarray, some: np.ndarray):
        entry, own, weights, *rest = models(k, some)
        begin = np.cumsum(size[some]) - size[some]
        whole = np.add.reduceat(n[entry] * weights, begin)
        with np.errstate(all="ignore"):
            value = np.add.reduceat(n[entry] * f[entry] * np.log10(weights / whole[own]), begin)
        return whole, value, *rest

    def cost(x: np.ndarray, some: np.ndarray) -> np.ndarray:
        whole, value, *_ = shares(bound(x), some)
        return np.where(whole == 0, 0.0, -value)

    every = np.arange(len(full))
    start = types / total
    x = np.stack([start, start * 1.05], 1)
    y = np.stack([cost(x[:, 0], every), cost(x[:, 1], every)], 1)

    def sort(i: np.ndarray) -> None:
        turn = i[y[i, 1] < y[i, 0]]
        x[turn], y[turn] = x[turn, ::-1], y[turn, ::-1]

    sort(every)
    for _ in range(999):
        going = every[~((np.abs(x[:, 1] - x[:, 0]) <= 0.1) & (np.abs(y[:, 1] - y[:, 0]) <= 0.1))]
        if not len(going):
            break
        best, worst, fb, fw = x[going, 0], x[going, 1], y[going, 0], y[going, 1]
        step = best - worst
        new_x = best + step
        new_y = reflected = cost(new_x, going)
        grow, outside = reflected < fb, reflected < fw
        other = np.where(grow, best + 2 * step, np.where(outside, best + step / 2, best - step / 2))
        value = cost(other, going)
        taken = np.where(grow, value < reflected, np.where(outside, value <= reflected, value < fw))
        new_x, new_y = np.where(taken, other, new_x), np.where(taken, value, new_y)
        shrink = ~grow & ~taken
        if shrink.any():
            at = (best - step / 2)[shrink]
            new_x[shrink], new_y[shrink] = at, cost(at, going[shrink])
        x[going, 1], y[going, 1] = new_x, new_y
        sort(going)
    k = bound(x[:, 0])
    whole, value, theta, amount, m = shares(k, every)
    with np.errstate(all="ignore"):
        entropy = -(value / total) / np.log10(types)
    some = m > 1
    out[full] = np.stack([k, *(np.where(some, v, 0.0) for v in (theta, entropy, amount)), m], 1)
    return out


def novelty_of(frequencies) -> list[float]:
    """Harmonic mean of the two plateau exponents, per type in descending order; [] if empty."""
    f = np.sort(np.asarray(frequencies, float))[::-1]
    if not len(f):
        return []
    values, first, n = np.unique(-f, return_index=True, return_counts=True)
    c = np.cumsum(f)[first + n - 1] / -values
    a1, a2 = np.ones(len(values)), np.ones(len(values))
    a1[1:] += np.log10(values[:-1] / values[1:]) / np.log10(c[1:] / c[:-1])
    a2[1:] = n[1:] / (c[1:] - c[:-1])
    return np.repeat(2 / (1 / a1 + 1 / a2), n).tolist()


def mixing(frequencies: Column) -> Column:
    """Struct (k1, theta, entropy, N_avg, M_avg) of an array of frequencies."""

    @F.pandas_udf(TYPE)
    def run(vectors: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(mixing_many([x if x is not None else [] for x in vectors]), columns=list(KEYS))

    return run(frequencies)


def mixing_of_tokens(tokens: Column) -> Column:
    """The same of the frequencies of the tokens in an array."""

    @F.pandas_udf(TYPE)
    def run(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(mixing_many([list(Counter(x).values()) if x is not None else [] for x in lists]), columns=list(KEYS))

    return run(tokens)


def mixing_closed_form(n_types: Column, n_tokens: Column, top: Column) -> dict[str, Column]:
    """k1 = types/tokens in place of the fit, so M_avg = types: k1, theta and N_avg without a search."""
    k = n_types / n_tokens
    theta = F.when(n_types > 1, F.log10(top * k) / F.log10(n_types.cast("double"))).otherwise(0.0)
    size = F.when(n_types > 1, (1 - theta) * n_types).otherwise(0.0)
    return {"k1": k, "theta": theta, "N_avg": size, "M_avg": n_types.cast("double")}


def novelty(freq: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """``(keys, n, types, novelty)`` per plateau of the frequencies of each group, by windows alone."""
    level = freq.groupBy(*keys, F.col(count).alias("n")).agg(F.count(F.lit(1)).alias("types"))
    down = Window.partitionBy(*keys).orderBy(F.desc("n"))
    c = F.sum(F.col("n") * F.col("types")).over(down) / F.col("n")
    step = level.withColumn("c", c).withColumn("c0", F.lag("c").over(down)).withColumn("n0", F.lag("n").over(down))
    a1 = 1 + F.log10(F.col("n0") / F.col("n")) / F.log10(F.col("c") / F.col("c0"))
    a2 = F.col("types") / (F.col("c") - F.col("c0"))
    return step.select(*keys, "n", "types", F.when(F.col("c0").isNull(), 1.0).otherwise(2 / (1 / a1 + 1 / a2)).alias("novelty"))
