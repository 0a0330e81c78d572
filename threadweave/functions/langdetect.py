"""Language detection: a pluggable guess with a certainty, and the rule that applies it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.functions.text import detected

SHAPE = "struct<lang:string,certainty:double>"
ALPHABET = 1 << 14  #: code points whose letters stand in a table
CHARS = 1 << 20  #: characters that are looked up at once


def no_guess(text: Column) -> Column:
    """The base detector: 'und' with certainty 0."""
    return F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("certainty"))


def profile(rows: list[tuple[str, str]], n: int = 3) -> dict[str, Counter]:
    """Counts of letter n-grams per language from (language, text) pairs."""
    out: dict[str, Counter] = {}
    for lang, text in rows:
        padded = f" {text.lower()} "
        out.setdefault(lang, Counter()).update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return out


def train(texts: DataFrame, per_language: int = 200) -> dict[str, Counter]:
    """Profiles from ``per_language`` texts of each language, whole, those of the least hash: a bounded sample of labelled rows."""
    from pyspark.sql import Window

    known = texts.where("lang IS NOT NULL AND lang <> 'und' AND text <> ''").select("lang", "text", F.xxhash64("text").alias("_h"))
    # the hashes alone say which texts to look at
    least = known.select("lang", "_h").withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= per_language)
    most = {r["lang"]: r["m"] for r in least.groupBy("lang").agg(F.max("_h").alias("m")).collect()}
    near = F.lit(False)
    for lang, m in most.items():
        near = near | ((F.col("lang") == lang) & (F.col("_h") <= m))
    order = Window.partitionBy("lang").orderBy("_h", "text")
    sample = known.where(near).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language)
    return profile([(r["lang"], r["text"]) for r in sample.select("lang", "text").collect()])


class Grams:
    """Weights of the n-grams of profiles, looked up for all characters of many texts at once.

    Every prefix of a known n-gram has a number, 0 is what begins none; a table (or, where that would be large, a sorted list)
    leads from the number and the next character to that of the longer prefix."""

    DENSE = 1 << 22  #: places of a table

    def __init__(self, profiles: dict[str, Counter], n: int):
        self.n, self.langs = n, sorted(profiles)
        grams = sorted(g for g in set().union(*profiles.values()) if len(g) == n)
        codes = np.array([[ord(c) for c in g] for g in grams], np.int64).reshape(len(grams), n)
        self.letters = np.unique(codes)
        placed = np.searchsorted(self.letters, codes) + 1
        self.width, self.steps, at = len(self.letters) + 1, [], np.zeros(len(grams), np.int64)
        for i in range(n):
            keys, back = np.unique(at * self.width + placed[:, i], return_inverse=True)
            size = (int(at.max(initial=0)) + 1) * self.width
            if size <= self.DENSE:
                step = np.zeros(size, np.int32)
                step[keys] = np.arange(1, len(keys) + 1)
            else:
                step = keys
            self.steps.append((size <= self.DENSE, step))
            at = back + 1
        sizes = [sum(profiles[k].values()) + len(profiles[k]) + 1 for k in self.langs]
        #: a row for a language: first of an unknown n-gram, then of the known ones, last of what is none
        self.weights = np.array([[log(1 / m), *[log((profiles[k][g] + 1) / m) for g in grams], 0.0] for k, m in zip(self.langs, sizes)]).reshape(len(self.langs), -1)

    def totals(self, texts: list[str]) -> np.ndarray:
        """Sums of the weights of every text, which has an n-gram at least, for the languages."""
        size = np.array([len(t) for t in texts])
        first = np.cumsum(size) - size
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, np.arange(ALPHABET)), max(len(self.letters) - 1, 0))
        low = np.where(self.letters[place] == np.arange(ALPHABET), place + 1, 0) if len(self.letters) else np.zeros(ALPHABET, int)
        letter = low[np.minimum(code, ALPHABET - 1)]
        high = np.flatnonzero(code >= ALPHABET - 1)
        if len(high) and len(self.letters):
            p = np.minimum(np.searchsorted(self.letters, code[high]), len(self.letters) - 1)
            letter[high] = np.where(self.letters[p] == code[high], p + 1, 0)
        count = len(code) - self.n + 1
        at = np.zeros(count, np.int64)
        for i, (dense, step) in enumerate(self.steps):
            key = at * self.width + letter[i : i + count]
            if dense:
                longer = step[key]
            else:
                p = np.minimum(np.searchsorted(step, key), len(step) - 1)
                longer = np.where(step[p] == key, p + 1, 0)
            # 0 begins everything at first and nothing later on, nor does a letter that no n-gram has
            at = longer if not i else np.where((at > 0) & (letter[i : i + count] > 0), longer, 0)
        for i in range(1, self.n):
            across = (first[1:] - i)[first[1:] >= i]
            at[across[across < count]] = self.weights.shape[1] - 1
        return np.stack([np.add.reduceat(w[at], first) for w in self.weights], 1)


def naive_bayes(profiles: dict[str, Counter], n: int = 3):
    """A detector from profiles: the likeliest language, with its probability among those known."""
    held = Grams(profiles, n)

    @F.pandas_udf(SHAPE)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, certainty = np.full(len(texts), "und", object), np.zeros(len(texts))
            some, chars = [], 0
            given = [(i, f" {t.lower()} ") for i, t in enumerate(texts) if t and profiles]
            for j, (i, t) in enumerate(given):
                some.append((i, t))
                chars += len(t)
                if chars < CHARS and j + 1 < len(given):
                    continue
                # without an n-gram all are alike
                long = [x for x in some if len(x[1]) >= n]
                total = np.zeros((len(some), len(held.langs)))
                if long:
                    total[[len(x[1]) >= n for _, x in enumerate(some)]] = held.totals([x[1] for x in long])
                best = total.shape[1] - 1 - np.argmax(total[:, ::-1], 1)
                rows = [x[0] for x in some]
                lang[rows] = np.array(held.langs, object)[best]
                certainty[rows] = 1 / np.exp(np.minimum(0, total - total.max(1, keepdims=True))).sum(1)
                some, chars = [], 0
            yield pd.DataFrame({"lang": lang, "certainty": certainty})

    return guess


def detect_languages(posts: DataFrame, detector=no_guess, least: float = 0.5) -> DataFrame:
    """Fill missing and 'und' languages of posts that have text by a detector's guess, if it is certain enough."""
    guessed = posts.withColumn("_g", detector(F.col("text")))
    return guessed.withColumn("lang", detected(F.col("lang"), F.col("text"), F.col("_g.lang"), F.col("_g.certainty"), least)).drop("_g")
