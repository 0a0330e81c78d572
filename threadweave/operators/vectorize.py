"""Feature matrices: estimators that fit column statistics and models that normalize."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.operators import features as fx
from threadweave.operators import whole
from threadweave.session import cut

NORMALIZATIONS = (None, "minmax", "mean", "standard")


def column_stats(long: DataFrame) -> DataFrame:
    """``(feature, lo, hi, mean, std)`` without NaN; a zero range or deviation counts as 1 where it divides."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return long.groupBy("feature").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def normalized(value: Column, how: str | None, of: Callable[[str], Column] = F.col) -> Column:
    spread = F.when(of("hi") == of("lo"), 1.0).otherwise(of("hi") - of("lo"))
    if how == "minmax":
        return (value - of("lo")) / spread
    if how == "mean":
        return (value - of("mean")) / spread
    if how == "standard":
        return (value - of("mean")) / F.when(of("std") == 0, 1.0).otherwise(of("std"))
    return value


def to_matrix(long: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``(keys, v array<double>)`` in a fixed order, of features that all are there."""
    places = long.sparkSession.createDataFrame(list(enumerate(order)), "_i int, feature string")
    listed = long.join(F.broadcast(places), "feature").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "value"))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda x: x["value"]).alias("v"))


@dataclass
class Vectorizer:
    """Base of the estimators. ``transform`` gives one row per item: its keys and its vector.

    ``passed``: what ``whole.pass_over`` gives of the posts, if it is there already."""

    normalization: str | None = None
    stats: DataFrame | None = None
    held: DataFrame | None = None
    keys: list[str] = field(default_factory=list)
    passed: DataFrame | None = None

    def _vectors(self, posts: DataFrame) -> DataFrame:
        """``(keys, v, b)``: numbers, and flags, which are not normalized and come last."""
        raise NotImplementedError

    def fit(self, posts: DataFrame) -> Vectorizer:
        if self.normalization not in NORMALIZATIONS:
            raise ValueError(f"unknown normalization {self.normalization!r}")
        if not isinstance(posts, DataFrame):
            raise ValueError("a posts table is needed")
        if self.normalization is not None:
            vectors = self._vectors(posts) if self.held is None else self.held
            by_place = column_stats(vectors.select(F.posexplode("v").alias("feature", "value")))
            self.stats = cut(by_place.agg(F.array_sort(F.collect_list(F.struct("feature", "lo", "hi", "mean", "std"))).alias("_s")))
        return self

    def transform(self, posts: DataFrame, include_ids: bool = True) -> DataFrame:
        if not isinstance(posts, DataFrame):
            raise ValueError("a posts table is needed")
        vectors = self._vectors(posts) if self.held is None else self.held
        numbers = F.col("v")
        if self.normalization is not None:
            if self.stats is None:
                raise ValueError("fit comes before transform")
            vectors = vectors.crossJoin(F.broadcast(self.stats))
            numbers = F.zip_with("v", "_s", lambda v, s: normalized(v, self.normalization, lambda n: s[n]))
        out = vectors.select(*self.keys, F.concat(numbers, "b").alias("features"))
        return out if include_ids else out.select("features")

    def fit_transform(self, posts: DataFrame, include_ids: bool = True) -> DataFrame:
        """Both, with the numbers made, and where they are read twice, written once."""
        if not isinstance(posts, DataFrame):
            raise ValueError("a posts table is needed")
        vectors = self._vectors(posts)
        self.held = vectors if self.normalization is None else cut(vectors)
        try:
            return self.fit(posts).transform(posts, include_ids)
        finally:
            self.held = None

    def _pass(self, posts: DataFrame) -> DataFrame:
        return whole.pass_over(posts) if self.passed is None else self.passed


def _flags(*names: str) -> Column:
    return F.array(*[F.col(n).cast("double") for n in names]) if names else F.array().cast("array<double>")


@dataclass
class PostVectorizer(Vectorizer):
    """Posts by themselves (18 numbers) or, with ``in_convo``, in their conversations (63).

    ``overwrite_flags`` gives the in-conversation vectors of the compared library: the four flags stand in
    the first four numbers, and the flags' own places are 0.
    """

    in_convo: bool = True
    overwrite_flags: bool = False

    def __post_init__(self):
        self.keys = ["convo_id", "uid"]

    def _vectors(self, posts: DataFrame) -> DataFrame:
        if self.in_convo:
            rows = whole.post_rows(whole.pass_over(posts, users=False) if self.passed is None else self.passed)
            return rows.select(*self.keys, "v", F.transform("flags", lambda b: b.cast("double")).alias("b"))
        numbers = F.array(*[F.col(f"`{c}`").cast("double") for c in [*fx.POST_FLOATS, *fx.POST_INTS]])
        return fx.post_features(posts).select(*self.keys, numbers.alias("v"), _flags(*fx.POST_BOOLS).alias("b"))

    def transform(self, posts: DataFrame, include_ids: bool = True) -> DataFrame:
        out = super().transform(posts, include_ids)
        if self.in_convo and self.overwrite_flags:
            n, k = len(fx.CONVO_POST_NUMBERS), len(fx.CONVO_POST_BOOLS)
            moved = F.concat(F.slice("features", n + 1, k), F.slice("features", k + 1, n - k), F.array_repeat(F.lit(0.0), k))
            out = out.withColumn("features", moved)
        return out


@dataclass
class ConversationVectorizer(Vectorizer):
    """Conversations: 1925 numbers."""

    def __post_init__(self):
        self.keys = ["convo_id"]

    def _vectors(self, posts: DataFrame) -> DataFrame:
        return self._pass(posts).select("convo_id", "v", _flags().alias("b"))


@dataclass
class UserVectorizer(Vectorizer):
    """Users in each conversation (321 numbers, not normalized) or, with ``across``, over all (320)."""

    across: bool = False

    def __post_init__(self):
        self.keys = ["author"] if self.across else ["convo_id", "author"]

    def fit(self, posts: DataFrame) -> UserVectorizer:
        super().fit(posts)
        if not self.across:
            self.normalization = None
        return self

    def _vectors(self, posts: DataFrame) -> DataFrame:
        if self.across:
            return to_matrix(fx.user_across_numbers(posts, self.passed), self.keys, [*fx.ACROSS_INTS, *fx.ACROSS_FLOATS]).withColumn("b", _flags())
        return whole.user_rows(self._pass(posts)).select(*self.keys, "v", _flags(*fx.USER_BOOLS).alias("b"))


def assemble(posts: DataFrame, post_vectors: DataFrame, convo_vectors: DataFrame, user_vectors: DataFrame) -> DataFrame:
    """``(convo_id, uid, features)``: a post's vector, then its conversation's and its author's."""
    key = posts.select("convo_id", "uid", "author")
    u = user_vectors.select(F.col("author").alias("_a"), F.col("features").alias("_u"))
    joined = key.join(post_vectors, ["convo_id", "uid"]).join(convo_vectors.select("convo_id", F.col("features").alias("_c")), "convo_id").join(u, F.col("author").eqNullSafe(F.col("_a")))
    return joined.select("convo_id", "uid", F.concat("features", "_c", "_u").alias("features"))
