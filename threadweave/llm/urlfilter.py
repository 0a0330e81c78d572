"""URL filter: likelihood ratio of two variable-order Markov models over characters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadweave.session import cut

ORDER = 4  #: longest context, in characters
PAD = "^"
ALPHABET = 256
FALSE_REJECTS = 0.01  #: share of the accepted held-out URLs that the threshold may cost
HELD_OUT = "0123"  #: first digits of a host's MD5 (a quarter of all hosts) whose rows set the threshold and don't train
BIN = 0.01  #: resolution of the threshold
_HOST = r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)"


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), _HOST, 1)


def host_label(url: Column, words: Sequence[str]) -> Column:
    """'rejected' if the host has a word of the block list, else 'accepted'."""
    return F.when(reduce(lambda a, b: a | b, [host(url).contains(w) for w in words], F.lit(False)), "rejected").otherwise("accepted")


def positions(urls: DataFrame) -> DataFrame:
    """``(url, a, r, gram)`` for every character, with the ORDER characters before it."""
    split = urls.select("url", "a", "r", F.split(F.concat(F.lit(PAD * ORDER), F.lower("url")), "").alias("chars"))  # once, as a URL may be long
    return split.select("url", "a", "r", F.explode(F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.array_join(F.slice("chars", i, ORDER + 1), ""))).alias("gram"))


def models(counted: DataFrame) -> DataFrame:
    """Log ratio of the two models for every gram of ORDER+1 characters that occurs, from ``(gram, a, r)``, how often it does in accepted and rejected URLs.

    Both are interpolated by Witten and Bell from the uniform distribution up: with N characters
    and T different ones after a context, p_n = (count + T p_(n-1)) / (N + T). Every order's
    counts come from one aggregation of the longest grams, so the corpus is shuffled once.
    """
    def order(n: int) -> DataFrame:
        short = counted.select(F.substring("gram", ORDER + 1 - n, n + 1).alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        after = Window.partitionBy(F.substring("g", 1, n))
        return short.select(
            "g", "a", "r", F.sum("a").over(after).alias("na"), F.sum("r").over(after).alias("nr"),
            F.count(F.when(F.col("a") > 0, 1)).over(after).alias("ta"), F.count(F.when(F.col("r") > 0, 1)).over(after).alias("tr"),
        )

    def mixed(count: str, total: str, types: str, lower: Column) -> Column:
        return F.when(F.col(total) > 0, (F.col(count) + F.col(types) * lower) / (F.col(total) + F.col(types))).otherwise(lower)

    def step(lower: DataFrame | None, n: int) -> DataFrame:
        now = order(n)
        if lower is None:
            below = F.lit(1.0 / ALPHABET)
            return now.select("g", mixed("a", "na", "ta", below).alias("pa"), mixed("r", "nr", "tr", below).alias("pr"))
        joined = now.join(lower.select(F.col("g").alias("g0"), "pa", "pr"), F.expr(f"substring(g, 2, {n})") == F.col("g0"))
        return joined.select("g", mixed("a", "na", "ta", F.col("pa")).alias("pa"), mixed("r", "nr", "tr", F.col("pr")).alias("pr"))

    top = reduce(step, range(ORDER + 1), None)
    return top.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pr")).alias("d"))


def filter_urls(pages: DataFrame, label: Column, id_col: str = "page_id", url_col: str = "url", false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """``id_col, url, score, threshold, accepted`` for every row.

    ``label`` (a column of ``pages``, a rating joined to it, or ``host_label`` with a list) gives 'accepted', 'rejected' or null per row; rows with
    a null label are scored without training, as are those of the quarter of hosts that is held out. The score is the difference of the log likelihoods
    under the accepted and the rejected model per character, to 6 digits. The threshold is the
    greatest multiple of 0.01 below which at most ``false_rejects`` of the accepted held-out rows
    fall; rows below it are rejected. Counts and threshold come from all rows: equal URLs are counted before they are cut
    into grams, and grams before they are shuffled, so a URL that a third of the rows have costs as much as any other.

    Null and empty URLs get a null score and are rejected. Without accepted held-out rows the
    threshold is null and every row with a URL is accepted. Repeated rows count as often as they
    occur and are scored alike; rows of one id and different URLs keep their own scores. URLs may have any length. An
    empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    held = F.coalesce(F.substring(F.md5(host(F.col("url"))), 1, 1).isin(*HELD_OUT), F.lit(False))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), label.alias("label"))
    count = lambda kind: F.count(F.when((F.col("label") == kind) & ~held, 1))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    urls = cut(rows.where(F.length("url") > 0).groupBy("url").agg(count("accepted").alias("a"), count("rejected").alias("r")).repartition(spread))
    grams = positions(urls)
    ratio = models(cut(grams.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))))
    sums = grams.select("url", "gram").join(ratio, "gram").groupBy("url").agg(F.sum("d").alias("total"), F.count(F.lit(1)).alias("n"))
    scored = rows.join(sums.select("url", F.round(F.col("total") / F.col("n"), 6).alias("score")), "url", "left")
    binned = scored.where((F.col("label") == "accepted") & held & F.col("score").isNotNull()).groupBy(F.floor(F.col("score") / BIN).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    below = binned.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy()).alias("all"))
    threshold = below.where(F.col("below") <= F.col("all") * false_rejects).agg(F.round(F.max("b") * BIN, 2).alias("threshold"))
    return scored.crossJoin(F.broadcast(threshold)).select(
        F.col("key").alias(id_col), "url", "score", "threshold",
        (F.col("score").isNotNull() & (F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")))).alias("accepted"),
    )


def urlfilter_sql(words: Sequence[str]) -> str:
    """DuckDB SQL for :func:`filter_urls` over pages with ``host_label`` of the words."""
    bad = " OR ".join(f"contains(host, '{w}')" for w in words)
    orders = []
    for n in range(ORDER + 1):
        part = f"PARTITION BY substr(g, 1, {n})" if n else ""
        orders.append(
            f"c{n} AS (SELECT substr(gram, {ORDER + 1 - n}, {n + 1}) AS g, sum(a) AS a, sum(r) AS r FROM counted GROUP BY 1),\n"
            f"o{n} AS (SELECT g, a, r, sum(a) OVER w AS na, sum(r) OVER w AS nr, count(*) FILTER (a > 0) OVER w AS ta, count(*) FILTER (r > 0) OVER w AS tr FROM c{n} WINDOW w AS ({part})),\n"
        )
        low = (f"{1.0 / ALPHABET!r}",) * 2 if n == 0 else ("pa", "pr")
        source = "o0" if n == 0 else f"o{n} JOIN (SELECT g AS g0, pa, pr FROM p{n - 1}) ON substr(g, 2, {n}) = g0"
        one = lambda c, t, k, p: f"CASE WHEN {t} > 0 THEN (CAST({c} AS DOUBLE) + {k} * CAST({p} AS DOUBLE)) / ({t} + {k}) ELSE {p} END"
        orders.append(f"p{n} AS (SELECT g, {one('a', 'na', 'ta', low[0])} AS pa, {one('r', 'nr', 'tr', low[1])} AS pr FROM {source}),\n")
    return f"""
WITH h AS (SELECT page_id, url, regexp_extract(lower(url), '{_HOST}', 1) AS host FROM pages),
u AS (SELECT page_id, url, CASE WHEN {bad} THEN 'rejected' ELSE 'accepted' END AS label, substr(md5(host), 1, 1) IN ({", ".join(repr(x) for x in HELD_OUT)}) AS held FROM h),
grams AS (SELECT label, held, substr('{PAD * ORDER}' || lower(url), i, {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM u)),
counted AS (SELECT gram, count(*) FILTER (label = 'accepted' AND NOT held) AS a, count(*) FILTER (label = 'rejected' AND NOT held) AS r FROM grams GROUP BY 1),
{''.join(orders)}
sums AS (SELECT url, round(sum(ln(pa) - ln(pr)) / count(*), 6) AS score FROM (SELECT url, substr('{PAD * ORDER}' || lower(url), i, {ORDER + 1}) AS gram FROM (SELECT url, unnest(range(1, length(url) + 1)) AS i FROM (SELECT DISTINCT url FROM u))) JOIN p{ORDER} ON g = gram GROUP BY 1),
scored AS (SELECT u.*, score FROM u LEFT JOIN sums USING (url)),
bins AS (SELECT CAST(floor(score / {BIN}) AS BIGINT) AS b, count(*) AS n FROM scored WHERE label = 'accepted' AND held AND score IS NOT NULL GROUP BY 1),
t AS (SELECT round(max(b) * {BIN}, 2) AS threshold FROM (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(n) OVER () AS total FROM bins) WHERE below <= total * {FALSE_REJECTS})
SELECT page_id, url, score, threshold, score IS NOT NULL AND (threshold IS NULL OR score >= threshold) AS accepted FROM scored, t"""
