import random
from collections import Counter
from math import log

import pytest
from rows import post

from threadweave.operators import graph, entropy, features, stats, vectorize

PAIR = [
    post(3894032234, text="The harbour is closed today", author="harbour", at=(12, 54, 2), seq=0),
    post(91242213123121, [3894032234], "@harbour our boat left at noon 😏 http://port.example.org/ #rain #wind", "apnews", (12, 54, 12), seq=1),
]


def test_widths(make):
    posts = make(*PAIR)
    size = lambda v: {len(r["features"]) for r in v.fit_transform(posts).collect()}
    assert size(vectorize.PostVectorizer(in_convo=False)) == {18}
    assert size(vectorize.PostVectorizer("minmax")) == {63}
    assert size(vectorize.UserVectorizer("standard")) == {321}
    assert size(vectorize.UserVectorizer(across=True)) == {320}
    assert len(features.CONVO_FLOATS) + len(features.CONVO_INTS) == 1925
    with pytest.raises(ValueError):
        vectorize.PostVectorizer("bad").fit(posts)
    with pytest.raises(ValueError):
        vectorize.PostVectorizer().transform([1])
    moved = vectorize.PostVectorizer(overwrite_flags=True).fit_transform(posts).collect()
    assert all(r["features"][-4:] == [0.0] * 4 for r in moved)


def test_conversation_vector_has_no_gaps(make):
    rows = vectorize.ConversationVectorizer().fit_transform(make(*PAIR)).collect()
    assert len(rows) == 1 and len(rows[0]["features"]) == 1925 and all(v is not None for v in rows[0]["features"])


def test_pair_features(make):
    rows = {r["uid"]: r for r in features.post_in_convo_features(make(*PAIR)).collect()}
    r = rows["91242213123121"]
    assert (r["depth"], r["degree"], r["width"], r["response_time"], r["relative_age"], r["out_degree"], r["in_degree"]) == (1, 1, 1, 10.0, 10.0, 1, 0)
    assert (r["url_count"], r["hashtag_count"], r["emoji_count"], r["mention_count"]) == (1, 2, 1, 1)
    for a, b in entropy.ALWAYS_ZERO:
        assert r[f"avg_token_entropy_{a}-{b}"] == 0.0


def brute_entropy(left, right, tokens, is_post):
    joint = left | right
    if not is_post and len(joint) == len(left):
        return 0.0
    lc, jc = Counter(), Counter()
    for i in left:
        lc.update(tokens[i])
    for i in joint:
        jc.update(tokens[i])
    m = sum(jc.values())
    if not lc or len(jc) < 2:
        return 0.0
    return -sum(log(jc[t] / m) for t in lc) / (log(len(jc)) * sum(lc.values()))


def test_entropies_on_random_graphs():
    for seed in range(20):
        rng = random.Random(seed)
        n = rng.randint(1, 9)
        uids = [str(i) for i in range(n)]
        to = [[str(rng.randrange(i)) for _ in range(rng.randint(0, 2))] if i else ["out"] for i in range(n)]
        tokens = [[rng.choice("abcde") for _ in range(rng.randint(0, 6))] for _ in range(n)]
        up = [{int(t) for t in ts if t != "out"} for ts in to]

        def above(i):
            return up[i].union(*(above(p) for p in up[i])) if up[i] else set()

        places = graph.places(uids, to)
        got = entropy.entropies(places, graph.walk(places)[1], tokens)
        for i in range(n):
            down = {j for j in range(n) if i in up[j]}
            sets = {
                "ancestors": above(i), "children": down, "descendants": {j for j in range(n) if i in above(j)}, "full": set(range(n)),
                "parents": up[i], "post": set(), "siblings": {j for j in range(n) if up[j] & up[i]},
            }
            for (a, b), value in zip(entropy.PAIRS, got[i]):
                assert value == pytest.approx(brute_entropy(sets[a] | {i}, sets[b] | {i}, tokens, a == "post"))


def test_five_stats(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", "f", 1.0), ("a", "f", nan), ("a", "f", 3.0), ("b", "f", 2.0)], "k string, feature string, value double")
    got = {(r["k"], r["feature"]): r["value"] for r in stats.five_stats(df, ["k"], "x", guard=True).collect()}
    assert (got["a", "x_min_f"], got["a", "x_max_f"], got["a", "x_mean_f"], got["a", "x_std_f"]) == (1.0, 3.0, 2.0, 1.0)
    assert got["a", "x_median_f"] != got["a", "x_median_f"]
    assert got["b", "x_std_f"] == 1.0 and got["b", "x_median_f"] == 2.0


def test_users_without_author(make):
    posts = make(post(0, text="a b"), post(1, [0], "c", "x"))
    mixed = {r["author"]: r["k1"] for r in features.mixing_features(posts, ("convo_id", "author")).collect()}
    assert mixed[None] == 0.0 and mixed["x"] > 0
    numbers = {(r["author"], r["feature"]): r["value"] for r in features.user_numbers(posts).collect()}
    assert numbers[None, "message_count"] == 1.0 and numbers[None, "types"] == 0.0
    assert len({f for a, f in numbers if a is None}) == 320


def test_one_pass_makes_all_numbers(spark, sf):
    """No row for a number on the way to vectors: one shuffle, one Python step."""
    from threadweave.sources.adapters import conversation_posts

    posts = conversation_posts(spark, sf)
    for v in (vectorize.ConversationVectorizer(), vectorize.UserVectorizer()):
        text = v.fit_transform(posts)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1 and text.count("MapInArrow") == 1 and "percentile" not in text
    text = features.convo_stats(posts)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "percentile" not in text


def test_fits_side_by_side():
    import numpy as np

    from threadweave.functions import harmonic

    rng = random.Random(2)
    vectors = [[], [1], [3], [1, 1], [5, 1], [1] * 50, [3] * 7, [1000, 1]] + [[int(rng.paretovariate(0.8)) for _ in range(rng.randint(1, 80))] for _ in range(200)]
    want = np.array([list(harmonic.mixing_of(v).values()) for v in vectors])
    assert np.allclose(harmonic.mixing_many(vectors), want, rtol=1e-9, atol=1e-12, equal_nan=True)
    assert harmonic.mixing_many([]).shape == (0, 5)


def test_statistics_of_columns(spark, monkeypatch):
    nan = float("nan")
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), [rng.choice([rng.random(), 0.1]), 0.1, rng.choice([1.0, nan])]) for _ in range(97)] + [("c", [2.0, nan, 5.0])]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(3)
    monkeypatch.setattr(stats, "PART", 4)
    monkeypatch.setattr(stats, "WAITING", 10)
    for key in ("k", None):
        keys = [key] if key else []
        want = {tuple(r)[:-1]: r["value"] for r in stats.five_stats(stats.named_values(df, keys, ["x", "y", "z"]), keys, "p", guard=True).collect()}
        got = {tuple(r)[:-1]: r["value"] for r in stats.five_of_columns(df, ["x", "y", "z"], "p", key, guard=True).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12, nan_ok=True) for k in want)
