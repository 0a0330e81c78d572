import random

import numpy as np
import pytest
from helpers import Union, prose
from pyspark.sql import functions as F

from threadweave.llm import minmax


def shingle_set(text, k=3):
    import re

    w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {text}


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else "changed" + str(rng.randrange(10**6)) for w in text.split())


def test_groups_match_brute_force(spark):
    rng = random.Random(1)
    docs, n = [], 0
    for _ in range(40):
        base = prose(rng, rng.randint(30, 200))
        for share in [0.0, 0.0, 0.03, 0.03, 0.5][: rng.randint(1, 5)]:
            docs.append((n, edited(rng, base, share) if share else base))
            n += 1
    got = {(r[0], r[1]) for r in minmax.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    sets = [shingle_set(t) for _, t in docs]
    sure, maybe = Union(), Union()
    for i in range(n):
        for j in range(i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if similarity >= 0.65:
                sure.join(i, j)
            if similarity >= 0.35:
                maybe.join(i, j)
    found = Union()
    for a, b in got:
        found.join(a, b)
        assert maybe.find(a) == maybe.find(b)
    wanted = [(i, sure.find(i)) for i in range(n) if sure.find(i) != i]
    assert sum(found.find(a) == found.find(b) for a, b in wanted) >= 0.98 * len(wanted) > 0
    assert all(b == min(x for x in range(n) if found.find(x) == found.find(b)) for _, b in got)


def test_estimate_is_unbiased():
    rng = np.random.Generator(np.random.PCG64(2))
    for true in (0.3, 0.6, 0.9):
        total = []
        for _ in range(30):
            n = 400
            shared = int(round(true * n))
            pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:shared], pool[n:]])
            pair = minmax.minmax(np.concatenate([a, b]), np.array([0, n]))
            total.append((pair[0] == pair[1]).mean())
        assert abs(np.mean(total) - shared / (2 * n - shared)) < 0.02


def test_a_band_never_holds_both_values_of_a_permutation():
    marks = np.arange(128, dtype=np.uint32)[None]
    for band in minmax.banded(marks)[0].reshape(-1, minmax.ROWS):
        assert len({int(x) % 64 for x in band}) == minmax.ROWS


def test_linked_equals_all_pairs():
    rng = np.random.Generator(np.random.PCG64(3))
    for _ in range(50):
        sig = rng.integers(0, 3, (rng.integers(1, 20), 8)).astype(np.uint16)
        u = Union()
        for i in range(len(sig)):
            u.find(i)
            for j in range(i):
                if (sig[i] == sig[j]).mean() >= 0.6:
                    u.join(i, j)
        label = minmax.linked(sig, 0.6)
        assert [u.find(i) for i in range(len(sig))] == label.tolist()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, ""), (None, "same words here now"), (4, "same words here now"), (5, "same words here now"), (6, "one"), (7, "ONE"), (8, "?!"), (9, "?!"), (10, "日本語" * 5000), (11, "日本語" * 5000), (12, "other"), (5, "same words here now")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"sig": F.lit(1), "id": F.lit(2), "rep": F.lit("x"), "keeper_id": F.lit(0)})
    assert sorted(tuple(r)[:3] for r in minmax.near_groups(docs).collect()) == [(5, 4, 2), (7, 6, 1), (9, 8, 1), (11, 10, 1)]
    kept = minmax.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 8, 10, 12]
    assert minmax.near_groups(docs.limit(0)).count() == minmax.drop_near_duplicates(docs.limit(0)).count() == 0


def test_an_id_with_two_texts(spark):
    rng = random.Random(8)
    x, y = prose(rng, 80), prose(rng, 80)
    rows = [(5, x), (5, y), (1, edited(rng, y, 0.02)), (9, edited(rng, x, 0.02)), (9, prose(rng, 50)), (7, x), (5, x)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))
    assert sorted(tuple(r) for r in minmax.drop_near_duplicates(docs).collect()) == sorted((i, t, 1) for i, t in [rows[0], rows[2], rows[4]])


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    base = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(300))
    docs = spark.createDataFrame([(1, base), (2, base[:150] + "。" + base[151:]), (3, base[::-1])], "doc_id bigint, text string")
    assert [(r["doc_id"], r["keeper_id"]) for r in minmax.near_groups(docs).collect()] == [(2, 1)]


@pytest.mark.parametrize("block", [minmax.BLOCK, 40])
def test_a_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(5)
    base = prose(rng, 60)
    docs = [(i, base if i % 2 else edited(rng, base, 0.02)) for i in range(600)]
    got = minmax.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) >= 590 and len({r["keeper_id"] for r in got}) == 1
