import random

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

from threadweave.llm import multiindex, queries, topk


def brute_topk(docs, queries, k):
    import re
    from collections import Counter
    from math import log

    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    bags = [(d, Counter(words(t))) for d, t in docs if d is not None and words(t)]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    out = {}
    for q, text in queries:
        if q is None:
            continue
        scores = []
        for d, b in bags:
            size = sum(b.values())
            s = sum(c * b[w] * (topk.K1 + 1) / (b[w] + topk.K1 * (1 - topk.B + topk.B * size / mean)) * log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w, c in Counter(words(text)).items() if b[w])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), d))
        if scores:
            out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 5])
def test_topk_matches_brute_force(spark, block):
    rng = random.Random(2)
    docs = [(i, prose(rng, rng.randint(1, 60))) for i in range(120)] + [(900, "kar lor"), (901, "kar lor"), (902, None), (903, ""), (None, "kar"), (904, "Éa 漢字 éa"), (905, "kar " * 20_000)]
    queries = [(i, prose(rng, 8)) for i in range(12)] + [(50, "kar kar lor"), (51, None), (52, ""), (None, "kar"), (53, "absent"), (54, "éa 漢字")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit("x"), "score": F.lit(0)}).repartition(3)
    q = spark.createDataFrame(queries, "item_id int, text string").withColumn("rank", F.lit(1))
    got = {}
    for r in topk.top_k(d, q, k=5, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute_topk(docs, queries, 5)
    assert set(got) == set(want)
    for key in want:
        assert [x[0] for x in got[key]] == [x[0] for x in want[key]]
        assert [x[1] for x in got[key]] == pytest.approx([x[1] for x in want[key]], abs=2e-6)


@pytest.mark.parametrize("text", [topk.TEXT, 300])
def test_topk_of_documents_as_queries(spark, monkeypatch, text):
    monkeypatch.setattr(topk, "TEXT", text)
    rng = random.Random(4)
    docs = [(i, prose(rng, rng.randint(1, 60))) for i in range(260)]
    docs += [(i + 300, t) for i, t in docs[:60]] + [(650, "kar kar lor 漢字"), (700, None), (750, ""), (None, "kar"), (800, "unheard"), (-50, docs[7][1])]
    queries = [(i, prose(rng, 8)) for i in range(5)] + [(50, "kar kar lor"), (51, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id bigint, text string")
    got = {}
    for r in topk.top_k_of_both(d, q, k=5).orderBy("source", "query_id", "rank").collect():
        got.setdefault((r["source"], r["query_id"]), []).append((r["doc_id"], r["score"]))
    want = {("benchmark", i): x for i, x in brute_topk(docs, queries, 5).items()}
    asked = [(i, t) for i, t in docs if i is not None and i % 50 == 0 and t]
    for i, x in brute_topk(docs, asked, len(docs)).items():
        if others := [y for y in x if y[0] != i][:5]:
            want["documents", i] = others
    assert set(got) == set(want)
    assert ("documents", 0) in got and ("documents", 800) not in got
    for key in want:
        assert [x[0] for x in got[key]] == [x[0] for x in want[key]]
        assert [x[1] for x in got[key]] == pytest.approx([x[1] for x in want[key]], abs=2e-6)


@pytest.mark.parametrize("settings", [{}, {"TILE": 3, "CELLS": 400}, {"SHARED": 2.0}, {"SHARED": 0.0}, {"SHARED": 0.05, "DENSE": 900}])
def test_scores_by_products_and_one_by_one(monkeypatch, settings):
    import pyarrow as pa

    for name, value in settings.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(1, 50))) for i in range(150)]
    docs += [(i + 200, t) for i, t in docs[:90]] + [(500, "kar kar lor"), (600, "unheard")]
    asked = [(i, t) for i, t in docs if i % 50 == 0] + [(3, "kar kar lor kar"), (4, "absent")]
    own = np.array([i % 50 == 0 for i, _ in asked])
    block = topk.block_of([i for i, _ in asked], [t for _, t in asked], own)
    df, sizes = np.zeros(len(block.vocabulary)), []
    for _, size, _, _, term, first in topk.postings(pa.array([t for _, t in docs]), block.vocabulary, topk.DENSE):
        df[term] += np.diff(first)
        sizes += size.tolist()
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    batches = [(pa.array([i for i, _ in docs[a : a + 100]]), pa.array([t for _, t in docs[a : a + 100]])) for a in range(0, len(docs), 100)]
    scores, ids = topk.best_of(iter(batches), block, idf, np.mean(sizes), 7)
    want = {i: [x for x in found if x[0] != i or i % 50][:7] for i, found in brute_topk(docs, asked, len(docs)).items()}
    for (q, _), s, i in zip(asked, scores, ids):
        expected = want.get(q, [])
        assert i[s > 0].tolist() == [d for d, _ in expected]
        assert s[s > 0].tolist() == pytest.approx([x for _, x in expected], abs=2e-6)


def test_op4_asks_with_every_fiftieth_document(spark, sf):
    got = queries.op4_topk(spark, sf)
    docs, passages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    wanted = {("documents", r[0]) for r in docs.where("doc_id % 50 = 0").select("doc_id").collect()} | {("benchmark", r[0]) for r in passages.select("item_id").collect()}
    assert {(r[0], r[1]) for r in got.select("source", "query_id").distinct().collect()} == wanted
    assert got.where("source = 'documents' and query_id = doc_id").count() == 0


def test_topk_edges(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert topk.top_k(d.limit(0), q).count() == topk.top_k(d, q.limit(0)).count() == 0
    with pytest.raises(TypeError):
        topk.top_k(d.withColumn("doc_id", F.lit("x")), q)


def recall(got, x, ids, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    top = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.mean([len({ids[j] for j in top[i]} & got.get(ids[i], set())) / min(k, len(ids) - 1) for i in range(len(ids))])


def found(df, key="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], set()).add(r["neighbour_id"])
    return out


def test_neighbours_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows]), [r["vec_id"] for r in rows]
    got = multiindex.nearest(table, every=1)
    assert recall(found(got), x, ids, multiindex.K) >= 0.9
    one = got.where("rank = 1").limit(5).collect()
    for r in one:
        a, b = x[ids.index(r["vec_id"])], x[ids.index(r["neighbour_id"])]
        assert r["distance"] == pytest.approx(((a - b) ** 2).sum(), abs=1e-5)


def test_neighbours_of_clusters_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "ROWS", 150)
    rng = np.random.Generator(np.random.PCG64(1))
    centers = rng.normal(size=(30, 10)) * 5
    x = (centers[rng.integers(0, 30, 700)] + rng.normal(size=(700, 10))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = found(multiindex.nearest(df, k=5, every=1))
    assert recall(got, x.astype(float), list(range(700)), 5) >= 0.9


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [nan, 0.0]), (None, [0.0, 0.0]), (7, [None, 1.0]), (2, [0.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "c1": F.lit(3), "rank": F.lit(4)})
    got = sorted(tuple(r) for r in multiindex.nearest(df, every=1).collect())
    assert got == [(1, 1, 2, 0.01), (1, 2, 3, 1.0), (2, 1, 3, 0.0), (2, 2, 1, 0.01), (3, 1, 2, 0.0), (3, 2, 1, 1.0)]
    assert multiindex.nearest(df.limit(0)).count() == 0
    assert multiindex.nearest(df.where("vec_id = 1")).count() == 0


def exact(rows, k, every=1):
    """The k nearest ids of every query id: least distance of any two of their vectors, then least id."""
    out = set()
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for i, v in rows:
            if i != q:
                d = min(round(sum((a - b) ** 2 for a, b in zip(v, w)), 6) for j, w in rows if j == q)
                best[i] = min(d, best.get(i, d))
        out |= {(q, r + 1, n, d) for r, (d, n) in enumerate(sorted((d, n) for n, d in best.items())[:k])}
    return out


def test_ties_and_ids_with_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "ROWS", 20)
    monkeypatch.setattr(multiindex, "FOUND", 1.0)
    rng = random.Random(3)
    rows = [(i, [float(rng.random() < 0.5) for _ in range(6)]) for i in range(150)]
    rows += [(200, [0.0, 0.0, 0.0, 0.1 * j, 0.0, 1.0]) for j in range(12)] + [(300, [9.0] * 6), (301, [9.0] * 6), (302, [9.0] * 6)]
    rows += [(400 + i, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0]) for i in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>").repartition(3)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    # every query is a probe, and the budget holds all its neighbours, so the result is exact
    assert {tuple(r) for r in multiindex.nearest(df, every=1).collect()} == exact(rows, 10)
    assert {tuple(r) for r in multiindex.nearest(df, every=50).collect()} == exact(rows, 10, 50)


def test_blocks_hold_a_bounded_number():
    rng = np.random.Generator(np.random.PCG64(2))
    for _ in range(50):
        counts = rng.integers(0, 30, (6, 7)) * (rng.random((6, 7)) < 0.7)
        block, parts = multiindex.blocks(counts, 10)
        assert (np.diff(block) >= 0).all() and (np.diff(block) <= parts[:-1]).all()
        held = np.zeros((block + parts).max())
        for c, b, p in zip(counts.ravel(), block, parts):
            assert p == 1 or c > 10
            held[b : b + p] += c / p
        assert held.max() <= 10


def test_traverse_is_in_order():
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(20):
        d1, d2 = rng.random(7), rng.random(9)
        counts = rng.integers(0, 4, (7, 9))
        cells = multiindex.traverse(d1, d2, counts, 10**9)
        assert len(cells) == len(set(cells)) == (counts > 0).sum()
        sums = [d1[a] + d2[b] for a, b in cells]
        assert sums == sorted(sums)
        part = multiindex.traverse(d1, d2, counts, 20)
        assert part == cells[: len(part)] and (counts[tuple(zip(*part))].sum() >= min(20, counts.sum()))
