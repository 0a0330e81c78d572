import random
from collections import defaultdict

import numpy as np
import pytest
from helpers import prose
from pyspark.sql import functions as F

import corpus_pipeline
from threadweave.llm import minmax, packing, pii, quality, repeats

# -- quality


def graded(rng, n):
    rows = []
    for i in range(n):
        g = rng.choice([0, 1, 2, 2, 2])
        words = prose(rng, rng.randint(20, 120)).split()
        if g == 0:
            words = [w + "$$$" for w in words] if i % 2 else words[:2] * 60
        if g == 1:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]))
        rows.append((i, " ".join(words), g))
    return rows


def test_held_out_accuracy(spark):
    rows = graded(random.Random(3), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(r[0], r[2]) for r in rows[:1000]], "doc_id bigint, grade int")
    kept = {r["doc_id"] for r in quality.select_documents(docs, ratings).collect()}
    held = rows[1000:]
    share = lambda g: sum(r[0] in kept for r in held if r[2] == g) / sum(r[2] == g for r in held)
    assert share(2) >= 0.97 and share(1) <= 0.1 and share(0) <= 0.05
    scored = {r["doc_id"]: r["expected_grade"] for r in quality.score_documents(docs, quality.train(docs, ratings)).collect()}
    mean = [np.mean([scored[r[0]] for r in held if r[2] == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_fit_is_ordinal():
    rng = np.random.Generator(np.random.PCG64(0))
    grades = rng.integers(0, 3, 600)
    ids = np.concatenate([[10 + g, 99] for g in grades]).astype(np.int32)
    model = quality.fit(ids, np.arange(0, 1201, 2), grades, 3)
    assert model.weights[10] < model.weights[11] < model.weights[12] and model.cuts[0] < model.cuts[1]
    tails = model.tails(np.array([-3.0, 0.0, 3.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails[:, 1]) > 0).all()


def test_fit_reaches_the_maximum_likelihood():
    """Against Newton's method with numerical derivatives on the likelihood as it is written in textbooks."""
    rng = np.random.Generator(np.random.PCG64(4))
    true, cuts = np.array([1.2, -0.8, 0.5, 0.0]), np.array([-0.7, 0.9])
    x = (rng.random((3000, 4)) < 0.4).astype(float)
    p = 1 / (1 + np.exp(x @ true[:, None] - cuts[None, :]))
    grades = (rng.random(3000)[:, None] > p).sum(axis=1)

    def loss(theta):
        below = np.column_stack([np.zeros(3000), 1 / (1 + np.exp(x @ theta[:4, None] - theta[None, 4:])), np.ones(3000)])
        return -np.log(below[np.arange(3000), grades + 1] - below[np.arange(3000), grades]).mean()

    theta, step = np.array([0.0, 0, 0, 0, -0.5, 0.5]), 1e-4
    unit = np.eye(6) * step
    for _ in range(12):
        gradient = np.array([(loss(theta + u) - loss(theta - u)) / (2 * step) for u in unit])
        hessian = np.array([[(loss(theta + u + v) - loss(theta + u - v) - loss(theta - u + v) + loss(theta - u - v)) / (4 * step**2) for v in unit] for u in unit])
        theta = theta - np.linalg.solve(hessian, gradient)
    rows = [np.flatnonzero(r) for r in x]
    model = quality.fit(np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(r) for r in rows])]), grades, 3, l1=0.0)
    found = np.concatenate([model.weights[:4], model.cuts])
    assert np.abs(found - theta).max() < 0.1 and loss(found) - loss(theta) < 1e-3


def test_labelled_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 30, f"word{i} text") for i in range(900)], "doc_id bigint, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id bigint, grade int")
    got = []
    monkeypatch.setattr(quality, "fit", lambda ids, ends, grades, n, **_: got.append(len(grades)) or quality.OrdinalModel(np.zeros(1 << quality.BITS, np.float32), np.zeros(2)))
    quality.train(docs, ratings)
    quality.train(docs, ratings, max_labelled=10)
    assert got == [30, 10]


def test_rare_words_of_the_middle_grade_get_weights():
    rng = np.random.Generator(np.random.PCG64(1))
    grades = np.repeat([0, 1, 2], [150, 100, 750])
    # words 500 to 515 occur in six middle rows each, 10 to 39 in all
    rows = [np.concatenate([rng.choice(np.arange(10, 40), 8, replace=False), [500 + i // 6] if g == 1 and i < 96 else [], [900] if g == 0 else []]) for g in range(3) for i in range((grades == g).sum())]
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = quality.fit(np.concatenate(rows).astype(np.int32), ends, grades, 3)
    assert (model.weights[500:516] < 0).all() and (model.weights[40:500] == 0).all()
    usual = model.weights[10:40].mean() * 8
    assert (model.tails(usual + model.weights[500:516])[:, 1] < quality.TAIL).all() and model.tails(np.array([usual]))[0, 1] > quality.TAIL


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "fine words"), (3, "fine words"), (None, "x"), (4, "long " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"p_best": F.lit("old"), "e": F.lit(1), "_id": F.lit(2)})
    ratings = spark.createDataFrame([(3, 2), (3, None), (None, 1), (9, 0)], "doc_id bigint, grade int")
    got = quality.score_documents(docs, quality.train(docs, ratings))
    assert got.columns == ["doc_id", "text", "e", "_id", "expected_grade", "p_best"] and got.count() == 6
    assert {r["p_best"] for r in got.where("coalesce(text, '') = ''").collect()} == {0.0}
    none = quality.train(docs, ratings.limit(0))
    assert not none.weights.any()
    assert quality.select_documents(docs.limit(0), ratings).count() == 0


def test_features_of_a_row_do_not_depend_on_its_neighbours():
    import pyarrow as pa

    from threadweave.llm import wordhash

    texts = ["Some words, some Words!", "", "aaa aaa $$$ b", "É漢"]
    data, at = wordhash.strings(pa.array(texts))
    ids, ends = quality.features(data, at)
    for i, t in enumerate(texts):
        d, a = wordhash.strings(pa.array([t]))
        assert quality.features(d, a)[0].tolist() == ids[ends[i] : ends[i + 1]].tolist()


# -- repeats


def brute_repeats(texts, least):
    toks = [repeats.tokens(t) for t in texts]
    where = defaultdict(list)
    for d, t in enumerate(toks):
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                where[tuple(t[i:j])].append((d, i, j))
    out = {}
    for words, places in where.items():
        left = {toks[d][i - 1] if i else ("begin", d) for d, i, _ in places}
        right = {toks[d][j] if j < len(toks[d]) else ("end", d) for d, _, j in places}
        if len(places) > 1 and len(left) > 1 and len(right) > 1:
            out[words] = {(d, int(repeats.spans(texts[d])[i][0]), int(repeats.spans(texts[d])[j - 1][1])) for d, i, j in places}
    return out


def occurrences(rows, texts):
    """All occurrences of every repeat, from the tree."""
    below, own, words = defaultdict(set), defaultdict(set), {}
    for r in rows:
        if r["parent_id"] is not None:
            below[r["parent_id"]].add(r["repeat_id"])
        own[r["repeat_id"]].add((r["doc_id"], r["start"]))
        words[r["repeat_id"]] = tuple(repeats.tokens(texts[r["doc_id"]][r["start"] : r["end"]]))
    full = {}

    def of(x):
        if x not in full:
            full[x] = set(own[x]).union(*(of(y) for y in below[x]))
        return full[x]

    return {words[x]: of(x) for x in own}


@pytest.mark.parametrize("wide", [repeats.WIDE, 0])
@pytest.mark.parametrize("seed", range(4))
def test_repeats_match_brute_force(spark, seed, wide, monkeypatch):
    monkeypatch.setattr(repeats, "WIDE", wide)
    rng = random.Random(seed)
    texts = []
    base = [str(rng.randrange(8)) for _ in range(80)]
    base[20:40] = ["7"] * 20
    for _ in range(25):
        t = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(60)
            t += base[a : a + rng.randint(3, 40)] if rng.random() < 0.6 else [str(rng.randrange(8)) for _ in range(rng.randint(1, 20))]
        texts.append((" " * rng.randint(1, 2)).join(t) + rng.choice(["", "\n"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = repeats.find_repeats(docs, min_words=8, gram=4).collect()
    want = brute_repeats(texts, 8)
    got = occurrences(rows, texts)
    assert got == {w: {(d, s) for d, s, _ in places} for w, places in want.items()}
    size = {r["repeat_id"]: r["n_occurrences"] for r in rows}
    assert sorted(size.values()) == sorted(len(p) for p in want.values())
    full = defaultdict(set)
    for r in repeats.all_occurrences(spark.createDataFrame(rows)).collect():
        full[r["repeat_id"]].add((r["doc_id"], r["start"]))
    assert {x: len(p) for x, p in full.items()} == size


def test_a_run_within_a_repeat(spark):
    rng = random.Random(4)
    passage = " ".join([prose(rng, 10), "same " * 40, prose(rng, 10)]).split()
    texts = [" ".join([prose(rng, 20), *passage, prose(rng, 20)]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = occurrences(repeats.find_repeats(docs).collect(), texts)
    assert got == {w: {(d, s) for d, s, _ in p} for w, p in brute_repeats(texts, 45).items()}
    assert tuple(passage) in got


def test_ordered_by_doubling():
    rng = random.Random(8)
    for _ in range(200):
        parts = [[rng.choice("ab") for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 4))]
        items = [(p, a) for p, x in enumerate(parts) for a in range(len(x)) if rng.random() < 0.7]
        if not items:
            continue
        order, lcp = repeats.doubled(parts, items)
        suffix = [parts[p][a:] for p, a in items]
        shared = lambda x, y: next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert sorted(order) == list(range(len(items)))
        assert lcp.tolist()[1:] == [shared(suffix[i], suffix[j]) for i, j in zip(order, order[1:])]
        for i in range(len(order)):  # common prefixes of all pairs are the least between them
            for j in range(i + 1, len(order)):
                assert min(lcp[i + 1 : j + 1]) == shared(suffix[order[i]], suffix[order[j]])


def test_one_word_over_and_over(spark):
    texts = ["w " * 30_000, "w " * 20_000 + "end", "x y z " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = repeats.find_repeats(docs).collect()
    most = max(r["n_words"] for r in rows if r["doc_id"] == 0)
    assert most == 29_999 and len(rows) < 70_000
    kept = {r["doc_id"]: r["text"].split() for r in repeats.drop_repeats(docs).collect()}
    assert kept == {0: ["w"] * 45, 1: ["end"], 2: (["x", "y", "z"] * 16)[:47]}


def test_cut_keeps_columns_and_drops_blank_rows(spark):
    p = prose(random.Random(1), 60)
    docs = spark.createDataFrame([(1, p + "\n", 5), (2, p + "\n\t", 6)], "doc_id bigint, text string, _key int")
    assert [tuple(r) for r in repeats.drop_repeats(docs).collect()] == [(1, p + "\n", 5)]


def test_cut_keeps_the_first(spark):
    rng = random.Random(9)
    passage, other = prose(rng, 60), prose(rng, 70)
    texts = {1: f"a {passage} b", 2: f"c {passage} d", 3: passage, 4: f"{other} x {passage}", 5: f"{prose(rng, 50)} {other}", 6: prose(rng, 80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumns({"n_chars": F.lit(1), "key": F.lit(2), "start": F.lit(3)})
    kept = repeats.drop_repeats(docs)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert got[1] == texts[1] and got[2].split() == ["c", "d"] and 3 not in got
    assert got[4].split() == f"{other} x".split() and other not in got[5] and got[5].split() == texts[5].split()[:50] and got[6] == texts[6]


def test_repeats_odd_rows(spark):
    rng = random.Random(2)
    p = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, "word " * 5000), (4, "word " * 4000), (None, p), (5, p), (5, p), (6, p), (6, p + " and more"), (7, " ".join([p] * 3)), (8, "é漢 " * 3 + p)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit("x"), "gram": F.lit(0)})
    got = repeats.find_repeats(docs).collect()
    texts = {(r[0], r[1]) for r in rows}
    assert {r["doc_id"] for r in got} == {3, 4, 5, 6, 7, 8}
    assert all(any(d == r["doc_id"] and p.split()[-1] in t[r["start"] : r["end"]] for d, t in texts if t) for r in got if r["doc_id"] > 4)
    assert repeats.find_repeats(docs.limit(0)).count() == 0
    kept = repeats.drop_repeats(docs).collect()
    assert sum((r["text"] or "").count(p) for r in kept if r["doc_id"] is not None) in (1, 2)  # rows that repeat an id and text are cut alike
    assert {r["doc_id"] for r in kept} >= {None, 1, 2, 3, 5}
    assert [r["text"].count("word") for r in kept if r["doc_id"] == 3] == [45] and 4 not in {r["doc_id"] for r in kept}
    with pytest.raises(ValueError):
        repeats.find_repeats(docs, min_words=5, gram=5)


# -- pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """A small corpus with planted cases, and what every stage makes of it."""
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("corpus")
    passage = prose(rng, 70)
    texts, grades = [], []
    for i in range(400):
        t = prose(rng, rng.randint(60, 150))
        bad = i % 5 == 0
        if bad:
            t = " ".join(w + "%%%" for w in t.split())
        elif i % 7 == 0:
            t = f"{t} {passage} {prose(rng, 10)}"
        elif i % 11 == 0:
            t += " mail me.1@host.com or 4111111111111111"
        texts.append(t)
        grades.append((i, int(not bad), 0))
    texts += [texts[1], texts[2] + " tail", "x " + texts[3]]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(grades[:200], "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    made = [spark.read.parquet(str(root / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], str(root)).write.parquet(str(root / name))
        made.append(spark.read.parquet(str(root / name)))
    return str(root), passage, texts, [m.collect() for m in made], [m.columns for m in made]


def test_stages(spark, stages):
    root, passage, texts, made, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "personal_data", "packing"]
    assert columns[0] == columns[1] == columns[2] == columns[3] == columns[4]
    ids = [{r["doc_id"] for r in m} for m in made]
    bad = {i for i in range(400) if i % 5 == 0}
    assert not ids[1] & bad and len(ids[1]) >= 0.97 * (403 - 80)
    assert not ids[2] & {400, 401, 402} and ids[2] == ids[1] - {400, 401, 402}
    assert sum(passage in r["text"] for r in made[3]) == 1 and ids[3] == ids[2]
    assert all(r["n_chars"] == len(r["text"]) for r in made[3] + made[4])
    assert not any("me.1@host.com" in r["text"] or "4111111111111111" in r["text"] for r in made[4])
    by = {r["doc_id"]: r["text"] for r in made[4]}
    assert all(r["text"] == by[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in made[5])
    assert sum(r["length"] for r in made[5]) == sum(map(len, by.values()))


def test_run_equals_the_stages(spark, stages):
    root, _, _, made, _ = stages
    key = lambda r: (r["doc_id"], r["piece"])
    assert sorted(corpus_pipeline.run(spark, root).collect(), key=key) == sorted(made[-1], key=key)


def test_stages_on_odd_documents(spark, stages):
    root = stages[0]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", None, None), (3, "a", "en", "s", 1), (3, "a", "en", "s", 1), (3, "b", "en", "s", 1)]
    odd = spark.createDataFrame(rows, shape)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), root).count() == 0, name
    some = dict(corpus_pipeline.STAGES)
    assert {(r["doc_id"], r["text"]) for r in some["quality"](spark, odd, root).collect()} <= {(3, "a"), (3, "b")}  # null and empty texts have no quality
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(some["near_duplicates"](spark, odd, root).collect(), key=key) == sorted(set(odd.collect()), key=key)
    for name in ("repeats", "personal_data"):
        got = some[name](spark, odd, root).select("doc_id", "text").collect()
        assert sorted(got, key=key) == sorted(odd.select("doc_id", "text").collect(), key=key), name
    assert sorted((r["doc_id"], r["text"], r["length"]) for r in some["packing"](spark, odd, root).collect()) == [(3, "a", 1), (3, "a", 1), (3, "b", 1)]


def test_stages_with_clashing_columns_and_long_texts(spark, stages):
    root, rng = stages[0], random.Random(6)
    passage = prose(rng, 80)
    texts = [f"{prose(rng, 30_000)} {passage}", f"{passage} {prose(rng, 50)}", prose(rng, 60)]
    columns = {c: F.lit(7) for c in ("key", "cut", "_key", "_text", "start", "sig", "rep", "piece", "e", "p_best", "x", "shard", "band")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns(columns)
    some = dict(corpus_pipeline.STAGES)
    for name in ("near_duplicates", "repeats", "personal_data"):
        got = some[name](spark, docs, root)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert len(rows) == 3 and all(r[c] == 7 for r in rows for c in columns), name
        if name == "repeats":
            kept = {r["doc_id"]: r["text"] for r in rows}
            assert kept[0] == texts[0] and passage not in kept[1] and kept[1].split() == texts[1].split()[80:]
    pieces = sorted(some["packing"](spark, docs, root).collect(), key=lambda r: (r["doc_id"], r["piece"]))
    assert all(r["length"] <= packing.CAPACITY for r in pieces)
    assert ["".join(r["text"] for r in pieces if r["doc_id"] == i) for i in range(3)] == texts


def test_run_works_every_stage_once(spark, stages, monkeypatch):
    """What ``run`` returns reads cut lineage: no function of an earlier stage is in its plan."""
    made = corpus_pipeline.run(spark, stages[0])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "Relation" not in plan
