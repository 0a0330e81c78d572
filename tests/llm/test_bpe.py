import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadweave.llm import bpe, queries, wordhash


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.compiled(bpe.TOKENIZER))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER)
    t.encode_special_tokens = True
    return t


def encode(encoder, texts):
    import pyarrow as pa

    data, at = wordhash.strings(pa.array(texts, pa.string()))
    ids, ends = encoder.encode(data, at)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abe 'stlvrdm\n\t.,!?1é漢 "), st.characters(exclude_categories=("Cs",))), max_size=40), min_size=1, max_size=5))
def test_same_as_the_library(encoder, library, texts):
    assert encode(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words(encoder, library):
    texts = ["a" * 5000, "ab" * 3000, "<|endoftext|>", "", "x" * 3 + "　" * 40]
    assert encode(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def naive(word, rank):
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if best is None:
            return parts
        a, b = parts[best[1]], parts[best[1] + 1]
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_of_random_merges():
    for seed in range(80):
        r = random.Random(seed)
        labels = [bytes([c]) for c in b"abc"[: r.randint(1, 3)]]
        letters, merges, rank = list(labels), [], {}
        for _ in range(r.randint(1, 14)):
            u, v = r.choice(labels), r.choice(labels)
            if u + v not in labels and len(u + v) < 9:
                rank[u, v] = len(merges)
                labels.append(u + v)
                merges.append((u, v, u + v))
        ids = {x: i for i, x in enumerate(labels)}
        made = bpe.MergeAutomaton(labels, [tuple(ids[x] for x in m) for m in merges])
        words = [b"".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(60)]
        for wide in (0, 3, 100):
            table = made.table(wide)
            for a in made.made:
                for b in made.made:
                    assert bool(table.arcs(np.array([a]), np.array([b]))[0]) == made._arc(a, b)
            at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            tokens, ends = table.encode_words(np.frombuffer(b"".join(words), np.uint8), at[:-1], at[1:])
            for w, x, y in zip(words, ends[:-1], ends[1:]):
                assert [labels[i] for i in tokens[x:y]] == [labels[i] for i in table.encode(w)] == naive(w, rank)
                assert table.decode(tokens[x:y]) == w


def test_words_whose_polynomials_are_equal(encoder, library):
    for n in (1024, 2048, 4096):
        thue = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        texts = [thue, thue.translate(str.maketrans("ab", "ba"))]
        assert encode(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_equal_hashes_are_told_apart(encoder, library, monkeypatch):
    monkeypatch.setattr(wordhash, "hashed", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["some words and some longer wordings", "some other"]
    assert encode(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark, sf):
    rows = [(1, "Hello's  world\n"), (2, None), (3, ""), (3, ""), (4, "é" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"tokens": F.lit("old"), "c0": F.lit(5)})
    coded = bpe.encode_documents(docs)
    assert coded.columns == ["doc_id", "text", "c0", "tokens"]
    got = bpe.decode_documents(coded).collect()
    assert all(r["decoded"] == r["text"] for r in got)
    assert {r["doc_id"]: r["tokens"] for r in got if r["doc_id"] in (2, 3)} == {2: None, 3: []}
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    named = docs.select(F.lit(1).alias("c1"), F.col("text").alias("c0"), F.lit(2).alias("made"))
    again = bpe.encode_documents(named, "c0", "c2")
    assert again.columns == ["c1", "c0", "made", "c2"] and {len(r["c2"] or []) for r in again.collect()} == {len(r["tokens"] or []) for r in got}
    with pytest.raises(Exception, match="without a label"):
        bpe.decode_documents(spark.createDataFrame([([999_999],)], "tokens array<int>")).collect()
    corpus = spark.read.parquet(f"{sf}/documents.parquet")
    whole = bpe.decode_documents(bpe.encode_documents(corpus))
    assert whole.where("decoded = text").count() == corpus.count()


def test_decoding_in_the_same_step(spark, sf):
    rows = [(1, "Hello's  world\n"), (2, None), (3, ""), (4, "漢字 é" * 30_000), (5, "\ufffd \x00")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"decoded": F.lit("old"), "again": F.lit(5)})
    got = bpe.encode_documents(docs, decoded="decoded")
    assert got.columns == ["doc_id", "text", "again", "tokens", "decoded"]
    apart = bpe.decode_documents(bpe.encode_documents(docs.drop("decoded")))
    assert sorted(got.collect()) == sorted(apart.collect())
    assert {r["doc_id"]: r["decoded"] for r in got.collect()} == dict(rows)
    query = queries.op2_bpe(spark, sf)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan  # a worker and a table for every task, and not two
    assert bpe.shipped_table(spark.sparkContext, bpe.TOKENIZER) is bpe.shipped_table(spark.sparkContext, bpe.TOKENIZER)
    corpus = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = bpe.decode_documents(bpe.encode_documents(corpus)).select("doc_id", F.size("tokens"), "tokens", F.col("decoded") == F.col("text"))
    assert sorted(query.collect()) == sorted(whole.collect())
