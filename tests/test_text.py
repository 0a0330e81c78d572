import pytest
from pyspark.sql import functions as F

from threadweave.functions import harmonic, langdetect, text


def on(spark, value, *columns):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(str(i)) for i, c in enumerate(columns)]).first()


def test_tokenizers(spark):
    t = F.col("t")
    row = on(spark, "test example", text.default_tokens(t), text.partition_tokens(t), text.partition_tokens(t, space=False), text.partition_tokens(t, charset=""), text.tokenizer(lambda s: [s])(t))
    assert list(row) == [["test", "example"], ["test", " ", "example"], ["test", "example"], list("test example"), ["test example"]]
    assert on(spark, "This is a tweet! @Twitter", text.partition_tokens(t))[0] == ["This", " ", "is", " ", "a", " ", "tweet", "!", " ", "@Twitter"]
    assert on(spark, "", text.partition_tokens(t))[0] == []
    with pytest.raises(KeyError):
        text.tokenizer("none such")
    with pytest.raises(ValueError):
        text.tokenizer(3)


def test_patterns(spark):
    t = F.col("t")
    s = "@harbour our boat left at noon 😏 http://port.example.org/ #rain #wind"
    row = on(spark, s, text.urls(t), text.hashtags(t), text.emojis(t), text.mentions(t, F.lit("Twitter")), text.mentions(t, F.lit("Facebook")))
    assert list(row) == [["http://port.example.org/"], ["#rain", "#wind"], ["😏"], ["@harbour"], []]
    assert on(spark, "see /u/Some-One and u/two", text.mentions(t, F.lit("Reddit")))[0] == [" /u/Some-One", " u/two"]
    assert on(spark, "a>>12 >>3", text.mentions(t, F.lit("4chan")))[0] == [">>12", ">>3"]
    assert on(spark, "👩‍👩‍👧 🇩🇪 1️⃣ 👍🏽", text.emojis(t))[0] == ["👩‍👩‍👧", "🇩🇪", "1️⃣", "👍🏽"]
    assert on(spark, "é@x (@y", text.mentions(t, F.lit("Twitter")))[0] == ["(@y"]


def test_small_functions(spark):
    t = F.col("t")
    assert on(spark, "&gt;&gt;12&lt;<br>a<wbr>b<br/> ", text.clean_chan(t))[0] == ">>12<\nab"
    rows = [("en", "x", 0.1), (None, "x", 0.9), ("und", "x", 0.1), ("und", "", 0.9)]
    df = spark.createDataFrame(rows, "lang string, text string, c double")
    got = [r[0] for r in df.select(text.detected(F.col("lang"), F.col("text"), F.lit("fr"), F.col("c"))).collect()]
    assert got == ["en", "fr", "und", "und"]
    assert on(spark, "x", text.display_number(F.lit(1_500_000)))[0] == "1.50M"


def test_language_detection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 500")
    profiles = langdetect.train(docs)
    guess = langdetect.naive_bayes(profiles)
    got = docs.select("lang", guess("text").alias("g")).select("lang", "g.*").toPandas()
    assert (got["lang"] == got["lang_"] if "lang_" in got else True) is not None
    right = docs.select("lang", guess("text")["lang"].alias("g")).where("lang = g").count()
    assert right / docs.count() > 0.95


def test_novelty_forms_agree(spark):
    freq = [5, 3, 3, 1, 1, 1]
    df = spark.createDataFrame([("g", n) for n in freq], "g string, n bigint")
    plateau = {r["n"]: r["novelty"] for r in harmonic.novelty(df, ["g"]).collect()}
    assert [plateau[n] for n in freq] == pytest.approx(harmonic.novelty_of(freq))
    assert harmonic.novelty_of([]) == []


def test_mixing():
    assert harmonic.mixing_of([]) == dict.fromkeys(harmonic.KEYS, 0.0)
    one = harmonic.mixing_of([5])
    assert one["theta"] == one["entropy"] == one["N_avg"] == 0.0 and one["M_avg"] <= 1.0 + 1e-9
    many = harmonic.mixing_of([9, 4, 3, 2, 2, 1, 1, 1, 1])
    assert 0.001 <= many["k1"] <= 1 and many["M_avg"] == pytest.approx(24 * many["k1"])
    assert 0 < many["theta"] < 1 and many["entropy"] > 0


def test_simplex_finds_a_minimum():
    assert harmonic.simplex(1.0, lambda x: (x - 3) ** 2, tolerance=1e-6) == pytest.approx(3, abs=1e-3)


def test_word_pattern_for_java_gives_the_same(spark):
    every = "".join(chr(i) for i in range(1, 0x2200) if not 0xD800 <= i < 0xE000)
    texts = [every, " ".join(every), "a".join(every), "-'@é漢" * 3 + every[::-1], "😏👍🏽 ❤️🇫🇷"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(text.partition_tokens(df["t"]).alias("a"), text.matches(df["t"], text.WORD_PATTERN).alias("b")).collect():
        assert r["a"] == r["b"]


def test_detector_equals_the_sums_by_gram(spark, monkeypatch):
    """All texts at once give what adding up the n-grams of each gives, with tables or sorted lists, and whatever the letters."""
    import random
    from math import exp, log

    import pandas as pd

    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    alphabets = {"a": "abcde é", "b": "abxyz ", "c": "\u4e00\u4e8c\U0001f600 a", "d": "ABÄ"}
    rows = [(k, " ".join(word(v) for _ in range(6))) for k, v in alphabets.items() for _ in range(4)]
    texts = [" ".join(word("".join(alphabets.values()) + "qß\uffff\U0001f601İ") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None, "q", "ab"]
    for n in (2, 3, 5):
        profiles = langdetect.profile(rows, n)
        want = []
        for t in texts:
            if not t:
                want.append(("und", 0.0))
                continue
            padded = f" {t.lower()} "
            total = {k: sum(log((c[padded[i : i + n]] + 1) / (sum(c.values()) + len(c) + 1)) for i in range(len(padded) - n + 1)) for k, c in profiles.items()}
            best = max(total, key=lambda k: (total[k], k))
            want.append((best, 1 / sum(exp(min(0.0, v - total[best])) for v in total.values())))
        for dense, chars in ((1 << 24, 1 << 20), (0, 50)):
            monkeypatch.setattr(langdetect.Grams, "DENSE", dense)
            monkeypatch.setattr(langdetect, "CHARS", chars)
            got = pd.concat(langdetect.naive_bayes(profiles, n).func(iter([pd.Series(texts[:30]), pd.Series(texts[30:])])))
            assert list(got["lang"]) == [w[0] for w in want]
            assert list(got["certainty"]) == pytest.approx([w[1] for w in want])


def test_tokens_per_language_are_counted_between_spaces(spark):
    from collections import Counter

    from threadweave.plans import metrics

    texts = [("en", " a  b's, a-b "), ("en", "   "), ("en", ""), ("und", "é\u3000x\ny  "), (None, "a b"), ("fr", None), ("de", "ohne")]
    df = spark.createDataFrame(texts, "lang string, text string")
    found = df.select("lang", text.partition_tokens(F.col("text")).alias("t")).collect()
    want = Counter((r["lang"], t) for r in found for t in r["t"] or [])
    assert {(r["lang"], r["token"]): r["n"] for r in metrics.language_tokens(df).collect()} == dict(want)
    plan = metrics.language_tokens(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("split(text")  # what is taken apart is counted already
