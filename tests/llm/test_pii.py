import random
import re

import pytest
from pyspark.sql import functions as F

from threadweave.llm import pii

KEY = b"a key of these tests"
VALID = {
    "card": ["4111111111111111", "5500 0000 0000 0004", "3400-000000-00009", "4012888888881881"], "ipv4": ["97.51.17.173", "8.8.8.8"], "email": ["leen.90@mail2.example.com", "für.1@x-y.co", "иван.петров@mail.ru", "王小明@qq.com", "иван@почта.рф", "٣٤x@b.org"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199", "555-123-4567", "+44 20 7946 0958"], "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "date": ["2020-02-29", "31.12.1999", "12/25/2001"], "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
}
INVALID = ["4111111111111112", "999.1.1.1", "2020-02-30", "000-12-3456", "GB82WEST12345698765433", "version 4.0.1", "chapter 12", "deadbeef", "1.2.3", "12:30:15"]


def test_permutation():
    for size in (1, 2, 3, 10, 97, 1000):
        image = [pii.permute(i, size, b"k", b"t") for i in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.permute(i, size, b"k", b"t", back=True) for i in image] == list(range(size))
    assert pii.permute(5, 10**30, b"k", b"t") != pii.permute(5, 10**30, b"other", b"t")


@pytest.mark.parametrize("kind", sorted(VALID))
def test_kinds(kind):
    for value in VALID[kind]:
        text = f"see {value}, and {value}!"
        new, found = pii.pseudonymise(text, KEY)
        assert found == {kind: 2} and value not in new
        a, b = re.fullmatch(r"see (.*), and (.*)!", new).groups()
        assert a == b
        assert pii.KINDS[kind][1](a, KEY, True) == value
        assert pii.pseudonymise(new, KEY, back=True)[0] == text
        if kind not in ("ipv4",):
            shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s)) if kind != "secret" else len(s)
            assert shape(a) == shape(value)


def test_clean_text_stays():
    for text in [*INVALID, "no digits at all", "", "a@b", "mail at x dot y"]:
        assert pii.pseudonymise(text, KEY) == (text, {})


def test_neighbours_do_not_hide_a_card():
    new, found = pii.pseudonymise("n 4111111111111111 97.51.17.173 4012888888881881 4111111111111112 end", KEY)
    assert found == {"card": 2, "ipv4": 1} and new.endswith("4111111111111112 end")


def test_long_text_is_worked_through():
    rng = random.Random(0)
    parts = []
    for _ in range(3000):
        parts += ["word"] * rng.randint(0, 20) + [rng.choice(VALID["card"] + VALID["ipv4"])]
    new, found = pii.pseudonymise(" ".join(parts), KEY)
    assert sum(found.values()) == 3000 and not any(v in new for v in VALID["card"][:1])


def test_documents(spark):
    rows = [(1, "mail a.1@b.com"), (2, None), (3, ""), (4, "plain"), (5, "mail a.1@b.com"), (None, "8.8.8.8")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit("old"), "_pii": F.lit(1), "x": F.lit(2)})
    got = pii.pseudonymise_docs(docs, count="n")
    assert got.columns == ["doc_id", "text", "_pii", "x", "n"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] == by[5]["text"] != "mail a.1@b.com" and by[1]["n"] == 1
    assert by[2]["text"] is None and by[2]["n"] == 0 and by[3]["text"] == "" and by[4]["text"] == "plain" and by[None]["n"] == 1
    assert pii.pseudonymise_docs(docs.limit(0)).count() == 0
    assert pii.pseudonymise_docs(docs).columns == docs.columns


def test_no_letter_of_a_name_stays():
    for name in ("иван.петров", "王小明", "ιωάννης", "ñandú", "محمد"):
        kept = set()
        for k in range(20):
            new, _ = pii.pseudonymise(f"{name}@mail.ru", b"key%d" % k)
            local = new.partition("@")[0]
            assert len(local) == len(name) and [c.isalpha() for c in local] == [c.isalpha() for c in name]
            kept.add(sum(a == b for a, b in zip(local, name) if a.isalpha()) / len(name))
        assert min(kept) == 0 and max(kept) < 0.6


def test_many_values_and_long_words_in_one_text():
    text = " ".join(f"a{i}@b{i}.com" for i in range(40_000)) + " " + "x" * 400_000 + "@ " + "y" * 300_000
    new, found = pii.pseudonymise(text, KEY)
    assert found == {"email": 40_000} and len(new) == len(text)


def brute(text):
    """(kind, begin, end) of all values: every place is tried with every pattern, kind after kind, and checked apart from the operator."""
    import datetime
    import ipaddress

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, v):
        d = re.sub(r"\D", "", v)
        if kind == "ipv4":
            try:
                return bool(ipaddress.ip_address(v))
            except ValueError:
                return False
        if kind == "card":
            return 13 <= len(d) <= 19 and luhn(d) and len(set(d)) > 1
        if kind == "iban":
            p = v.replace(" ", "")
            return 15 <= len(p) <= 34 and int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97 == 1
        if kind == "ssn":
            return not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")
        if kind == "date":
            for f in ("%Y{0}%m{0}%d", "%d{0}%m{0}%Y", "%m{0}%d{0}%Y"):
                try:
                    return 1900 <= datetime.datetime.strptime(v, f.format(re.search(r"\D", v)[0])).year <= 2099
                except ValueError:
                    pass
            return False
        if kind == "secret":
            return any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and v in (v.lower(), v.upper())
        return kind != "phone" or 9 <= len(d) <= 15

    taken = [False] * len(text)
    out = []
    for kind in pii.KINDS:
        pattern = re.compile(r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}" if kind == "email" else pii.KINDS[kind][0])
        i = 0
        while i < len(text):
            m = pattern.match(text, i)
            if m is None:
                i += 1
                continue
            if good(kind, m[0]) and not any(taken[m.start() : m.end()]):
                out.append((kind, *m.span()))
                taken[m.start() : m.end()] = [True] * len(m[0])
            i = m.end()
    return sorted(out, key=lambda x: x[1])


def test_whole_table_against_brute_force(spark, sf):
    from threadweave.llm.queries import op6_pii

    spark.conf.set(pii.KEY, KEY.decode())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op6_pii(spark, sf).collect()}
    spark.conf.unset(pii.KEY)
    assert set(got) == set(texts)
    total = 0
    for i, text in texts.items():
        want, last = [], 0
        values = brute(text)
        for kind, s, e in values:
            want += [text[last:s], pii.KINDS[kind][1](text[s:e], KEY, False)]
            last = e
        assert got[i]["text"] == "".join([*want, text[last:]]) and got[i]["n_values"] == len(values)
        total += len(values)
    assert total > 20


def test_the_session_has_one_key(spark):
    assert pii.session_key(spark) == pii.session_key(spark) and len(pii.session_key(spark)) == 64
