import random

import numpy as np
import pyarrow as pa
import pytest

from threadweave.llm import minmax, repeats, topk, wordhash


def thue_morse(n):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def hashes(text):
    data, at = wordhash.strings(pa.array([text]))
    return wordhash.words(data, at).hash.tolist()


@pytest.mark.parametrize("n", [8, 16, 64, 65, 1024, 2048, 4096])
def test_words_that_cancel_out_modulo_a_power_of_two(n):
    one, other = thue_morse(n)
    assert len(set(hashes(f"{one} {other} {one}"))) == 2
    signed = [minmax.shingles(wordhash.words(*wordhash.strings(pa.array([t]))))[0].tolist() for t in (one, other)]
    assert signed[0] != signed[1]
    block = topk.block_of([1], [one])
    (found,) = topk.postings(pa.array([other, one]), block.vocabulary, 1 << 20)
    assert found[2].tolist() == [1]  # only the second text has the word
    passage = [(one if c == "a" else other) for c in thue_morse(64)[0]]
    data, at = wordhash.strings(pa.array([" ".join(passage), " ".join(passage[::-1])]))
    assert len(set(repeats.split(data, at).hash.tolist())) == 2


def test_windows_and_spans_hash_what_they_cover():
    rng = np.random.Generator(np.random.PCG64(1))
    symbols = wordhash.mix(rng.integers(0, 2, 400).astype(np.uint64))
    for k in (1, 2, 3, 15, 16, 31):
        seen = {}
        for i, h in enumerate(wordhash.windowed(symbols, k).tolist()):
            assert seen.setdefault(tuple(symbols[i : i + k].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)
        start = rng.integers(0, 400 - k, 50)
        assert (wordhash.spans(symbols, start, np.full(50, k)) == wordhash.windowed(symbols, k)[start]).all()


def test_distinct_words():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    first, which = wordhash.distinct(data, at[:-1], at[1:])
    assert [words[i] for i in first[which]] == words and len(first) == len(set(words))


def test_letters_of_scripts_without_spaces_are_words():
    data, at = wordhash.strings(pa.array(["日本 abc語x", "กข", "é𠀀x", "한국어 말", ""]))
    found = wordhash.words(data, at)
    text = found.data.tobytes()
    assert [[text[a:b].decode() for a, b in zip(found.start[i:j], found.end[i:j])] for i, j in zip(found.first[:-1], found.first[1:])] == [["日", "本", "abc", "語", "x"], ["ก", "ข"], ["é", "𠀀", "x"], ["한국어", "말"], []]
