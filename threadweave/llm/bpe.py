"""Byte-pair encoding by an automaton that is compiled from the merges, and decoding."""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadweave.llm import wordhash as wh

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
NEVER = 1 << 60
WIDE = 3_000  #: arcs taken by the largest merges stand in a matrix of classes, the others as pairs
FILTER = 26  #: bits of a hash that tell most arcs apart from those taken as pairs
SHORT = 64  #: bytes; words up to here are walked side by side, longer ones one by one
KNOWN = 200_000  #: words that a worker remembers; beyond, it starts anew


def byte_letters() -> dict[str, int]:
    """The printable letter that vocabulary files write for every byte, back to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Table:
    """The compiled automaton. States are tokens (all arcs of a token lead to one state) and the start, which has every arc.

    State s has an arc t unless ``taken[row[s], column[t]]`` or t is among ``pairs[first[s]:first[s + 1]]``. An arc's label
    is ``text[begin[t]:begin[t + 1]]``; ``trie`` holds the labels letter by letter: sorted (node, byte), what node they lead to and the token that ends there or -1.
    """

    row: np.ndarray
    column: np.ndarray
    taken: np.ndarray
    first: np.ndarray
    pairs: np.ndarray
    text: np.ndarray
    begin: np.ndarray
    trie: tuple[np.ndarray, np.ndarray, np.ndarray]

    def __post_init__(self) -> None:
        self.size = np.diff(self.begin)
        self.keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * len(self.size) + self.pairs
        self.maybe = np.zeros(1 << FILTER - 3, np.uint8)  # bits of the hashes of the pairs: most arcs need no search
        at = self.keys.view(np.uint64) * wh._MUL >> np.uint64(64 - FILTER)
        np.bitwise_or.at(self.maybe, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        keys = self.trie[0]
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.slot = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        slot, left = (keys.view(np.uint64) * wh._MUL >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):  # a free slot goes to one of those that want it, the others go on to the next
            free = self.slot[slot[left]] < 0
            self.slot[slot[left[free]]] = left[free]
            left = left[self.slot[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (len(self.slot) - 1)
        self.seen: dict[int, bool] = {}
        self.next: dict[int, tuple[int, int]] | None = None

    def __reduce__(self) -> tuple:
        return Table, (self.row, self.column, self.taken, self.first, self.pairs, self.text, self.begin, self.trie)

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has the arc; a state of -1 is the start."""
        s = np.maximum(state, 0)
        key = s * len(self.size) + token
        gone = (self.taken[self.row[s], self.column[token] >> 3] >> (self.column[token] & 7)) & 1 > 0
        at = key.view(np.uint64) * wh._MUL >> np.uint64(64 - FILTER)
        maybe = np.flatnonzero((self.maybe[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        if len(maybe):
            near = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            gone[maybe] |= self.keys[near] == key[maybe]
        return ~gone | (state < 0)

    def children(self, key: np.ndarray) -> np.ndarray:
        """Place of every (node, byte) in the trie, -1 if it has none."""
        at = (key.view(np.uint64) * wh._MUL >> self.shift).astype(np.int64)
        found = self.slot[at]
        keys = self.trie[0]
        todo = np.flatnonzero((found >= 0) & (keys[found] != key))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.slot) - 1)
            found[todo] = self.slot[at[todo]]
            todo = todo[(found[todo] >= 0) & (keys[found[todo]] != key[todo])]
        return found

    def matches(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, ends, tokens): every label that stands at one of the places ``begin`` and doesn't go beyond its ``end``."""
        _, nodes, tokens = self.trie
        at, node, where = begin.copy(), np.zeros(len(begin), np.int64), np.arange(len(begin))
        out = []
        while len(where):
            key = node << 8 | data[at]
            k = self.children(key)
            hit = k >= 0
            k, where, at = k[hit], where[hit], at[hit] + 1
            node, token = nodes[k], tokens[k]
            done = token >= 0
            out.append((begin[where[done]], at[done], token[done]))
            more = (at < end[where]) & (node > 0)
            node, where, at = node[more], where[more], at[more]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (begin, begin, begin)

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, offsets of the words in them) for words of up to ``SHORT`` bytes, by transitions alone.

        Every prefix of a word has one path through the automaton, so going from left to right one arc comes into each place from
        a place that has been reached, and nothing is ever taken back.
        """
        size = end - start
        base = np.concatenate([[0], np.cumsum(size + 1)])
        word = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(word)) - (np.cumsum(size) - size)[word]
        begin, to, token = self.matches(data, start[word] + inner, end[word])
        owner = np.searchsorted(start, begin, "right") - 1 if (np.diff(start) > 0).all() else None
        if owner is None:
            raise ValueError("words must follow each other")
        length = to - start[owner]
        source, target = base[owner] + begin - start[owner], base[owner] + length
        order = np.argsort(length, kind="stable")
        source, target, token = source[order], target[order], token[order]
        cuts = np.searchsorted(length[order], np.arange(1, int(size.max(initial=0)) + 2))
        state = np.full(base[-1], -2)  # not reached
        state[base[:-1]] = -1
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            now = state[source[lo:hi]]
            ok = (now > -2) & self.arcs(now, token[lo:hi])
            state[target[lo:hi][ok]] = token[lo:hi][ok]
        at, live, steps = base[:-1] + size, np.arange(len(size)), []
        live = live[size > 0]
        while len(live):
            token = state[at[live]]
            if (token < 0).any():
                raise ValueError("a byte that no token has")
            steps.append((live, token))
            at[live] -= self.size[token]
            live = live[at[live] > base[live]]
        words = np.concatenate([x for x, _ in steps]) if steps else np.zeros(0, np.int64)
        tokens = np.concatenate([x for _, x in steps]) if steps else np.zeros(0, np.int64)
        back = np.argsort(words[::-1], kind="stable")
        count = np.bincount(words, minlength=len(size))
        return tokens[::-1][back], np.concatenate([[0], np.cumsum(count)])

    def encode(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        if self.next is None:
            self.next = {int(k): (int(n), int(t)) for k, n, t in zip(*self.trie)}
        n, state, follow, seen, v = len(word), [-2] * (len(word) + 1), self.next, self.seen, len(self.size)
        state[0] = -1
        for i in range(n):
            now, node = state[i], 0
            if now == -2:
                continue
            for j in range(i, n):
                node, token = follow.get(node << 8 | word[j], (-1, -1))
                if token >= 0 and state[j + 1] == -2:
                    known = True if now < 0 else seen.get(now * v + token)
                    if known is None:
                        known = seen[now * v + token] = bool(self.arcs(np.array([now]), np.array([token]))[0])
                    if known:
                        state[j + 1] = token
                if node <= 0:
                    break
        out, at = [], n
        while at:
            if state[at] < 0:
                raise ValueError("a byte that no token has")
            out.append(state[at])
            at -= int(self.size[state[at]])
        return out[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """What a path emits: the labels of its arcs, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("a token id without a label")
        n = self.size[ids]
        done = np.concatenate([[0], np.cumsum(n)])
        return self.text[np.repeat(self.begin[ids] - done[:-1], n) + np.arange(done[-1])].tobytes()

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """What the paths of several rows emit; ``ends``: offsets of the rows in ``ids``. Bytes that are no UTF-8 are replaced."""
        raw, at = self.decode(ids), np.concatenate([[0], np.cumsum(self.size[ids])])[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


class MergeAutomaton:
    """Builds the deterministic automaton over tokens that accepts exactly the correct tokenizations.

    It begins as one state with an arc for every byte. A merge (u, v) to x puts in a gadget: the
    state that u's arcs lead to is copied without its arc v, u's arcs are led to the copy, and
    every state with an arc u gets an arc x to where v led. A copy has what it was copied from, when
    (``right``: x begins as v's state of that moment), and the arcs taken since (``cut``); an
    arc x from a state stands for the arc u it had then (``left``).

    ``table`` writes that out. The merge (u, v) takes v, and every token that has begun with v since, from
    u, and from every state copied from u's later. Where the forests of ``left`` and ``right`` are numbered with later
    children first, these are a range of columns and a range of rows, so all arcs taken are rectangles, one for each merge.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.cut: dict[tuple[int, int], int] = {}
        self.left: list[tuple[int, int]] = [(-1, NEVER)] * len(labels)
        self.right: list[tuple[int, int]] = [(-1, NEVER)] * len(labels)
        made = {i for i, label in enumerate(labels) if len(label) == 1}
        for k, (u, v, x) in enumerate(merges):
            if u in made and v in made and x not in made and self._arc(u, v):
                self.left[x], self.right[x] = (u, k), (v, k)
                made.add(x)
            self.cut.setdefault((u, v), k)
        self.made = sorted(made)

    def _arc(self, state: int, token: int) -> bool:
        a, before = state, NEVER
        while a >= 0:
            b, until = token, NEVER
            while b >= 0:
                k = self.cut.get((a, b))
                if k is not None and k < before and k <= until:
                    return False
                b, until = self.left[b]
            a, before = self.right[a]
        return True

    def _numbered(self, parent: list[tuple[int, int]]) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int], dict[int, int]]:
        """(children with their times, later first; number of a node; number after its last descendant)"""
        children: dict[int, list[tuple[int, int]]] = {}
        for i in self.made:
            children.setdefault(parent[i][0], []).append((parent[i][1], i))
        for some in children.values():
            some.sort(reverse=True)
        begin: dict[int, int] = {}
        end: dict[int, int] = {}
        todo = [(i, False) for _, i in reversed(children.get(-1, []))]
        while todo:
            i, done = todo.pop()
            if done:
                end[i] = len(begin)
                continue
            begin[i] = len(begin)
            todo.append((i, True))
            todo += [(c, False) for _, c in reversed(children.get(i, []))]
        return children, begin, end

    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes: dict[tuple[int, int], int] = {}
        tokens: dict[tuple[int, int], int] = {}
        inner = set()
        for i in self.made:
            node = 0
            for b in self.labels[i]:
                at = (node, b)
                inner.add(node)
                node = nodes.setdefault(at, len(nodes) + 1)
            tokens[at] = i
        order = sorted(nodes)
        keys = np.array([n << 8 | b for n, b in order], np.int64)
        return keys, np.array([nodes[x] if nodes[x] in inner else 0 for x in order], np.int64), np.array([tokens.get(x, -1) for x in order], np.int64)

    def table(self, wide: int | None = None) -> Table:
        lower, column, column_end = self._numbered(self.left)
        upper, row, row_end = self._numbered(self.right)

        def until(children: list[tuple[int, int]], number: dict[int, int], end: int, k: int) -> int:
            return next((number[c] for t, c in children if t < k), end)

        boxes = [
            (row[a], until(upper.get(a, []), row, row_end[a], k + 1), column[b], until(lower.get(b, []), column, column_end[b], k)) for (a, b), k in self.cut.items() if a in row and b in row
        ]
        box = np.array(sorted(boxes, key=lambda x: (x[0] - x[1]) * (x[3] - x[2])), np.int64).reshape(-1, 4)
        large, small = box[: WIDE if wide is None else wide], box[WIDE if wide is None else wide :]
        v, n = len(self.labels), len(self.made)
        by_row, by_column = np.empty(n, np.int64), np.empty(n, np.int64)
        for i in self.made:
            by_row[row[i]], by_column[column[i]] = i, i
        rows, columns = np.unique(large[:, :2]), np.unique(large[:, 2:])
        edge = np.zeros((len(rows) + 1, len(columns) + 1), np.int32)
        r0, r1, c0, c1 = np.searchsorted(rows, large[:, 0]), np.searchsorted(rows, large[:, 1]), np.searchsorted(columns, large[:, 2]), np.searchsorted(columns, large[:, 3])
        for r, c, sign in ((r0, c0, 1), (r1, c1, 1), (r0, c1, -1), (r1, c0, -1)):
            np.add.at(edge, (r, c), sign)
        taken = np.zeros((len(rows) + 1, len(columns) + 1), bool)
        taken[1:, 1:] = (edge.cumsum(axis=0, dtype=np.int32).cumsum(axis=1, dtype=np.int32) > 0)[:-1, :-1]
        row_class, column_class = np.zeros(v, np.int32), np.zeros(v, np.int32)
        row_class[by_row], column_class[by_column] = np.searchsorted(rows, np.arange(n), "right"), np.searchsorted(columns, np.arange(n), "right")
        width = small[:, 3] - small[:, 2]
        area = (small[:, 1] - small[:, 0]) * width
        which = np.repeat(np.arange(len(small)), area)
        inner = np.arange(len(which)) - (np.cumsum(area) - area)[which]
        pair = np.sort(by_row[small[which, 0] + inner // width[which]] * v + by_column[small[which, 2] + inner % width[which]]) if len(which) else np.zeros(0, np.int64)
        pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
        s, t = np.divmod(pair, v)
        sizes = np.zeros(v, np.int64)
        sizes[self.made] = [len(self.labels[i]) for i in self.made]
        text = np.frombuffer(b"".join(self.labels[i] for i in self.made), np.uint8)
        return Table(
            row_class, column_class, np.packbits(taken, axis=1, bitorder="little"), np.searchsorted(s, np.arange(v + 1)), t.astype(np.int32), text, np.concatenate([[0], np.cumsum(sizes)]), self._trie()
        )


def vocabulary(text: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """(bytes of every token, merges as ids in order) from the JSON of a byte-level vocabulary."""
    model = json.loads(text)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    labels = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if all(c in letters for c in token):
            labels[i] = bytes(letters[c] for c in token)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return labels, [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]


@lru_cache(2)
def kinds() -> np.ndarray:
    """Per code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(sys.maxunicode + 1, 3, np.uint8)
    for i in range(0x33480):  # beyond, none is a letter, a number or a space
        c = chr(i)
        first = unicodedata.category(c)[0]
        out[i] = 0 if c.isspace() and i not in (28, 29, 30, 31) else 1 if first == "L" else 2 if first == "N" else 3
    return out


def split(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Begin of every word: contractions, then letters, numbers or others with one space before
    them, and white space, of which the last goes apart if a word follows. ``rows``: begin of every row."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[points]
    head = np.zeros(n + 1, bool)
    head[rows[rows < n]] = True
    head[n] = True
    begins = head[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == 0
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~head[1:-1]
    final = space & follows
    begins |= final
    joined = final & (points == 32)
    begins[np.flatnonzero(joined) + 1] = False
    quote = np.flatnonzero((points == 39) & begins)
    quote = quote[quote + 1 < n]
    quote = quote[~head[quote + 1] & (kind[quote + 1] == 1)]
    if len(quote):
        ends = np.append(points, [0, 0, 0])
        one, two = ends[quote + 1], ends[quote + 2]
        pair = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)] & (((one == 108) & (two == 108)) | ((one == 118) & (two == 101)) | ((one == 114) & (two == 101)))
        single = np.isin(one, [115, 100, 109, 116])
        begins[quote[single | pair] + 1] = False
        after = np.concatenate([quote[single] + 2, quote[pair] + 3])
        after = after[after < n]
        begins[after] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes rows of text; remembers the tokens of the words it has met."""

    def __init__(self, table: Table):
        self.table = table
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat = array("i")
        self.ends = array("q", [0])
        self.table.seen.clear()

    def _learn(self, words: list[bytes]) -> None:
        """Take in the tokens of new words."""
        short = [w for w in words if len(w) <= SHORT]
        if short:
            data = np.frombuffer(b"".join(short), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(w) for w in short])])
            tokens, ends = self.table.encode_words(data, at[:-1], at[1:])
            begin = len(self.flat)
            self.flat.frombytes(tokens.astype(np.int32).tobytes())
            self.place.update(zip(short, range(len(self.ends) - 1, len(self.ends) - 1 + len(short))))
            self.ends.frombytes((ends[1:] + begin).astype(np.int64).tobytes())
        for w in words:
            if len(w) > SHORT:
                self.place[w] = len(self.ends) - 1
                self.flat.extend(self.table.encode(w))
                self.ends.append(len(self.flat))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the rows in them) for the rows at ``at`` in the UTF-8 bytes ``data``."""
        base, part = int(at[0]), data[int(at[0]) : int(at[-1])]
        raw = part.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
        rows = np.searchsorted(where, at - base)
        start = split(points, rows[:-1])
        end = np.append(start[1:], len(points)) if len(start) else start
        first, which = wh.distinct(part, where[start], where[end])
        words = [raw[a:b] for a, b in zip(where[start[first]].tolist(), where[end[first]].tolist())]
        if len(self.place) > KNOWN:
            self.forget()
        self._learn([w for w in words if w not in self.place])
        code = np.array([self.place[w] for w in words], np.int64)
        ends, flat = np.array(self.ends), np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        n = (ends[code + 1] - ends[code])[which]
        done = np.concatenate([[0], np.cumsum(n)])
        tokens = flat[np.repeat(ends[code][which] - done[:-1], n) + np.arange(done[-1])]
        del flat  # the array can't grow while it is looked at
        return tokens, done[np.searchsorted(start, rows)]


@lru_cache(2)
def compiled(tokenizer: str) -> Table:
    """The table of the vocabulary at a path."""
    return MergeAutomaton(*vocabulary(open(tokenizer, encoding="utf-8").read())).table()


@lru_cache(2)
def shipped_table(context: SparkContext, tokenizer: str) -> Broadcast:
    """That table as one broadcast for all queries of an application: a worker that has it doesn't load it again beside the old one."""
    return context.broadcast(compiled(tokenizer))


_encoders: dict[int, Encoder] = {}


def _encoder(table: Table) -> Encoder:
    """One encoder per table and worker, so that words are remembered from task to task."""
    if id(table) not in _encoders:
        _encoders.clear()
        _encoders[id(table)] = Encoder(table)
    return _encoders[id(table)]


def encode_documents(docs: DataFrame, text_col: str = "text", out: str = "tokens", tokenizer: str = TOKENIZER, decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``out`` of token ids, and where ``decoded`` names one, a column of what :func:`decode_documents` makes of these.

    ``tokenizer`` is the path of a byte-level vocabulary (JSON with merges); the driver compiles it to a
    table of fixed size (20 MB for 50,000 merges) and ships that. Texts are split into words as such vocabularies are
    made (contractions; letters, numbers or other marks with one space before; white space), and
    every word goes through the automaton; special tokens' strings are ordinary text. Equal words
    of a batch are encoded once; they are found by hashes and compared byte by byte. ``decoded`` is made
    in the same step, from the tokens alone and half a megabyte of text at a time, so a task has one worker and one table.

    Null texts give null, empty texts no tokens; texts may have any length. One row per row of
    ``docs``, in a narrow step; columns called as ``out`` or ``decoded`` are replaced, all others stay.
    """
    shipped = shipped_table(docs.sparkSession.sparkContext, tokenizer)
    made = [out] if decoded is None else [out, decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            data, at = wh.strings(batch.column(place))
            for lo, hi in wh.chunks(at):
                ids, ends = encoder.encode(data, at[lo : hi + 1])
                held = batch.slice(lo, hi - lo)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=held.column(place).is_null())
                kept = [held.column(i) for i in range(len(names))]
                if decoded is None:
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=[*names, "made"])
                else:
                    texts = pa.array(encoder.table.texts(ids, ends), pa.string(), mask=held.column(place).is_null().to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([*kept, lists, texts], names=[*names, "made", "again"])

    given = docs.drop(*made)
    names, place = [f"c{i}" for i in range(len(given.columns))], given.columns.index(text_col)
    renamed = given.toDF(*names)
    kind = ", ".join(f"`{n}` {t}" for n, t in renamed.dtypes)
    return renamed.mapInArrow(run, f"{kind}, made array<int>" + ", again string" * (decoded is not None)).toDF(*given.columns, *made)


def decode_documents(docs: DataFrame, tokens_col: str = "tokens", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with a column ``out``: the labels of the tokens' arcs, one after the other.

    Null lists give null, empty lists empty texts; null ids within a list are left out, an id
    without a label raises. Bytes that are no UTF-8 are replaced by U+FFFD.
    """
    shipped = shipped_table(docs.sparkSession.sparkContext, tokenizer)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shipped.value

        def one(ids) -> str | None:
            if ids is None:
                return None
            ids = np.asarray(ids)
            if ids.dtype.kind != "i":
                ids = ids[[x is not None and x == x for x in ids]].astype(np.int64)
            return table.decode(ids).decode("utf-8", "replace")

        for series in batches:
            yield pd.Series([one(x) for x in series], dtype=object)

    return docs.withColumn(out, decode(F.col(f"`{tokens_col}`")))
