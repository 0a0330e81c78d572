"""Repeated passages: maximal repeats from the interval trees of enhanced suffix arrays.

A suffix array of the whole corpus would need all texts in one place. Here the suffixes are
shared out by content: of any MIN_WORDS successive words, the least hash of GRAM successive ones is
an anchor, so equal passages have equal anchors, and a repeat belongs to the anchor that is least
in its first window. All occurrences of an anchor meet in one task with as much context as a repeat
can have, and the suffix array, its interval tree and the test of what precedes are made there.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadweave.llm import wordhash as wh
from threadweave.session import cut

MIN_WORDS = 45  #: least length of a repeat
GRAM = 15  #: words of an anchor
WIDE = 50_000  #: words; a group with more of overlapping contexts is sorted by doubling and not by comparing texts
FIELDS = ("copies", "part", "word", "at", "places", "lefts", "ends", "lows", "highs")
TOKEN = re.compile(r"[^\t-\r\x1c-\x20]+")


def split(data: np.ndarray, at: np.ndarray) -> wh.Words:
    return wh.words(data, at, wh.NOT_SPACE, lower=False, apart=False)


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every w successive values."""
    best, done = x, 1
    pick = np.minimum if least else np.maximum
    while done < w:
        step = min(done, w - done)
        best, done = pick(best[:-step], best[step:]) if step else best, done + step
    return best


def anchors(symbols: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``symbols``, hashes): grams that are the least of some window of ``min_words`` words inside a row."""
    w = min_words - k + 1
    n = len(symbols) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = wh.windowed(symbols, k)
    row_end = np.repeat(first[1:], np.diff(first))
    whole = np.arange(len(symbols)) + min_words <= row_end  # a window may begin here
    lows = np.where(whole[: n - w + 1], sliding(grams, w, True), np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), lows, np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero((sliding(padded, w, False) == grams) & (np.arange(n) + k <= row_end[:n]))
    return chosen, grams[chosen]


def owned(symbols: np.ndarray, first: np.ndarray, chosen: np.ndarray, min_words: int = MIN_WORDS, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words before each anchor that matter, least and greatest number of words before it that its repeats begin at).

    A repeat belongs to the anchor that is the first of the least grams of its first window. So it doesn't begin at or before
    the nearest gram to the left that isn't greater, nor so late that a lesser gram to the right is in its window.
    """
    w = min_words - k + 1
    grams = wh.windowed(symbols, k)
    row = np.searchsorted(first, chosen, "right") - 1
    before, after = chosen - first[row], first[row + 1] - chosen - k  # words before, grams after it in its row
    left, high, low = np.minimum(before, w), np.minimum(before, w - 1), np.zeros(len(chosen), np.int64)
    mine = grams[chosen]
    for d in range(w, 0, -1):
        near = (d <= before) & (grams[np.maximum(chosen - d, 0)] <= mine)
        left[near], high[near] = d, d - 1
        if d < w:
            lesser = (d <= after) & (grams[np.minimum(chosen + d, len(grams) - 1)] < mine)
            low[lesser] = w - d
    return left, low, high


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchor_rows(base: DataFrame, min_words: int, k: int) -> DataFrame:
    """``(gram, same, pos, before)`` for every anchor; ``same``: hash of its text; ``before``: hash of the words before it that
    matter, or of the row if that begins with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            data, at = wh.strings(batch.column(2))
            for lo, hi in wh.chunks(at):
                found = split(data, at[lo : hi + 1])
                chosen, grams = anchors(found.hash, found.first, min_words, k)
                row = np.searchsorted(found.first, chosen, "right") - 1
                pos = chosen - found.first[row]
                key = keys[lo + row]
                left, _, _ = owned(found.hash, found.first, chosen, min_words, k)
                before = wh.spans(found.hash, chosen - left, left)
                start = left == pos
                before[start] = wh.mix(key[start] + wh.mix(pos[start].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(grams)), pa.array(_signed(texts[lo + row])), pa.array(pos, pa.int32()), pa.array(_signed(before))], names=["gram", "same", "pos", "before"]
                )

    return base.select("key", "same", "t").mapInArrow(run, "gram bigint, same bigint, pos int, before bigint")


def context_rows(marked: DataFrame, min_words: int, k: int, kind: str) -> DataFrame:
    """``(gram, copies, part, word, at, places, lefts, ends, lows, highs)`` for the anchors to work on.

    An anchor's context are the words before it that a repeat of its can begin with, and the words from it on as far as a
    repeat can go: beyond the next anchor that occurs nowhere else there are at most a window and a gram more. Contexts of
    one anchor that overlap in a text are one ``part``, so a text of one word over and over is sent once. ``word`` and ``at``
    are where the part begins in the text; ``places``, ``lefts`` and ``ends`` are words of the part, ``lows`` and ``highs`` what ``owned`` gives.
    """
    w = min_words - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = wh.strings(batch.column(1))
            for r in range(batch.num_rows):
                found = split(data, at[r : r + 2])
                chosen, grams = anchors(found.hash, found.first, min_words, k)
                pos = np.array(batch.column(2)[r].as_py(), np.int64)
                work = np.unique(np.abs(pos[pos < 0]) - 1)  # written as -1 - pos
                repeated = np.union1d(work, pos[pos >= 0])
                alone = chosen[~np.isin(chosen, repeated)]
                text, n = found.data.tobytes(), len(found.hash)
                letters = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                stop = np.minimum(np.append(alone, n)[np.searchsorted(alone, work)] + w + k, n)
                left, low, high = owned(found.hash, found.first, work, min_words, k)
                gram = grams[np.searchsorted(chosen, work)]
                order = np.argsort(gram, kind="stable")
                work, left, stop, gram, low, high = (x[order] for x in (work, left, stop, gram, low, high))
                # stops go up with the places, so a part ends where the next context begins beyond its last stop
                new = np.ones(len(work), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (work[1:] - left[1:] >= stop[:-1])
                head = np.flatnonzero(new)
                owner = np.cumsum(new) - 1
                first = (work - left)[head]
                last = stop[np.append(head[1:], len(work)) - 1] if len(work) else stop
                cuts = pa.array(np.append(head, len(work)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (work - first[owner], work - left - first[owner], stop - first[owner], low, high)]
                begin, end = found.start[first], found.end[last - 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(np.ascontiguousarray(gram[head]))),
                        batch.column(0).take(pa.array(np.full(len(head), r))),
                        pa.array([text[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())], pa.string()),
                        pa.array(first, pa.int32()),
                        pa.array(letters[begin], pa.int32()),
                        *lists,
                    ],
                    names=["gram", *FIELDS],
                )

    shape = f"gram bigint, copies array<struct<id:{kind},key:bigint>>, part string, word int, at int, places array<int>, lefts array<int>, ends array<int>, lows array<int>, highs array<int>"
    return marked.select("copies", "t", "marks").mapInArrow(run, shape)


def tokens(text: str) -> list[str]:
    """Words of a text."""
    return list(map(sys.intern, TOKEN.findall(text)))


def spans(text: str) -> np.ndarray:
    """Begin and end of what ``tokens`` gives."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = wh.NOT_SPACE[np.minimum(points, 33)]
    return np.stack([np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1], axis=1).astype(np.int32)


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    hi = min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def ordered(texts: list[str]) -> tuple[list[int], np.ndarray]:
    """Suffix array of texts that end each word with a space, and its common prefixes in words (the first is 0)."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    lcp = np.zeros(len(texts), np.int64)
    for i in range(1, len(order)):
        a, b = texts[order[i - 1]], texts[order[i]]
        lcp[i] = a.count(" ", 0, common(a, b))
    return order, lcp


def doubled(parts: list[list[str]], items: list[tuple[int, int]]) -> tuple[list[int], np.ndarray]:
    """The same for suffixes of parts, given as (part, word), by doubling the prefix that the ranks stand for: overlapping suffixes aren't written out."""
    known: dict[str, int] = {}
    base = np.cumsum([0] + [len(p) + 1 for p in parts])
    symbol = np.empty(base[-1], np.int64)
    for p, b in zip(parts, base.tolist()):
        symbol[b : b + len(p)] = [known.setdefault(x, len(known)) for x in p]
    symbol[base[1:] - 1] = len(known) + np.arange(len(parts))  # a part's end is like no other
    at = np.array([base[p] + a for p, a in items])
    rank, levels, step = symbol, [symbol], 1
    while True:
        ahead = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])
        order = np.lexsort((ahead, rank))
        new = np.ones(len(rank), bool)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (ahead[order[1:]] != ahead[order[:-1]])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        levels.append(rank)
        step *= 2
    by = np.argsort(rank[at])
    a, b = at[by[:-1]], at[by[1:]]
    lcp = np.zeros(len(at), np.int64)
    for j in reversed(range(len(levels))):
        level = np.append(levels[j], -1)
        n = len(levels[j])
        same = (a < n) & (b < n) & (level[np.minimum(a, n)] == level[np.minimum(b, n)])
        lcp[1:] += same << j
        a, b = a + (same << j), b + (same << j)
    return by.tolist(), lcp


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of a suffix array, by a scan with a stack. Only prefixes of ``least`` on."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        low = i - 1
        while stack and stack[-1][0] > now:
            depth, low = stack.pop()
            yield depth, low, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, low))


@dataclass
class Context:
    """An anchor's occurrence in the words of a part: its place, the first word that matters and the end, and how many words before it repeats of its can begin."""

    part: int
    words: list[str]
    place: int
    left: int
    end: int
    low: int
    high: int


@dataclass
class Repeat:
    """A node: words before the anchor (``left``) and from it on (``length``), occurrences that no longer repeat has (``own``), and the nodes below it."""

    left: int
    length: int
    a: int
    b: int
    own: list[int]
    below: list[Repeat]
    first: int = -1
    above: Repeat | None = None
    size: int = 0
    name: int = 0

    def nodes(self) -> Iterator[Repeat]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += node.below


def maximal_repeats(found: list[Context], whole: list[bool], age: list[int], min_words: int, k: int) -> Iterator[Repeat]:
    """Roots of the trees of all maximal repeats that belong to this anchor.

    ``whole``: the text begins with the words before the anchor. A repeat that begins o words before the anchor is a set of
    occurrences that agree in o words before it, so for every o at which some differ the suffixes that agree up to there are scanned for intervals; one whose
    members are not all preceded by one word, and so can't be longer to the left, is maximal.
    Its occurrences are its own and those of the nodes below it, which are longer. ``first``
    is the occurrence of the least ``age``.
    """
    w = min_words - k + 1
    if len(found) < 2:
        return
    length = [c.end - c.place for c in found]
    parts = {c.part: c.words for c in found}
    if len(parts) < len({(c.part, c.place) for c in found}) and sum(length) > max(WIDE, 2 * sum(map(len, parts.values()))):
        number = {p: i for i, p in enumerate(parts)}
        order, lcp = doubled(list(parts.values()), [(number[c.part], c.place) for c in found])
    else:
        plain = {(c.part, c.place): " ".join(c.words[c.place : c.end]) + " " for c in found}
        order, lcp = ordered([plain[c.part, c.place] for c in found])
    # the two occurrences that copies of a text stand for are the same suffix
    for i in range(1, len(order)):
        if (found[order[i]].part, found[order[i]].place) == (found[order[i - 1]].part, found[order[i - 1]].place):
            lcp[i] = length[order[i]]
    if lcp.max() + w - 1 < min_words:
        return
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    low, high = np.array([c.low for c in found]), np.array([c.high for c in found])
    left_words = [c.words[c.left : c.place][::-1] for c in found]
    ends = ["".join(x + " " for x in ws) + (f"\x02{i} " if at_start else "") for i, (ws, at_start) in enumerate(zip(left_words, whole))]
    left_order, left_lcp = ordered(ends)
    for o, lo, hi in intervals(left_lcp.tolist(), 0):
        some = left_order[lo]
        if o >= w or (o == len(left_words[some]) and not whole[some]):
            continue
        members = np.array(left_order[lo : hi + 1])
        child = np.concatenate([[0], np.cumsum(left_lcp[lo + 1 : hi + 1] == o)])
        # those with one window belong to the anchor together or not at all
        ours = (low[members] <= o) & (high[members] >= o)
        members, child = members[ours], child[ours]
        if len(members) < 2:
            continue
        by = np.argsort(rank[members])
        members, child = members[by], child[by]
        at = rank[members]
        part = np.concatenate([[0], np.minimum.reduceat(lcp[: at[-1] + 1], at[:-1] + 1)])
        need = max(min_words - o, k)
        if part.max() < need:
            continue
        changes = np.concatenate([[0], np.cumsum(child[1:] != child[:-1])])
        roots: list[Repeat] = []
        for size, a, b in intervals(part.tolist(), need):
            if changes[a] == changes[b]:
                continue
            node = Repeat(o, size, a, b, [], [])
            while roots and roots[-1].a >= a:
                node.below.append(roots.pop())
            begin = a
            for x in reversed(node.below):
                node.own += members[begin : x.a].tolist()
                begin, x.above = x.b + 1, node
            node.own += members[begin : b + 1].tolist()
            node.first = min((*node.own, *(x.first for x in node.below)), key=age.__getitem__)
            roots.append(node)
        yield from roots


def named(root: Repeat, found: list[Context]) -> None:
    """Name every node by the hash of its words; a node's is carried on from that of the node above."""
    todo = [(root, xxhash.xxh64(), -root.left)]
    while todo:
        node, above, done = todo.pop()
        c = found[node.first]
        state = above.copy()
        state.update("".join(x + " " for x in c.words[c.place + done : c.place + node.length]).encode())
        name = state.intdigest()
        node.name = name - (1 << 64) * (name >> 63)
        todo += [(x, state, node.length) for x in node.below]


def repeat_rows(contexts: DataFrame, min_words: int, k: int, kind: str) -> DataFrame:
    """Rows of ``find_repeats``, and ``cut_start`` and ``cut``: what must go for all but first occurrences to go."""

    def group(copies: list, parts: list, word: list, at: list, places: list, lefts: list, ends: list, lows: list, highs: list) -> Iterator[tuple]:
        # A text with copies takes part twice, as its first copy and as all others: in which repeats
        # copies of one text are doesn't depend on their number. own: the copies of each context
        own, found, whole = [], [], []
        for i, c in enumerate(copies):
            c = sorted((x["id"], x["key"]) for x in c)
            words = tokens(parts[i])
            for place, left, end, low, high in zip(places[i], lefts[i], ends[i], lows[i], highs[i]):
                for which in (c[:1], c[1:]) if len(c) > 1 else (c,):
                    own.append(which)
                    found.append(Context(i, words, place, left, end, low, high))
                    whole.append(word[i] + left == 0)
        age = [0] * len(own)
        for n, j in enumerate(sorted(range(len(own)), key=lambda j: (own[j][0][0], word[found[j].part] + found[j].place, own[j][0][1]))):
            age[j] = n
        known: dict[int, np.ndarray] = {}

        def letters(i: int) -> np.ndarray:
            if i not in known:
                known[i] = spans(parts[i]) + at[i]
            return known[i]

        for root in maximal_repeats(found, whole, age, min_words, k):
            named(root, found)
            nodes = list(root.nodes())
            for node in reversed(nodes):
                node.size = sum(len(own[j]) for j in node.own) + sum(x.size for x in node.below)
            for node in nodes:
                above = node.above.name if node.above else None
                for j in node.own or [node.first]:
                    c, where = found[j], letters(found[j].part)
                    begin, end = int(where[c.place - node.left][0]), int(where[c.place + node.length - 1][1])
                    cutter = node if node.own else None
                    while cutter is not None and cutter.first == j:
                        cutter = cutter.above
                    cut_from = cut_to = None
                    if cutter is not None:
                        one = found[cutter.first]
                        # where it overlaps the first, every passage of min_words words stays once
                        over = one.part == c.part and c.place < one.place + cutter.length + cutter.left and own[j][0] == own[cutter.first][0]
                        keep = min_words - 1 if over else 0
                        if keep < node.left + cutter.length:
                            cut_from, cut_to = int(where[c.place - node.left + keep][0]), int(where[c.place + cutter.length - 1][1])
                    for n, (doc, key) in enumerate(own[j] if node.own else own[j][:1]):
                        later = (begin, end) if n else (cut_from, cut_to)
                        yield node.name, above, node.left + node.length, node.size, doc, key, begin, end, *later

    def flush(held: list[list]) -> pa.RecordBatch | None:
        out = list(group(*held[1:]))
        if not out:
            return None
        shape = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), types[0], pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        names = ["repeat_id", "parent_id", "n_words", "n_occurrences", "doc_id", "key", "start", "end", "cut_start", "cut"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), shape)], names=names)

    types: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(len(FIELDS) + 1)]
        for batch in batches:
            types[:] = [batch.schema.field(1).type.value_type.field(0).type]
            grams = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])).tolist()
            for a, b in zip(edges, [*edges[1:], len(grams)]):
                part = [batch.column(c).slice(a, b - a).to_pylist() for c in range(len(FIELDS) + 1)]
                if held[0] and held[0][0] != part[0][0]:
                    if (made := flush(held)) is not None:
                        yield made
                    held = part
                else:
                    for x, y in zip(held, part):
                        x += y
        if held[0] and (made := flush(held)) is not None:
            yield made

    shape = f"repeat_id bigint, parent_id bigint, n_words int, n_occurrences int, doc_id {kind}, key bigint, start int, end int, cut_start int, cut int"
    spread = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(spread, "gram").sortWithinPartitions("gram").mapInArrow(run, shape)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t <> ''")
    return base.withColumn("key", F.xxhash64("id", "t")).withColumn("same", F.xxhash64("t"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``(repeat_id, parent_id, n_words, n_occurrences, doc_id, key, start, end, cut_start, cut)``: all maximal repeats with all occurrences.

    A word is a run of what isn't ASCII white space, and equal words in a row are words like any others. A
    maximal repeat has at least ``min_words`` words, occurs at least twice, in one document or
    several, and no word can be added on either side in all its occurrences. ``start`` and
    ``end`` are characters of the text, ``key`` tells rows of one id with different texts apart.

    The result is the interval tree: repeats that begin with the words of a shorter one, and occur
    in part of its places, are below it (``parent_id``). Each occurrence stands once, with the longest
    repeat that begins there and is as long to the left; a repeat's ``n_occurrences`` are its own rows
    and those of the repeats below it. So many near copies, which share ever shorter repeats, give
    rows in proportion to their number and not to its square. A repeat all of whose occurrences
    are below it has one row, its first. ``all_occurrences`` expands the tree; ``cut_start`` and ``cut`` are used by ``drop_repeats``.

    Anchors that occur once, and those that are preceded by one and the same window wherever they
    occur (any repeat there begins before it), are left aside before any text is moved. Texts are
    compared, never hashes of them; hashes only say where to compare. Only texts with a
    repeated anchor take part in the second half, copies of a text as one, and there is no limit to a text's length or a
    group's size. Null ids, null and empty texts are left out; rows that repeat both id and
    text count once; ties in the order of equal suffixes don't matter. An empty table gives no
    rows; other columns are ignored.
    """
    if gram >= min_words:
        raise ValueError("a gram must be shorter than a repeat")
    base = keyed(docs, id_col, text_col)
    kind = dict(base.dtypes)["id"]
    same = Window.partitionBy("gram")
    counted = anchor_rows(base, min_words, gram).select("same", "pos", F.count(F.lit(1)).over(same).alias("n"), (F.min("before").over(same) != F.max("before").over(same)).alias("differ"))
    marks = counted.where("n > 1").groupBy("same").agg(F.collect_set(F.when(F.col("differ"), -1 - F.col("pos")).otherwise(F.col("pos"))).alias("marks")).where(F.exists("marks", lambda x: x < 0))
    # copies of a text come together here and go on as one
    found = base.join(marks, "same").groupBy("same", "t").agg(F.collect_set(F.struct("id", "key")).alias("copies"), F.first("marks").alias("marks"))
    contexts = context_rows(found, min_words, gram, kind)
    return repeat_rows(contexts, min_words, gram, kind)


def all_occurrences(found: DataFrame) -> DataFrame:
    """``(repeat_id, doc_id, key, start)``: every occurrence with every repeat that begins there, from the tree of ``find_repeats``.

    Chains of nodes are followed by doubling, so the rounds grow with the logarithm of the depth.
    """
    own = found.select("repeat_id", "doc_id", "key", "start")
    up = cut(found.where("parent_id is not null").select(F.col("repeat_id").alias("low"), F.col("parent_id").alias("high")).distinct())
    reach, last = up, -1
    while (now := reach.count()) != last:
        further = reach.join(reach.select(F.col("low").alias("high"), F.col("high").alias("higher")), "high").select("low", F.col("higher").alias("high"))
        reach, last = cut(reach.union(further).distinct()), now
    return own.union(own.join(reach, own["repeat_id"] == reach["low"]).select(F.col("high").alias("repeat_id"), "doc_id", "key", "start")).distinct()


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with every repeated passage cut but for its first occurrence, in order of id and place.

    Of each maximal repeat the first occurrence stays, unless it is part of another repeat that
    occurs before; so each passage stays once. Where a passage overlaps itself, as in a line that is written over and
    over, so much stays that every passage of ``min_words`` words is there once. The columns stay as they are; a text that was cut
    and has nothing but white space left goes with its row. Rows that repeat an id and text are
    cut alike. Nulls and empty texts stay.
    """
    found = cut(find_repeats(docs, id_col, text_col, min_words, gram))
    held = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's name
    key, cuts_at, made, rest = (held + x for x in ("key", "cuts", "made", "rest"))
    cuts = found.where("cut is not null").groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set(F.struct(F.col("cut_start").alias("start"), F.col("cut").alias("end")))).alias(cuts_at))
    text = F.col(f"`{text_col}`").cast("string")
    merged = F.aggregate(
        cuts_at,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, c: F.struct(
            F.greatest(s["at"], c["end"]).alias("at"),
            F.when(c["start"] > s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, c["start"] - s["at"]))).otherwise(s["out"]).alias("out"),
        ),
    )
    marked = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), text)).join(cuts, key, "left").withColumn(made, F.when(F.col(cuts_at).isNotNull(), merged))
    left = F.concat(F.col(f"{made}.out"), F.substring(text, F.col(f"{made}.at") + 1, F.length(text)))
    changed = marked.withColumn(rest, F.when(F.col(made).isNotNull(), left)).where(F.col(rest).isNull() | F.col(rest).rlike(r"[^\t-\r\x1c-\x20]"))
    return changed.select(*[F.coalesce(rest, text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
