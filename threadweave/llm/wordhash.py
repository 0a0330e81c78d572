"""Words of Arrow string batches as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 19  #: bytes of text that are worked on at once; a longer text is one chunk
LONG = 64  #: bytes; longer words are hashed one by one
_MUL = np.uint64(0x9E3779B97F4A7C15)

_codes = np.arange(256)
ALNUM = ((_codes >= 48) & (_codes < 58)) | ((_codes >= 65) & (_codes < 91)) | ((_codes >= 97) & (_codes < 123)) | (_codes >= 128)
NOT_SPACE = ~np.isin(_codes, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
LOWERED = np.where((_codes >= 65) & (_codes < 91), _codes + 32, _codes).astype(np.uint8)
#: First and last code point of scripts that are written without spaces; each of their letters is a word of its own.
UNSPACED = ((0x0E00, 0x0EDF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_low = np.zeros(1 << 16, bool)
for _a, _b in UNSPACED[:-1]:
    _low[_a : _b + 1] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: ``start`` and ``end`` in ``data``, their ``hash``; row r has words ``first[r]`` to ``first[r+1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, one row at least."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from every ``start`` to its ``end``: eight at a time, each mixed in by a bijection, so that no
    pattern of letters cancels out; of words above LONG bytes xxh64."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from any place on
    size = end - start
    out = size.astype(np.uint64) * _MUL
    short = np.flatnonzero(size <= LONG)
    at, left, done = start[short], size[short], 0
    while len(short):
        keep = np.uint64(64) - (np.minimum(left, 8).astype(np.uint64) << np.uint64(3))
        part = np.where(left > 0, (eight[at] << keep) >> keep, np.uint64(0))
        out[short] = mix(out[short] ^ part) + _MUL
        more = left > 8
        short, at, left, done = short[more], at[more] + 8, left[more] - 8, done + 8
    long = np.flatnonzero(size > LONG)
    if len(long):
        view = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh64_intdigest(view[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return out


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of every different word, which of these each word is): found by hash, and equal by their bytes."""
    _, first, which = np.unique(hashed(data, start, end), return_index=True, return_inverse=True)
    one = first[which]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    same = (end - start) == (end - start)[one]
    at, other, left = start[same], start[one[same]], (end - start)[same]
    wrong = not same.all()
    while len(at) and not wrong:
        keep = np.uint64(64) - (np.minimum(left, 8).astype(np.uint64) << np.uint64(3))
        wrong = bool(((((eight[at] ^ eight[other]) << keep) != 0) & (left > 0)).any())
        more = (left > 8) & (at != other)
        at, other, left = at[more] + 8, other[more] + 8, left[more] - 8
    if not wrong:
        return first, which
    view, known, which = memoryview(np.ascontiguousarray(data)), {}, np.empty(len(start), np.int64)
    for i, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
        which[i] = known.setdefault(bytes(view[a:b]), (len(known), i))[0]
    return np.array([i for _, i in known.values()], np.int64), which


def unspaced(part: np.ndarray) -> np.ndarray:
    """Places of the first bytes of letters of scripts without spaces."""
    lead = np.flatnonzero(part >= 0xE0)
    if not len(lead):
        return lead
    padded = np.concatenate([part, np.zeros(3, np.uint8)]).astype(np.int32)
    three = ((part[lead].astype(np.int32) & 15) << 12) | ((padded[lead + 1] & 63) << 6) | (padded[lead + 2] & 63)
    wide = (part[lead] >= 0xF0) & (((part[lead].astype(np.int32) & 7) << 2 | (padded[lead + 1] >> 4) & 3) >= 2)  # from U+20000 on
    return lead[np.where(part[lead] < 0xF0, _low[three], wide)]


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = ALNUM, lower: bool = True, apart: bool = True) -> Words:
    """Split rows (``at``: offsets in ``data``) at bytes that ``table`` doesn't have; a word never crosses a row.

    ``lower`` takes ASCII letters as their small ones; ``apart`` makes each letter of a script without spaces a word.
    """
    base = int(at[0])
    part, at = data[base : int(at[-1])], at - base
    n = len(part)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[part]
    now = inside[1:-1]
    begins, ends = now & ~inside[:-2], now & ~inside[2:]
    edge = at[:-1][at[:-1] < n]
    begins[edge] = now[edge]
    edge = at[1:][(at[1:] > 0)] - 1
    ends[edge] = now[edge]
    alone = unspaced(part) if apart else edge[:0]
    alone = alone[now[alone]]
    if len(alone):
        after = alone + np.where(part[alone] >= 0xF0, 4, 3)
        begins[alone] = True
        follow = after[after < n]
        begins[follow] |= now[follow]
        ends[np.minimum(after, n) - 1] = True
        ends[alone[alone > 0] - 1] |= now[alone[alone > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(part, at, start, end, hashed(LOWERED[part] if lower else part, start, end), np.searchsorted(start, at))


def doubled(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(w, hashes of every w successive symbols) for w = 1, 2, 4, ..."""
    step = 1
    while len(symbols):
        yield step, symbols
        symbols = mix(symbols[:-step] ^ (mix(symbols[step:]) + _MUL))
        step *= 2


def windowed(symbols: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k successive symbols: those of the powers of two in k, mixed one after the other."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.full(n, k, np.uint64) * _MUL, 0
    for step, level in doubled(symbols):
        if k & step:
            out = mix(out ^ level[done : done + n]) + _MUL
            done += step
        if done == k:
            return out


def spans(symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same of the ``size`` symbols from every ``start`` on."""
    out, at, most = size.astype(np.uint64) * _MUL, start.copy(), int(size.max()) if len(size) else 0
    for step, level in doubled(symbols):
        if step > most:
            break
        has = np.flatnonzero(size & step)
        out[has] = mix(out[has] ^ level[at[has]]) + _MUL
        at[has] += step
    return out
