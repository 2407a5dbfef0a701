"""SimHash fingerprints and MinHash sketches of many texts at once, with the values of simhash() and sketch().

Words, their hashes and all that follows are arrays over a block of texts: no object a word or a shingle, and no lambda
over them. XXH64 is worked out here because a shingle of sketch() is a chain of hashes, each the seed of the next one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .minhash import _LONGS, _TRIES, BINS, BITS, _mix

#: Bytes of text that are looked at together, and shingles that are hashed at a time.
_BLOCK, _STEP = 1 << 19, 1 << 14
#: Longer strings are hashed one by one.
_LONG = 512
#: Texts of so many different shingles or fewer are near copies at 0.8 only if they have the very same.
FEW = 3
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
#: A-Z to a-z, all other bytes as they are.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: For each byte a long whose eight bytes are its bits, the lowest one first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_WIDTH = 62 - BINS.bit_length() + 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(lane: np.ndarray) -> np.ndarray:
    return _rotl(lane * _P2, 31) * _P1


def _eight(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return _rotl(h ^ mixed, 27) * _P1 + _P4


def _four(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return _rotl(h ^ mixed, 23) * _P2 + _P3


def _one(h: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    return _rotl(h ^ mixed, 11) * _P1


def _end(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Strings:
    """Strings within a buffer of bytes that goes on for eight bytes after the last; their XXH64 for any seeds."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        self.data, self.begin, self.size = data, begin, size
        self.at = lambda places, kind="<u8": np.ndarray((len(data) - 7,), dtype=kind, buffer=data, strides=(1,))[places].astype(np.uint64)
        usual = size <= _LONG
        self.long = np.flatnonzero(~usual)
        # stripes of 32 bytes, which need the seed; of what is left the rows that have each piece, and the piece as it is mixed in
        self.stripes = np.where(usual, size >> 5, 0)
        self.wide = np.flatnonzero(self.stripes)
        rest, place, self.steps = size & 31, begin + (self.stripes << 5), []
        for j in range(3):
            rows = np.flatnonzero(usual & (rest >= 8 * (j + 1)))
            self.steps.append((_eight, rows, _round(self.at(place[rows] + 8 * j))))
        place, rest = place + (rest & 24), rest & 7
        rows = np.flatnonzero(usual & (rest >= 4))
        self.steps.append((_four, rows, self.at(place[rows], "<u4") * _P1))
        place, rest = place + (rest & 4), rest & 3
        for j in range(3):
            rows = np.flatnonzero(usual & (rest > j))
            self.steps.append((_one, rows, data[place[rows] + j].astype(np.uint64) * _P5))

    def hashes(self, seeds: np.ndarray, skip: int = 0) -> np.ndarray:
        """With a seed for each string after the first skip ones."""
        n = len(seeds)
        h = seeds + _P5
        wide = self._those(self.wide, skip, n)
        if wide.start < wide.stop:
            h[self.wide[wide] - skip] = self._striped(self.wide[wide], seeds[self.wide[wide] - skip])
        h += self.size[skip : skip + n].astype(np.uint64)
        for f, rows, mixed in self.steps:
            some = self._those(rows, skip, n)
            if some.start < some.stop:
                at = rows[some] - skip
                h[at] = f(h[at], mixed[some])
        h = _end(h)
        for i in self.long[self._those(self.long, skip, n)].tolist():
            h[i - skip] = xxhash.xxh64_intdigest(self.data[self.begin[i] : self.begin[i] + self.size[i]].tobytes(), int(seeds[i - skip]))
        return h

    @staticmethod
    def _those(rows: np.ndarray, skip: int, n: int) -> slice:
        return slice(*np.searchsorted(rows, [skip, skip + n]))

    def _striped(self, rows: np.ndarray, seed: np.ndarray) -> np.ndarray:
        v, n = [seed + _P1 + _P2, seed + _P2, seed.copy(), seed - _P1], self.stripes[rows]
        for s in range(int(n.max())):
            some = np.flatnonzero(n > s)
            for j, acc in enumerate(v):
                acc[some] = _rotl(acc[some] + self.at(self.begin[rows[some]] + 32 * s + 8 * j) * _P2, 31) * _P1
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for acc in v:
            h = (h ^ _round(acc)) * _P1 + _P4
        return h


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and how many begin before each of starts; texts are bytes one after the other."""
    space = _SPACES[data]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = starts[starts < len(data)]
    before[inner] = True
    after[inner[inner > 0] - 1] = True
    after[-1:] = True
    begins = np.flatnonzero(~space & before)
    return begins, np.flatnonzero(~space & after) + 1, np.searchsorted(begins, starts)


def _runs(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word and the number of words of each shingle, and how many shingles there are before each text."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(upto[-1]) + np.repeat(bounds[:-1] - upto[:-1], count)
    return first, np.repeat(np.minimum(n, k), count), upto


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, dtype=np.uint8)])


def shingles(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of shingle_hashes() of all texts, repeats kept, and how many there are before each text."""
    begin, end, bounds = _words(data, starts)
    first, size, upto = _runs(bounds, k)
    data, chained = _padded(data), np.empty(len(begin), dtype=np.uint64)
    # of a text of fewer words than k the chain ends before
    short = {j: first[size == j] for j in range(1, k)}
    for i in range(0, len(begin), _STEP):
        n = min(_STEP, len(begin) - i)
        words = Strings(data, begin[i : i + n + k - 1], (end - begin)[i : i + n + k - 1])
        h, ended = np.full(n, 42, dtype=np.uint64), {}
        for j in range(min(k, len(begin) - i)):
            m = min(n, len(begin) - i - j)
            h[:m] = words.hashes(h[:m], j)
            if j + 1 < k:
                at = short[j + 1][slice(*np.searchsorted(short[j + 1], [i, i + n]))] - i
                ended[j] = at, h[at]
        for at, value in ended.values():
            h[at] = value
        chained[i : i + n] = h
    return ((chained[first] >> np.uint64(2)) & ~np.uint64(1)).astype(np.int64), upto


def fingerprints(data: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """simhash() of each text."""
    begin, end, bounds = _words(data, starts)
    first, size, upto = _runs(bounds, k)
    # all words with one blank before each: a shingle is a piece of that
    length = end - begin
    place = np.cumsum(length + 1) - length
    joined = np.full((place[-1] + length[-1] if len(place) else 0) + 8, 32, dtype=np.uint8)
    inside = ~_SPACES[data]
    joined[np.flatnonzero(inside) + np.repeat(place - begin, length)] = _LOWER[data[inside]]
    ones, n = np.zeros((len(starts) - 1, 64), dtype=np.int64), np.diff(upto)
    for i in range(0, len(first), _STEP):
        f, last = first[i : i + _STEP], first[i : i + _STEP] + size[i : i + _STEP] - 1
        at = place[f]
        h = Strings(joined, at, place[last] + length[last] - at).hashes(np.full(len(f), 42, dtype=np.uint64))
        # bits are counted in the bytes of longs, 255 shingles of a text at a time
        texts = np.searchsorted(upto, np.arange(i, i + len(f)), side="right") - 1
        nth = np.arange(i, i + len(f)) - np.maximum(upto[texts], i)
        cut = np.flatnonzero(nth % 255 == 0)
        counts = np.stack([np.add.reduceat(_SPREAD[b], cut) for b in h.astype("<u8").view(np.uint8).reshape(-1, 8).T], axis=1)
        np.add.at(ones, texts[cut], counts.view(np.uint8).reshape(-1, 64))
    return np.packbits((ones * 2 > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The bins that an empty one tries, and the order in which it takes the full ones after that."""
    tries = np.array([[_mix(b * 1000003 + t) % BINS for b in range(BINS)] for t in range(_TRIES)])
    bins = np.arange(BINS, dtype=np.uint64)
    h = _end(_four(np.uint64(42) + _P5 + np.uint64(4) + np.zeros(BINS, dtype=np.uint64), bins * _P1))
    order = _end(_eight(h[:, None] + _P5 + np.uint64(8), _round(bins)[None, :])).view(np.int64)
    return tries, order


def sketches(h: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """sketch() of texts with these hashes, a row of longs each."""
    texts, n = len(upto) - 1, np.diff(upto)
    v = np.tile((np.arange(1, BINS + 1, dtype=np.int64) << _WIDTH) - 1, (texts, 1))
    np.minimum.at(v.reshape(-1), np.repeat(np.arange(texts), n) * BINS + (h >> _WIDTH), h)
    full, tries_order = v & 1 == 0, _tables()
    out, none = v.copy(), ~full
    none[n == 0] = False
    for t in tries_order[0]:
        if not none.any():
            break
        now = none & full[:, t]
        out[now] = v[:, t][now]
        none &= ~now
    for i in np.flatnonzero(none.any(axis=1)).tolist():
        there, b = np.flatnonzero(full[i]), np.flatnonzero(none[i])
        out[i, b] = v[i, there[np.argmin(tries_order[1][b[:, None], there], axis=1)]]
    low = ((out >> 1) & ((1 << BITS) - 1)).astype(np.uint64).reshape(texts, _LONGS, 64 // BITS)
    packed = np.bitwise_or.reduce(low << np.arange(64 - BITS, -1, -BITS, dtype=np.uint64), axis=2)
    packed[n == 0] = 0
    return packed.view(np.int64)


def few(h: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with at most FEW different shingles a hash of these; which others there are."""
    out, n = np.zeros(len(upto) - 1, dtype=np.uint64), np.diff(upto)
    others = np.zeros(len(n), dtype=bool)
    some = n > 0
    starts = upto[:-1][some]
    if not len(starts):
        return out.view(np.int64), others
    # the least, and the least above it, FEW times
    last = np.full(len(starts), -1, dtype=np.int64)
    open_, none = np.flatnonzero(some), np.int64(1 << 62)
    for j in range(FEW + 1):
        above = np.where(h > np.repeat(last, n[open_]), h, none)
        least = np.minimum.reduceat(above, np.concatenate([[0], np.cumsum(n[open_])[:-1]]))
        going = least < none
        if j == FEW:
            others[open_[going]] = True
            break
        out[open_[going]] = _end((out[open_[going]] ^ least[going].astype(np.uint64)) * _P1 + _P4)
        h, open_, last = h[np.repeat(going, n[open_])], open_[going], least[going]
        if not len(open_):
            break
    return out.view(np.int64), others


def _column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins; null is empty."""
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), offsets


def _groups(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Whole texts, up to a block of bytes and the text that exceeds it."""
    ends = np.unique(np.append(np.searchsorted(starts, np.arange(starts[0], starts[-1], _BLOCK)), [0, len(starts) - 1]))
    yield from zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)


def prints(text: Column, k: int) -> Column:
    """(fingerprint, sketch, few) of a text: simhash(), sketch() of the text in lower case, and few() or null."""

    @F.arrow_udf("fingerprint long, sketch array<long>, few long")
    def run(texts: pa.Array, lower: pa.Array) -> pa.Array:
        (data, at), (small, low_at) = _column(texts), _column(lower)
        found = [(np.zeros(0, np.int64), np.zeros((0, _LONGS), np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for i, j in _groups(at):
            h, upto = shingles(small[low_at[i] : low_at[j]], low_at[i : j + 1] - low_at[i], k)
            found.append((fingerprints(data[at[i] : at[j]], at[i : j + 1] - at[i], k), sketches(h, upto), *few(h, upto)))
        fps, flat, key, others = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * _LONGS, pa.int32()), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(fps), lists, pa.array(key, mask=others)], names=["fingerprint", "sketch", "few"])

    return run(F.coalesce(text, F.lit("")), F.lower(F.coalesce(text, F.lit(""))))


def distinct(text: Column, k: int) -> Column:
    """The distinct values of shingle_hashes() of the text in lower case, in ascending order."""

    @F.arrow_udf("array<long>")
    def run(texts: pa.Array) -> pa.Array:
        data, at = _column(texts)
        values, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for i, j in _groups(at):
            h, upto = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
            of = np.repeat(np.arange(j - i), np.diff(upto))
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
            values.append(h[new])
            sizes.append(np.bincount(of[new], minlength=j - i))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(values)))

    return run(F.lower(F.coalesce(text, F.lit(""))))
