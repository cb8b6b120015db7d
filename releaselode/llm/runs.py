"""Periodic runs of words: from longest previous factors to blocks, boundary extensions and bucketed copies.

A run is a stretch of words with smallest period q, as long as max(6, 4 q) at least, that can't be extended with that period.

1. The words of many documents are numbered, those of each document by numbers of its own, and their suffixes are sorted
   together by doubling the length that is compared (numpy); a suffix that is told apart from all others is done. A document
   whose suffixes all differ within four words has no run, since a run repeats five.
2. For the others: suffix array and common prefixes give, for each place, the longest factor that starts earlier too, and where.
3. Blocks: from the left, the longest previous factor, or one new word. A run that crosses or touches the start of the last block
   it reaches into (b, of the block before a, end e) starts after a - q, so 3 q < e - a; extensions of common prefixes and suffixes from b, for all q at once (Z values), find it.
   A run that only touches a block's end is found from there in the same way.
4. A run strictly inside a block is a copy of one inside the block's earlier occurrence. Runs are kept in buckets by start, and
   blocks are gone through from the left, so that the copied run is always known.

Every row depends on itself: no shuffle. Null or empty text: no word, no run, digests of nothing. A very long text is handled
whole in one task, in linear time after the sorting and some hundred bytes a word. Repeated rows: one result each; null keys stay
null, and such rows are planted with nothing. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, texts_of

#: Words of the documents whose suffixes are sorted together; a longer document is sorted alone.
TOGETHER = 1 << 18

Run = tuple[int, int, int]


class _Numbers(dict):
    def __init__(self, base: int):
        self.base = base

    def __missing__(self, k):
        v = self[k] = self.base + len(self)
        return v


def least(q: int) -> int:
    """Words of a run of period q."""
    return max(6, 4 * q)


def split_ranks(x: np.ndarray, stop: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix by its first 1, 2, 4 .. words, and the places not told apart (by `depth` words, or all).

    x: numbers of words; stop: end of each place's document. Of suffixes not told apart the rank is the smallest of them."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(x[order]) != 0)) if n else order
    sizes = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, sizes)
    live, done = order[np.repeat(sizes, sizes) > 1], 1
    while len(live) and (depth is None or done < depth):
        ahead = live + done
        inside = ahead < stop[live]
        later = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + later
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        group = rank[live]
        first = np.append(True, np.diff(key) != 0)
        old = np.append(True, np.diff(group) != 0)
        at = np.arange(len(live))
        new = group + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        sizes = np.diff(np.append(np.flatnonzero(first), len(live)))
        rank[live] = new
        live, done = live[np.repeat(sizes, sizes) > 1], 2 * done
    return rank, live


def previous_factors(x: array, rank: array) -> tuple[array, array]:
    """Length of the longest factor at each place that starts earlier as well, and where it starts."""
    n = len(x)
    sa = array("i", bytes(4 * n))
    for i, r in enumerate(rank):
        sa[r] = i
    lcp = array("i", bytes(4 * (n + 1)))  # of each suffix with the one before it in order
    h = 0
    for i in range(n):
        if r := rank[i]:
            j = sa[r - 1]
            most = n - max(i, j)
            while h < most and x[i + h] == x[j + h]:
                h += 1
            lcp[r] = h
            h -= h > 0
        else:
            h = 0
    # places are taken out from the last on, so that neighbours in order start earlier
    size, source = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n))
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b, low, high = before[r], after[r], lcp[r], 0
        if b < n:
            high = lcp[b]
            before[b] = a
            if low < high:
                lcp[b] = low
        if a >= 0:
            after[a] = b
        if low >= high:
            size[i], source[i] = low, sa[a] if low else 0
        else:
            size[i], source[i] = high, sa[b]
    return size, source


def blocks_of(size: array) -> list[int]:
    """Starts of the blocks, and the end."""
    out, i = [0], 0
    while i < len(size):
        i += size[i] or 1
        out.append(i)
    return out


def z_values(s: list[int] | array) -> list[int]:
    """Common prefix of s and each of its suffixes; of s itself 0."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def extensions(x: array, a: int, b: int, e: int) -> Iterator[Run]:
    """Runs (start, end, period) over the boundary b that end within e, where the block before b starts at a; some periods may be multiples."""
    most = (e - a - 1) // 3
    low, high = max(0, a - most), min(len(x), e + 1)
    ahead = x[b:high]
    back = x[low:b]
    back.reverse()
    whole_back = x[low : min(b + most, high)]
    whole_back.reverse()
    # common prefixes with what starts at b, and common suffixes with what ends there; -1 stands between
    gap = array("i", (-1,))
    forward = z_values(ahead + gap + x[max(low, b - most) : high])
    backward = z_values(back + gap + whole_back)
    shift = len(ahead) + 1 + b - max(low, b - most)
    turn = len(back) + 1 + len(whole_back) - len(back)
    for q in range(1, most + 1):
        if q <= b - low:  # the q words before b belong to it
            end = b + forward[shift - q]
            start = b - q - (backward[q] if q < len(back) else 0)
            if b < end <= e and end - start >= least(q):
                yield start, end, q
        if q < len(ahead):  # the q words from b on do
            end = b + q + forward[q]
            start = b - backward[turn - q]
            if end <= e and end - start >= least(q):
                yield start, end, q


def endings(x: array, b: int, e: int) -> Iterator[Run]:
    """Runs that end with the block from b to e and start inside it."""
    back = x[b:e]
    back.reverse()
    same = z_values(back)
    for q in range(1, (e - b) // 4 + 1):
        start = e - q - same[q]
        if start > b and e - start >= least(q) and (e == len(x) or x[e] != x[e - q]):
            yield start, e, q


def runs_of(x: array, rank: array) -> list[Run]:
    """All runs of a document as (start, length, period), by start and period."""
    size, source = previous_factors(x, rank)
    starts = blocks_of(size)
    found: dict[Run, int] = {}
    a = 0
    for b, e in zip(starts, starts[1:], strict=False):
        if e - a >= 6:
            for s, z, q in extensions(x, a, b, e):
                found[s, z] = min(q, found.get((s, z), q))
        if e - b > 6:
            for s, z, q in endings(x, b, e):
                found[s, z] = min(q, found.get((s, z), q))
        a = b
    if not found:
        return []
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (s, z), q in found.items():
        buckets.setdefault(s, []).append((z, q))
    for b, e in zip(starts, starts[1:], strict=False):
        if e - b < 8:
            continue
        back = b - source[b]
        for s in range(b + 1, e - 6):
            for z, q in buckets.get(s - back, ()):
                if z + back < e:
                    buckets.setdefault(s, []).append((z + back, q))
    return sorted((s, z - s, q) for s, some in buckets.items() for z, q in some)


def find_runs(texts: list[list]) -> list[list[Run]]:
    """Of each document, given as words."""
    out: list[list[Run]] = [[] for _ in texts]

    def together(some: list[int]) -> None:
        def numbered(docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x, base = [], 0
            for i in docs:
                d = _Numbers(base)
                x.append(np.fromiter(map(d.__getitem__, texts[i]), np.int64, len(texts[i])))
                base += len(d)
            ends = np.cumsum([len(p) for p in x])
            return np.concatenate(x), ends, np.repeat(ends, [len(p) for p in x])

        x, ends, stop = numbered(some)
        repeating = np.unique(np.searchsorted(ends, split_ranks(x, stop, 4)[1], "right")).tolist()
        if not repeating:
            return
        some = [some[k] for k in repeating]
        x, ends, stop = numbered(some)
        rank, _ = split_ranks(x, stop)
        begin = 0
        for i, end in zip(some, ends.tolist(), strict=True):
            # ranks of one document among themselves
            own = np.empty(end - begin, np.int32)
            own[np.argsort(rank[begin:end])] = np.arange(end - begin, dtype=np.int32)
            out[i] = runs_of(array("i", x[begin:end].astype(np.int32).tobytes()), array("i", own.tobytes()))
            begin = end

    held, many = [], 0
    for i, words in enumerate(texts):
        if len(words) < 6:
            continue
        if held and many + len(words) > TOGETHER:
            together(held)
            held, many = [], 0
        held.append(i)
        many += len(words)
    if held:
        together(held)
    return out


def dropped(n: int, runs: list[Run]) -> list[tuple[int, int]]:
    """Stretches of words that a run repeats, merged."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((s + q, s + size) for s, size, q in runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def planted_words(key: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by CRC-32 of its key in decimal, goes on from some word on with its words of one period."""
    if key is None or not words:
        return words
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None, full: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the run with the greatest exponent), runs_sha256, collapsed_sha256.

    full: runs array<struct<start,length,period>> and collapsed string (the words that no run repeats) too. `change` is applied to the words."""
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" + f", runs {kind}, collapsed string" * full
    names = [c.split()[0] for c in schema.split(", ")]
    struct = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    types = [*[pa.int64()] * 6, pa.string(), pa.string(), struct, pa.string()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = b.column(0).to_pylist()
            texts = [t.split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            if change:
                texts = [change(k, t) for k, t in zip(keys, texts, strict=True)]
            rows = []
            for key, words, found in zip(keys, texts, find_runs(texts), strict=True):
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
                kept, at = [], 0
                for a, z in dropped(len(words), found):
                    kept += words[at:a]
                    at = z
                text = b" ".join(kept + words[at:] if at else words)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
                row = (key, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())
                rows.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in found], text.decode()) if full else row)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return map_arrow(texts_of(docs), run, schema)
