"""Suffix-array dedup: removes every byte that lies in a string of `width` bytes which also starts earlier.

Earlier: in a document of smaller key, or at a smaller place of the same document. Strings are judged on the input.

1. Cutting. Each string of `width` bytes has an anchor, the leftmost smallest of its grams of `gram` bytes by hash; equal
   strings have equal anchors at equal places. A segment is a run of strings with one anchor in the text, at most
   2 * width bytes. Segments are dealt in packed blocks by ranges of the anchor's hash; one whose anchor no other has holds
   no repeat. Hashes choose what is compared, they decide no equality.
2. Segments whose bytes equal an earlier one's are all repeats. Within a task their bytes are compared. Else the documents are asked
   once more for those that share an anchor: the first of each kind, where kinds differ, sends its bytes and the others a
   cryptographic digest of theirs, 16 bytes of BLAKE2b. Should a digest belong to no such first one, all send their bytes. So
   copies, of documents or of passages that thousands of documents share, cost little. Segments that differ are cut into windows of `reach` places of the anchor, and
   windows with equal bytes collapse likewise. An anchor with very many segments is split: its windows are dealt by their
   core, the bytes that all strings of the window share.
3. Windows that share a core but differ go through a generalized suffix array, built column by column from all their bytes:
   the Burrows-Wheeler transform and the common prefixes of the collection start from the windows' ends; each round inserts
   the next symbol of every window, that is one suffix each, at the place that the transform's ranks give, and sets
   the two common prefixes beside it. All arrays lie in files of the task's own temporary folder, which are read and
   written in sequence, block by block; only one block, and a few numbers for each window, are in memory. Suffixes whose
   common prefixes reach `width` are equal strings.
4. The repeats of each document are merged to runs and cut out.

Texts are UTF-8 bytes; null: empty. Texts shorter than `width` are kept whole. A very long text is one array of its bytes and a
few numbers of 8 bytes for each of them in the task that cuts it. Rows of one key and one text are one document, of
which each row keeps the same bytes. Of different texts with one key, that with the smaller hash counts as earlier; a null key
is smaller than all others. Empty table: no row. Other columns are ignored (cut_texts keeps them)."""

from __future__ import annotations

import contextlib
import hashlib
import struct
import tempfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored, texts_of

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_LUT = np.random.default_rng(20240521).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 20)
            for name, base in (("up", BASE), ("down", _UNBASE)):
                p = np.full(self.n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the documents data[starts:ends]: (document, first string, strings, place of the anchor in the segment, anchor's hash, hash of the bytes) of each segment."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < width:
        return none
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LUT[data] * up[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width - gram + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - gram + 1 - size
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the string at each place
    counts = np.maximum(ends - starts - width + 1, 0)
    doc = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    if not len(doc):
        return none
    anchor = at[place]
    head = np.concatenate([[0], np.flatnonzero((np.diff(anchor) != 0) | (np.diff(doc) != 0)) + 1])
    first, many = place[head], np.diff(np.append(head, len(doc)))
    stop = first + many + width - 1
    body = _mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    return doc[head], first - starts[doc[head]], many, anchor[head] - first, _mix(grams[anchor[head]]), body


#: What is asked of a segment: it is the first of its kind; its bytes and not their digest; these by windows.
HEAD, BODY, WINDOWS = 1, 2, 4
#: Columns of a block of strings to remove; of segments; and of segments whose bytes are asked for.
GONE, SEGMENT, ASKED = ["<u4", "u1"], ["<u4", "u1", "u1", "<u4", "<u8"], ["<u4", "u1", "u1", "<u4", "<u4", "u1"]


def _blocks(doc: np.ndarray, to: np.ndarray, columns: list[np.ndarray], kinds: list[str]) -> Iterator[tuple[int, bytes]]:
    """(to, block) for each value of `to`; rows of one document stay together."""
    order = np.lexsort((doc, to))
    doc, to, columns = doc[order], to[order], [c[order].astype(k) for c, k in zip(columns, kinds, strict=True)]
    cuts = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield int(to[a]), _pack(doc[a:z], *(c[a:z] for c in columns))


def _pack(doc: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of a block; the documents as a list of their own, since a block has a few rows of each."""
    heads = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    per = np.diff(np.append(heads, len(doc))).astype("<u4")
    return struct.pack("<II", len(heads), len(doc)) + doc[heads].astype("<i8").tobytes() + per.tobytes() + b"".join(c.tobytes() for c in columns)


def _unpack(blocks: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    out = []
    for block in blocks:
        k, n = struct.unpack_from("<II", block)
        ids, per = np.frombuffer(block, "<i8", k, 8), np.frombuffer(block, "<u4", k, 8 + 8 * k)
        row, at = [np.repeat(ids, per)], 8 + 12 * k
        for kind in kinds:
            row.append(np.frombuffer(block, kind, n, at))
            at += n * np.dtype(kind).itemsize
        out.append(row)
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal keys."""
    head = np.ones(len(keys[0]), bool)
    head[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return head


def _again(head: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True at the rows of each run that start elsewhere than its first: a repeated row's string is that one itself."""
    kept = np.flatnonzero(head)[np.cumsum(head) - 1]
    return (doc != doc[kept]) | (first != first[kept])


def _frame(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "part", "block"])


def dealt_segments(docs: DataFrame, width: int, gram: int, ranges: int, groups: int) -> DataFrame:
    """kind 1: segments, part by range of the anchor's hash. kind 0: strings to remove, part by document.

    Of segments with equal bytes in one block only the earliest goes on, so no anchor is hot in the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        rows_held = bytes_held = 0

        def close() -> pa.RecordBatch:
            nonlocal held, texts, rows_held, bytes_held
            doc, first, many, off, anchor, body, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((first, doc, body, anchor))
            doc, first, many, off, anchor, body, at = (c[order] for c in (doc, first, many, off, anchor, body, at))
            head = _runs(anchor, body)
            kept = np.flatnonzero(head)[np.cumsum(head) - 1]
            like = np.flatnonzero(~head)
            raw = b"".join(texts)
            size = (many + width - 1)[like].tolist()
            same = np.array([raw[a : a + n] == raw[b : b + n] for a, b, n in zip(at[like].tolist(), at[kept[like]].tolist(), size, strict=True)], bool)
            go_on = head.copy()
            go_on[like[~same]] = True  # equal by hash only
            again = like[same]
            again = again[(doc != doc[kept])[again] | (first != first[kept])[again]]  # else it is a repeated row's, that is the same string
            out = [(0, g, x) for g, x in _blocks(doc[again], _group(doc[again], groups), [first[again], many[again]], GONE)]
            doc, first, many, off, anchor, body = (c[go_on] for c in (doc, first, many, off, anchor, body))
            part = (((anchor >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            out += [(1, p, x) for p, x in _blocks(doc, part, [first, many, off, anchor & np.uint64(0xFFFFFFFF), body], SEGMENT)]
            held, texts, rows_held, bytes_held = [], [], 0, 0
            return _frame(out)

        for b in slices(batches, 40):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            sizes = np.array([len(r) for r in raw], np.int64)
            ends = np.cumsum(sizes)
            data = b"".join(raw)
            doc, first, *rest = segments(np.frombuffer(data, np.uint8), ends - sizes, ends, width, gram)
            held.append((b.column(0).to_numpy()[doc], first, *rest, first + (ends - sizes)[doc] + bytes_held))
            texts.append(data)
            rows_held += len(doc)
            bytes_held += len(data)
            if rows_held > 250_000:
                yield close()
        if rows_held:
            yield close()

    return map_arrow(docs, run, "kind int, part int, block binary")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    now, blocks = None, []
    for b in batches:
        for kind, part, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (kind, part) != now and blocks:
                yield *now, blocks
                blocks = []
            now = (kind, part)
            blocks.append(x)
    if blocks:
        yield *now, blocks


def shared_segments(dealt: DataFrame, groups: int, hot: int) -> DataFrame:
    """kind 0: strings to remove. kind 2: segments that share an anchor, to be compared; part by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part, blocks in _by_part(batches):
            if kind == 0:
                yield _frame([(0, part, x) for x in blocks])
                continue
            doc, first, many, off, anchor, body = _unpack(blocks, SEGMENT)
            order = np.lexsort((first, doc, body, anchor))
            doc, first, many, off, anchor, body = (c[order] for c in (doc, first, many, off, anchor, body))
            number = np.cumsum(_runs(anchor)) - 1
            head = _runs(anchor, body)
            ask = np.bincount(number)[number] > 1
            kinds = np.bincount(number, head)[number]
            say = HEAD * head + BODY * (head & (kinds > 1)) + WINDOWS * (kinds > hot)
            doc, first, many, off, anchor, say = (c[ask] for c in (doc, first, many, off, anchor, say))
            out = [(2, g, x) for g, x in _blocks(doc, _group(doc, groups), [first, many, off, anchor, np.full(len(doc), part), say], ASKED)]
            if out:
                yield _frame(out)

    return map_arrow(dealt, run, "kind int, part int, block binary")


def asked_rows(blocks: DataFrame) -> DataFrame:
    """doc_id long, asked binary: the segments to compare of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _by_part(batches):
            doc, *rest = _unpack(x, ASKED)
            order = np.argsort(doc, kind="stable")
            rows = np.rec.fromarrays([c[order] for c in rest], names="first,many,off,anchor,part,say", formats=ASKED)
            cuts = np.flatnonzero(_runs(doc[order]))
            ends = np.append(cuts[1:], len(doc))
            for i in range(0, len(cuts), 4096):
                yield pa.record_batch([pa.array(doc[order][cuts[i : i + 4096]]), pa.array([rows[a:z].tobytes() for a, z in zip(cuts[i : i + 4096], ends[i : i + 4096], strict=True)], pa.binary())], names=["doc_id", "asked"])

    return map_arrow(blocks, run, "doc_id long, asked binary")


_ASKED = np.dtype(list(zip(("first", "many", "off", "anchor", "part", "say"), ASKED, strict=True)))


def windows(first: int, many: int, off: int, body: bytes, width: int, reach: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(first, many, off, bytes, core) of the strings of a segment at each `reach` consecutive distances from the anchor.

    All strings of a window hold its core, so only windows with equal cores can share one."""
    low = reach * -(-width // reach) - off  # distances are -width .. 0; this makes them positive
    for q in range(low // reach, (low + many - 1) // reach + 1):
        lo, hi = max(low, q * reach) - low, min(low + many - 1, q * reach + reach - 1) - low
        core = q * reach - low
        yield first + lo, hi - lo + 1, off - lo, body[lo : hi + width], body[core + reach - 1 : core + width]


def digest(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def segment_bytes(docs: DataFrame, asked: DataFrame, width: int, reach: int, ranges: int, digests: bool) -> DataFrame:
    """part int, doc_id long, first int, many int, off int, head boolean, digest binary, body binary; the last is null where only the digest was asked for.

    Segments of hot anchors also come as windows, dealt by their cores. Both sides are shuffled at any size, so that what
    this costs grows with the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "doc_id", "first", "many", "off", "head", "digest", "body"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        for b in slices(batches, 256):
            out: list[tuple] = []
            for doc, text, asked in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("asked").to_pylist(), strict=True):
                raw = text.encode()
                for first, many, off, _, part, say in np.frombuffer(asked, _ASKED).tolist():
                    body = raw[first : first + many + width - 1]
                    if say & WINDOWS and (say & BODY or not digests):
                        out += [(zlib.crc32(core) % ranges, doc, *w, True, digest(x), x) for *w, x, core in windows(first, many, off, body, width, reach)]
                    whole = (say & BODY or not digests) and not say & WINDOWS
                    out.append((part, doc, first, many, off, bool(say & HEAD) or not digests, digest(body), body if whole else None))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)

    rows = docs.join(asked.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "asked")
    return map_arrow(rows, run, "part int, doc_id long, first int, many int, off int, head boolean, digest binary, body binary")


#: Numbers of an array that are read at once.
BLOCK = 1 << 18


class _Files:
    """Arrays in files of one folder, read and rewritten in sequence, block by block."""

    def __init__(self, folder: str, kinds: dict[str, str], block: int):
        self.kinds, self.turn, self.block = kinds, 0, block
        self.files = {name: [open(Path(folder) / f"{name}.{i}", "w+b") for i in (0, 1)] for name in kinds}

    def close(self) -> None:
        for pair in self.files.values():
            for f in pair:
                f.close()

    def old(self, name: str):
        f = self.files[name][self.turn % 2]
        f.seek(0)
        return f

    def start(self, **arrays: np.ndarray) -> None:
        for name, x in arrays.items():
            x.astype(self.kinds[name]).tofile(self.old(name))

    def blocks(self, *names: str) -> Iterator[list[np.ndarray]]:
        files = [(self.old(n), np.dtype(self.kinds[n])) for n in names]
        while len((got := [np.frombuffer(f.read(self.block * k.itemsize), k) for f, k in files])[0]):
            yield got

    def merge(self, at: np.ndarray, fix: tuple[np.ndarray, np.ndarray], **new: np.ndarray) -> None:
        """Insert new values, which then stand at the ascending places `at`; afterwards set `lcp` at fix[0] to fix[1]."""
        for name, values in new.items():
            kind = np.dtype(self.kinds[name])
            old, out = self.old(name), self.files[name][(self.turn + 1) % 2]
            out.seek(0)
            base = done = 0
            while True:
                raw = np.frombuffer(old.read(self.block * kind.itemsize), kind)
                last = len(raw) < self.block
                # all new values that stand before the end of this block of old ones
                k = len(at) if last else int(np.searchsorted(at - np.arange(len(at)), base + len(raw), side="left"))
                block = np.empty(len(raw) + k - done, kind)
                start = base + done
                hole = np.zeros(len(block), bool)
                hole[at[done:k] - start] = True
                block[hole], block[~hole] = values[done:k], raw
                if name == "lcp":
                    a, z = np.searchsorted(fix[0], [start, start + len(block)])
                    block[fix[0][a:z] - start] = fix[1][a:z]
                out.write(block.data)
                base, done = base + len(raw), k
                if last:
                    break
        self.turn += 1


def _range_min(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Of values[a:z] for each pair, a < z."""
    pairs = np.stack([a, z], 1).reshape(-1)
    return np.minimum.reduceat(np.append(values, values.dtype.type(0)), pairs)[::2] if len(pairs) else np.zeros(0, np.int64)


def _scanned(f: _Files, place: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """One pass over the transform. Of the suffixes that its rows `place` (ascending) lead to: their rank among all that rows lead
    to, and the common prefix with the one before; and (ranks, common prefixes) of those that come right after them."""
    ahead = np.cumsum(counts) - counts  # all suffixes that begin with a smaller symbol; symbol 0 leads nowhere
    seen = np.zeros(256, np.int64)  # of each symbol, in the blocks before
    low = np.full(256, 255, np.int64)  # least common prefix since the symbol was last seen
    open_ = np.zeros(256, bool)  # whether it was last seen in one of the rows asked for
    ranks, prefixes, after, below = [], [], [], []
    base = done = 0
    for bwt, lcp in f.blocks("bwt", "lcp"):
        n = len(bwt)
        upto = int(np.searchsorted(place, base + n))
        row = place[done:upto] - base
        order = np.argsort(bwt, kind="stable")
        many = np.bincount(bwt, minlength=256)
        stop = np.cumsum(many)
        start = stop - many
        where = np.empty(n, np.int64)
        where[order] = np.arange(n)
        mine, c = where[row], bwt[row].astype(np.int64)
        rank = ahead[c] + seen[c] + mine - start[c]
        front, back = np.minimum.accumulate(lcp), np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
        prefix = np.zeros(len(row), np.int64)
        inside = mine > start[c]
        prefix[inside] = 1 + _range_min(lcp, order[mine[inside] - 1] + 1, row[inside] + 1)
        carried = ~inside & (seen[c] > 0)
        prefix[carried] = 1 + np.minimum(low[c[carried]], front[row[carried]])
        ranks.append(rank)
        prefixes.append(prefix)
        inside = mine + 1 < stop[c]
        after.append(rank[inside] + 1)
        below.append(1 + _range_min(lcp, row[inside] + 1, order[mine[inside] + 1] + 1))
        here = np.flatnonzero(many)
        late = here[open_[here]]
        after.append(ahead[late] + seen[late])
        below.append(1 + np.minimum(low[late], front[order[start[late]]]))
        last = order[stop[here] - 1]
        low = np.minimum(low, int(lcp.min()))
        low[here] = back[last + 1]
        asked = np.zeros(n, bool)
        asked[row] = True
        open_[here] = asked[last]
        seen += many
        base, done = base + n, upto
    rank, fix, value = np.concatenate(ranks), np.concatenate(after), np.concatenate(below)
    by = np.argsort(fix)
    return rank, np.concatenate(prefixes), (fix[by], value[by])


def suffix_order(symbols: np.ndarray, lengths: np.ndarray, folder: str, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text, length, common prefix with the one before) of all suffixes of a collection, in order.

    symbols: texts x columns, right-aligned, from 1 to 255, at most 254 columns. Texts are extended to the left by one column
    in each round; only that round's suffixes are inserted."""
    f = _Files(folder, {"bwt": "u1", "lcp": "u1", "text": "<u4", "size": "u1"}, block)
    with contextlib.closing(f):
        yield from _suffix_order(f, symbols, lengths)


def _suffix_order(f: _Files, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    m, columns = symbols.shape

    def before(text: np.ndarray, size: int) -> np.ndarray:
        """The symbol left of the suffix of that size, 0 where it is the whole text."""
        return np.where(lengths[text] > size, symbols[text, max(columns - 1 - size, 0)], 0).astype(np.uint8)

    text = np.arange(m)
    new = before(text, 0)
    f.start(bwt=new, lcp=np.zeros(m), text=text, size=np.zeros(m))
    counts = np.bincount(new, minlength=256)
    place = text  # where the last suffix of each text stands, ascending
    for size in range(1, int(lengths.max(initial=0)) + 1):
        alive = lengths[text] >= size
        text, place = text[alive], place[alive]
        leads = counts.copy()
        leads[0] = 0
        rank, prefix, fix = _scanned(f, place, leads)
        by = np.argsort(rank)
        text, place = text[by], m + rank[by]
        new = before(text, size)
        f.merge(place, (m + fix[0], fix[1]), bwt=new, lcp=prefix[by], text=text, size=np.full(len(text), size))
        counts += np.bincount(new, minlength=256)
    for got in f.blocks("text", "size", "lcp"):
        yield tuple(x.astype(np.int64) for x in got)


class Compared:
    """The comparison of one part's segments; rows come in ascending order of document and place."""

    def __init__(self, width: int, reach: int, block: int = BLOCK):
        self.width, self.reach, self.block = width, reach, block
        self.kept: dict[bytes, tuple[int, int, int, int, bytes | None]] = {}
        self.gone: list[tuple[int, int, int]] = []
        self.heads: set[bytes] = set()
        self.others: set[bytes] = set()

    def add(self, doc: int, first: int, many: int, off: int, head: bool, digest: bytes, body: bytes | None) -> None:
        """Equal bytes: all strings of the later segment are repeats, unless a repeated row holds the same segment."""
        (self.heads if head else self.others).add(digest)
        d, p, *_, known = self.kept.setdefault(digest, (doc, first, many, off, body))
        if (d, p) != (doc, first):
            self.gone.append((doc, first, many))
        elif known is None and body is not None:
            self.kept[digest] = (doc, first, many, off, body)

    @property
    def unknown(self) -> bool:
        """Whether a digest came that no first segment has."""
        return not self.others <= self.heads

    def repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (document, first, many) of the strings that start earlier in another segment."""
        pieces: dict[bytes, tuple[int, int, int]] = {}
        cores: dict[bytes, list[bytes]] = {}
        for doc, first, many, off, body in self.kept.values():
            if body is None:
                continue
            for p, n, _, x, core in windows(first, many, off, body, self.width, self.reach):
                d, at, _ = pieces.setdefault(x, (doc, p, n))
                if (d, at) != (doc, p):
                    self.gone.append((doc, p, n))
                else:
                    cores.setdefault(core, []).append(x)
        self.kept.clear()
        if self.gone:
            yield tuple(np.array(c, np.int64) for c in zip(*self.gone, strict=True))
        unlike = [x for group in cores.values() if len(group) > 1 for x in group]
        del cores
        if unlike:
            yield self._by_suffixes(unlike, [pieces[x] for x in unlike])

    def _by_suffixes(self, bodies: list[bytes], at: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        doc, where, many = (np.array(c, np.int64) for c in zip(*at, strict=True))
        lengths = many + self.width - 1
        symbols = np.zeros((len(bodies), int(lengths.max())), np.uint8)
        for i, x in enumerate(bodies):  # no byte of UTF-8 is 255, so bytes are lifted by one to keep 0 free
            symbols[i, len(symbols[i]) - len(x) :] = np.frombuffer(x, np.uint8)
            symbols[i, len(symbols[i]) - len(x) :] += 1
        runs, docs, places, run = [], [], [], 0
        with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
            for text, size, lcp in suffix_order(symbols, lengths, folder, self.block):
                number = run + np.cumsum(lcp < self.width)
                run = int(number[-1])
                start = lengths[text] - size
                string = (start < many[text]) & (size >= self.width)
                runs.append(number[string])
                docs.append(doc[text[string]])
                places.append(where[text[string]] + start[string])
        run_of, d, p = np.concatenate(runs), np.concatenate(docs), np.concatenate(places)
        order = np.lexsort((p, d, run_of))
        run_of, d, p = run_of[order], d[order], p[order]
        again = _again(_runs(run_of), d, p)
        return d[again], p[again], np.ones(int(again.sum()), np.int64)


def compared(rows: DataFrame, width: int, reach: int, groups: int, block: int) -> DataFrame:
    """kind 0: strings to remove, by the comparison of the segments of each part. kind 3: a digest has no first segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Compared(width, reach, block)

        def done() -> Iterator[pa.RecordBatch]:
            if held.unknown:
                yield _frame([(3, 0, b"")])
            for d, p, n in held.repeats():
                yield _frame([(0, g, x) for g, x in _blocks(d, _group(d, groups), [p, n], GONE)])

        for b in batches:
            for part, *segment in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    yield from done()
                    now, held = part, Compared(width, reach, block)
                held.add(*segment)
        yield from done()

    return map_arrow(rows, run, "kind int, part int, block binary")


def removed_runs(blocks: DataFrame, width: int) -> DataFrame:
    """doc_id long, runs binary: maximal removed runs, as pairs of 8-byte numbers (from, to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x in _by_part(batches):
            doc, first, many = _unpack(x, GONE)
            order = np.lexsort((first, doc))
            doc, a = doc[order], first[order].astype(np.int64)
            z = a + many[order] + width - 1
            # ends as running maxima within documents: lift each document above the one before
            lift = (np.cumsum(_runs(doc)) - 1) * (int(z.max()) + width + 1)
            top = np.maximum.accumulate(z + lift)
            head = np.ones(len(doc), bool)
            head[1:] = (a + lift)[1:] > top[:-1]
            i = np.flatnonzero(head)
            ends = np.append(i[1:], len(doc)) - 1
            pairs = np.stack([a[i], top[ends] - lift[ends]], 1).astype("<i8")
            owner = doc[i]
            cuts = np.flatnonzero(_runs(owner))
            stops = np.append(cuts[1:], len(owner))
            yield pa.record_batch([pa.array(owner[cuts]), pa.array([pairs[p:q].tobytes() for p, q in zip(cuts, stops, strict=True)], pa.binary())], names=["doc_id", "runs"])

    return map_arrow(blocks, run, "doc_id long, runs binary")


def _light(df: DataFrame, column: str, most: int = 24 << 20) -> DataFrame:
    """df, to be broadcast if its bytes are few; df is stored."""
    total = df.agg(F.sum(F.length(column) + 32).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= most else df


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `_number` long, which names a document by key and text and follows the order of keys.

    It is the key where keys are unique; else keys and hashes of texts are sorted by ranges and numbered."""
    key, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    plain = docs.groupBy(key.alias("k")).agg(F.count("*").alias("c")).where("c > 1 or k is null").isEmpty()
    if plain:
        return docs.withColumn("_number", key)
    marked = docs.withColumns({"_k": key, "_h": F.xxhash64(text)})
    # numbers ascend with the sorted ranges; the table is stored, so they stay as they are
    numbers = stored(marked.select("_k", "_h").distinct().orderBy(F.col("_k").asc_nulls_first(), "_h").withColumn("_number", F.monotonically_increasing_id()), "numbered-keys")
    numbers = numbers.select(F.col("_k").alias("_k2"), F.col("_h").alias("_h2"), "_number")
    return marked.join(numbers, marked["_k"].eqNullSafe(numbers["_k2"]) & (marked["_h"] == numbers["_h2"])).select(*docs.columns, "_number")


def repeated_runs(docs: DataFrame, width: int = 100, gram: int = 32, reach: int = 8, range_bytes: int = 4 << 20, hot: int = 512, block: int = BLOCK) -> DataFrame:
    """Stored doc_id long, runs binary, for the documents of docs(doc_id, text) from which something is to be removed."""
    if width + reach > 255:
        raise ValueError("common prefixes are kept in one byte")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    ranges = max(1, -(-(total["b"] or 0) // range_bytes))
    groups = max(1, -(-total["n"] // 16_384))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt_segments(docs, width, gram, ranges, groups).repartition(max(1, min(ranges + groups, 2 * parts)), "kind", "part").sortWithinPartitions("kind", "part")
    found = stored(shared_segments(dealt, groups, hot), "segments")
    ask = found.where("kind = 2").repartition(max(1, min(groups, parts)), "part").sortWithinPartitions("kind", "part")
    asked = stored(asked_rows(ask), "asked-segments")
    rows = lambda digests: segment_bytes(docs, asked, width, reach, ranges, digests).repartition(max(1, min(ranges, 2 * parts)), "part").sortWithinPartitions("part", "doc_id", "first")
    more = stored(compared(rows(True), width, reach, groups, block), "compared")
    if not more.where("kind = 3").isEmpty():  # two kinds of segments have one hash
        more = stored(compared(rows(False), width, reach, groups, block), "compared-whole")
    gone = found.where("kind = 0").union(more.where("kind = 0"))
    return stored(removed_runs(gone.repartition(max(1, min(groups, parts)), "part").sortWithinPartitions("kind", "part"), width), "removed-runs")


def _with_runs(docs: DataFrame, width: int, options: dict) -> DataFrame:
    """docs with `_removed_runs`."""
    rows = keyed(docs)
    runs = repeated_runs(rows.select(F.col("_number").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), width, **options)
    found = _light(runs, "runs").select(F.col("doc_id").alias("_number"), F.col("runs").alias("_removed_runs"))
    return rows.join(found, "_number", "left").select(*docs.columns, "_removed_runs")


def _kept(raw: bytes, runs: np.ndarray) -> bytes:
    out, at = [], 0
    for a, z in runs.tolist():
        out.append(raw[at:a])
        at = z
    out.append(raw[at:])
    return b"".join(out)


def dedup_digest(docs: DataFrame, width: int = 100, **options) -> DataFrame:
    """doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            out = []
            for text, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, r = text.encode(), np.frombuffer(x or b"", "<i8").reshape(-1, 2)
                kept = _kept(raw, r)
                out.append((len(raw), len(raw) - len(kept), len(r), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_runs(texts_of(docs), width, options)
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, width: int = 100, **options) -> DataFrame:
    """docs with the repeated bytes cut out of `text`. A run is first narrowed to whole characters, so what is kept stays UTF-8."""
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = b.columns[:-1]
            cut = [t if x is None else _cut_text(t or "", x) for t, x in zip(columns[text].to_pylist(), b.columns[-1].to_pylist(), strict=True)]
            columns[text] = pa.array(cut, columns[text].type)
            yield pa.record_batch(columns, names=b.schema.names[:-1])

    return map_arrow(_with_runs(docs, width, options), run, docs.schema)


def _cut_text(text: str, runs: bytes) -> str:
    raw = text.encode()
    r = np.frombuffer(runs, "<i8").reshape(-1, 2).copy()
    for pair in r:
        while pair[0] < len(raw) and raw[pair[0]] & 0xC0 == 0x80:
            pair[0] += 1
        while pair[1] < len(raw) and pair[1] > pair[0] and raw[pair[1]] & 0xC0 == 0x80:
            pair[1] -= 1
    return _kept(raw, r[r[:, 1] > r[:, 0]]).decode()
