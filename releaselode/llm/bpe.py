"""Byte-level BPE by ranks: Spark higher-order functions fold the ranked merges over the bytes of distinct words.

The merges are an `aggregate` over a word's bytes (strings of one Latin-1 character for each byte): every step joins the
leftmost adjacent pair whose joint bytes have the lowest rank and looks up the two pairs beside it, in a literal map of
ranks. The map is dealt over buckets by CRC-32, since a lookup in a Spark map compares key by key. Decoding concatenates
the ids' byte pieces.

Order of work:
1. Texts are cut by the pattern into words. A chunk, that is a few megabytes of text of one task, becomes numbers of its own
   distinct words; they wait in a file of the shared folder, named by a digest of task, place and content. A repeated task writes the same
   file, or one of its own if its rows came in another order; ids that don't fit a chunk's words are an error, never wrong ids.
2. Only the distinct words of each chunk are shuffled, packed, by ranges of their hash. A word of all documents is one entry a
   chunk. Where they meet, words are made distinct once more and folded, so each distinct word of the corpus is folded once.
3. The ids go back by chunk, packed, and meet the chunk's file.

A word of more than `long_word` bytes (bases, unbroken junk) is merged with a heap in the same order in Python, since the
fold copies the word at each step, that is its size squared. Null or empty text: no id. A very long text is a chunk of its own.
Repeated rows: one result each; null keys stay null. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import get_file, map_arrow, put_file, scratch, slices, texts_of

BUCKETS = 1 << 14
NONE = 2**31 - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_table(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>>: constant, folded by the optimizer from one string."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for b, r in ranks.items():
        s = b.decode("latin-1")
        buckets[zlib.crc32(s.encode()) % BUCKETS][s] = r
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False, separators=(",", ":"))), "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(table: Column, s: Column) -> Column:
    bucket = F.element_at(table, (F.crc32(s.cast("binary")) % BUCKETS + 1).cast("int"))
    return F.coalesce(F.try_element_at(bucket, s), F.lit(NONE))


def fold_word(word: Column, table: Column) -> Column:
    """The ids of one word, array<int>."""

    def step(acc: Column, _: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def at(k: Column) -> Column:
            def merged(m: Column) -> Column:
                left = F.when(k > 1, F.array(_rank(table, F.concat(F.get(p, k - 2), m)))).otherwise(F.array().cast("array<int>"))
                right = F.when(k < F.size(r), F.array(_rank(table, F.concat(m, F.get(p, k + 1))))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, 1, k - 1), F.array(m), F.slice(p, k + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, 1, F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(r))).alias("r"),
                )

            return _let(F.concat(F.get(p, k - 1), F.get(p, k)), merged)

        return _let(F.array_min(r), lambda low: F.when((F.size(r) == 0) | (low == NONE), acc).otherwise(_let(F.array_position(r, low).cast("int"), at)))

    def run(p: Column) -> Column:
        n = F.size(p)
        first = F.struct(p.alias("p"), F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n), lambda a, b: F.when(b.isNotNull(), _rank(table, F.concat(a, b))).otherwise(NONE)).alias("r"))
        return F.aggregate(F.sequence(F.lit(2), n), first, step, lambda acc: F.transform(acc["p"], lambda x: _rank(table, x)))

    whole = lambda r: F.when((r != NONE) | (F.length(word) < 2), F.array(r)).otherwise(_let(F.split(word, ""), run))
    return _let(_rank(table, word), whole)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, with a heap of (rank, place) and linked neighbours."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts at i; 0 when it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (x := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (x, i, end[stop]))
        if (b := before[i]) >= 0 and (x := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (x, b, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Numbers(dict):
    def __missing__(self, k):
        v = self[k] = len(self)
        return v


def packed(*arrays: np.ndarray | bytes) -> bytes:
    """The arrays, each behind its size in bytes."""
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return b"".join(y for x in parts for y in (struct.pack("<Q", len(x)), x))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = struct.unpack_from("<Q", data, at)[0]
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .., as one array."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _cut(blob: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [blob[a:z] for a, z in zip([0, *ends], ends, strict=False)]


def letter_runs(find) -> bool:
    """Whether the pattern keeps ASCII letters together, with the space before them: true if it does so for any two."""
    pairs = [a + b for a in string.ascii_letters for b in string.ascii_letters]
    return all(find(x) == [x] for p in pairs for x in (p, " " + p))


def chunk_path(folder: str, chunk: int) -> str:
    return f"{folder}/chunk-{chunk:016x}"


#: Arrays of a chunk's file: keys, whether they are null, units of each text, the unit at each place, words of each unit, these words' numbers.
CHUNK = ("<i8", "u1", "<i4", "<i4", "<i4", "<i4")


def dealt_words(docs: DataFrame, folder: str, pattern: str, chunk_bytes: int, ranges: int) -> DataFrame:
    """part int, chunk long, block binary: the distinct words of each chunk by range of hash; the chunk itself goes to a file.

    A unit is what stands between single spaces and line feeds, where the pattern always cuts, with the space before it; a
    text with other white space is one unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        runs = letter_runs(find)
        base, serial, size = TaskContext.get().partitionId() << 24, 0, 0
        keys: list[int | None] = []
        spans: list[list[int]] = []
        names: list[str] = []

        class Units(dict):
            def __init__(self, lead: str, whole: bool = False):
                self.lead, self.whole = lead, whole

            def __missing__(self, w: str) -> int:
                if not self.whole and (not w or w[0].isspace() or w[-1].isspace()):
                    raise KeyError(w)
                n = self[w] = len(names)
                names.append(self.lead + w)
                return n

        def fresh() -> None:
            nonlocal first, spaced, whole
            keys.clear()
            spans.clear()
            names.clear()
            names.append("\n")
            first, spaced, whole = Units(""), Units(" "), Units("", True)

        first = spaced = whole = Units("")
        fresh()

        def numbers(text: str) -> list[int]:
            try:
                out: list[int] = []
                for i, line in enumerate(text.split("\n")):
                    if i:
                        out.append(0)
                    ws = line.split(" ")
                    out.append(first[ws[0]])
                    if len(ws) > 1:
                        del ws[0]
                        out.extend(map(spaced.__getitem__, ws))
                return out
            except KeyError:  # white space that isn't single
                return [whole[text]]

        def close() -> pa.RecordBatch:
            nonlocal serial
            words = _Numbers()
            found = [[words[x]] if runs and x.isascii() and x[1:].isalpha() and (x[0] == " " or x[0].isalpha()) else [words[w] for w in find(x)] for x in names]
            raw = [w.encode() for w in words]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
            order = np.argsort(hashes, kind="stable")
            number = np.empty(len(raw), np.int32)
            number[order] = np.arange(len(raw), dtype=np.int32)
            per = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((x for f in found for x in f), np.int32, int(per.sum()))
            places = np.concatenate([np.array(s, np.int32) for s in spans])
            counts = np.fromiter(map(len, spans), np.int32, len(spans))
            content = packed(np.array([k or 0 for k in keys], "<i8"), np.array([k is None for k in keys], "u1"), counts, places, per, number[flat])
            # the words go into the digest too: chunks with other words but equal numbers differ
            mark = xxhash.xxh3_64(content, seed=base + serial)
            mark.update(hashes[order].tobytes())
            chunk = mark.intdigest() >> 1
            put_file(chunk_path(folder, chunk), [_pressed(content)])
            part = (((hashes[order] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(raw)]
            rows = []
            for a, z in zip(cuts, cuts[1:], strict=False):
                some = [raw[i] for i in order[a:z].tolist()]
                rows.append((int(part[a]), chunk, _pressed(packed(np.fromiter(map(len, some), "<i4", len(some)), b"".join(some)))))
            serial += 1
            fresh()
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "chunk", "block"])

        for b in slices(batches):
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                spans.append(numbers(text) if text else [])
                size += len(text)
                if size >= chunk_bytes:
                    size = 0
                    yield close()
        if keys:
            yield close()

    return map_arrow(texts_of(docs), run, "part int, chunk long, block binary")


def _pressed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def met_words(dealt: DataFrame, long_word: int) -> DataFrame:
    """One row for each part: words array<string> and long array<binary>, distinct; chunks, sizes, refs binary: which of them each chunk has.

    The long ones are numbered after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            words = _Numbers()
            refs = [np.fromiter(map(words.__getitem__, _cut(blob.tobytes(), sizes)), np.int32, len(sizes)) for sizes, blob in (unpacked(_plain(x), "<i4", "u1") for _, x in held)]
            raw = list(words)
            is_long = np.fromiter((len(w) > long_word for w in raw), bool, len(raw))
            order = np.argsort(is_long, kind="stable")
            number = np.empty(len(raw), np.int32)
            number[order] = np.arange(len(raw), dtype=np.int32)
            row = [
                pa.array([now], pa.int32()), pa.array([[raw[i].decode("latin-1") for i in order if not is_long[i]]], pa.list_(pa.string())), pa.array([[raw[i] for i in order if is_long[i]]], pa.list_(pa.binary())),
                *(pa.array([x], pa.binary()) for x in (np.array([k for k, _ in held], "<i8").tobytes(), np.array([len(r) for r in refs], "<i4").tobytes(), number[np.concatenate(refs)].tobytes() if raw else b"")),
            ]
            return pa.record_batch(row, names=["part", "words", "long", "chunks", "sizes", "refs"])

        now, held = None, []
        for b in batches:
            for part, chunk, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now and held:
                    yield done()
                    held = []
                now = part
                held.append((chunk, x))
        if held:
            yield done()

    return map_arrow(dealt, run, "part int, words array<string>, long array<binary>, chunks binary, sizes binary, refs binary")


def replies(folded: DataFrame, ranks_path: str) -> DataFrame:
    """chunk long, part int, block binary: the ids of each of the chunk's words, in the order in which they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            for i in range(b.num_rows):
                part, lists, far = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].as_py()
                if far and not known:
                    known = load_ranks(ranks_path)
                far = [merge_long(w, known) for w in far]
                sizes = np.concatenate([np.diff(lists.offsets.to_numpy()), [len(x) for x in far]]).astype(np.int64)
                values = np.concatenate([lists.flatten().to_numpy(), *(np.array(x, np.int32) for x in far)]).astype("<i4")
                starts = np.cumsum(sizes) - sizes
                chunks, many, refs = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in ((3, "<i8"), (4, "<i4"), (5, "<i4")))
                stops = np.cumsum(many)
                out = []
                for a, z in zip((stops - many).tolist(), stops.tolist(), strict=True):
                    at = refs[a:z]
                    out.append(_pressed(packed(sizes[at].astype("<i4"), values[_ranges(starts[at], sizes[at])])))
                yield pa.record_batch([pa.array(chunks), pa.array([part] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["chunk", "part", "block"])

    return map_arrow(folded, run, "chunk long, part int, block binary")


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str, chunk_bytes: int = 12 << 20, long_word: int = 256, with_ids: bool = True) -> DataFrame:
    """doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string; with_ids: ids binary (4 bytes each, little-endian)."""
    spark, ranks = docs.sparkSession, load_ranks(ranks_path)
    folder = scratch(spark, "word-chunks")
    total = docs.agg(F.sum(F.octet_length(docs["text"].cast("string"))).alias("b")).first()["b"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // chunk_bytes))
    dealt = dealt_words(docs, folder, pattern, chunk_bytes, ranges).repartition(max(1, min(ranges, 4 * parts)), "part").sortWithinPartitions("part", "chunk")
    merged = F.get(F.transform(F.array(rank_table(ranks)), lambda t: F.transform("words", lambda w: fold_word(w, t))), F.lit(0))
    answers = replies(met_words(dealt, long_word).select("part", merged.alias("ids"), "long", "chunks", "sizes", "refs"), ranks_path)
    answers = answers.repartition(max(1, min(ranges, parts)), "chunk").sortWithinPartitions("chunk", "part")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load_ranks(ranks_path)
        piece = [b""] * (max(known.values(), default=-1) + 1)
        for b, r in known.items():
            piece[r] = b

        def done() -> Iterator[pa.RecordBatch]:
            got = [unpacked(_plain(x), "<i4", "<i4") for x in held]
            sizes, values = (np.concatenate(c) for c in zip(*got, strict=True))
            starts = np.cumsum(sizes, dtype=np.int64) - sizes
            keys, null, counts, places, per, words = unpacked(_plain(get_file(chunk_path(folder, now))), *CHUNK)
            if len(sizes) != int(words.max(initial=-1)) + 1:
                raise RuntimeError("a chunk was cut again in another order while its words were on their way; run the query again")
            # ids of each unit, from those of its words
            unit_ids = values[_ranges(starts[words], sizes[words].astype(np.int64))].astype("<u4")
            ends = np.append(0, np.cumsum(sizes[words], dtype=np.int64))[np.cumsum(per, dtype=np.int64)] if len(per) else np.zeros(0, np.int64)
            unit_sizes = np.diff(ends, prepend=0)
            unit_starts = ends - unit_sizes
            done_ = 0
            for j in range(0, len(keys), 512):
                part = counts[j : j + 512].astype(np.int64)
                at = places[done_ : done_ + int(part.sum())]
                done_ += len(at)
                n = unit_sizes[at]
                ids = unit_ids[_ranges(unit_starts[at], n)]
                stops = np.append(0, np.cumsum(n))[np.cumsum(part)].tolist()
                out = []
                for a, z in zip([0, *stops], stops, strict=False):
                    raw = ids[a:z].tobytes()
                    text = b"".join(map(piece.__getitem__, ids[a:z].tolist()))
                    out.append((z - a, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest(), raw)[: 3 + with_ids])
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array(keys[j : j + 512], mask=null[j : j + 512].astype(bool)), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False))], names=names)

        now, held = None, []
        for b in batches:
            for chunk, _, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now and held:
                    yield from done()
                    held = []
                now = chunk
                held.append(x)
        if held:
            yield from done()

    return map_arrow(answers, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
