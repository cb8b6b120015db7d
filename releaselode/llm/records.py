"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A record is: length (8 bytes), masked CRC-32C of these 8 bytes, data, masked CRC-32C of the data; all numbers are
little-endian. The data are: document key (8 bytes), number of ids (4), bytes per id (1, that is 2 or 4), the ids.
`<shard>.rec` holds the records of consecutive keys in ascending order, `<shard>.idx` one row of (key, byte offset,
record bytes, ids) for each. The table of all offsets serves shuffled reads: `shuffled_records` draws an order and reads
each record alone at its offset.

Every text is tokenized once, in the partitions of the scan. Only packed ids are shuffled, by ranges of keys, one range
for each task; a task cuts its range into shards of a fixed number of rows however skewed sources or texts are. Files
are written under a temporary name and renamed, so a task may be repeated.

The string of an added token in a text (<|endoftext|>) is that token, as in the library. Null or empty text: a record of
the end id alone. A very long text is one record; a task holds the records of one shard. Repeated keys: one record each, in
the order of their ids. Null keys come first and are written as the smallest 64-bit number, which no key may be. Empty
table: no file, no row. Other columns are ignored."""

from __future__ import annotations

import contextlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, filesystem, get_file, map_arrow, put_file, scratch, slices, stored, texts_of, tokenizer_path

#: The reversed CRC-32C polynomial, and the constant added by masking (fixed values of the record format).
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
BLOCK = 256


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_T = _table()
#: The same for two bytes at once.
_T2 = _T[(_T[np.arange(1 << 16) & 0xFF] ^ (np.arange(1 << 16) >> 8).astype(np.uint32)) & 0xFF] ^ (_T[np.arange(1 << 16) & 0xFF] >> np.uint32(8))


def _shift_tables(n: int) -> np.ndarray:
    """Four tables of 256: the state after n zero bytes, by the state's bytes."""
    s = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(n):
        s = _T[s & 0xFF] ^ (s >> np.uint32(8))
    return s.reshape(4, 256)


_SHIFT = _shift_tables(BLOCK)


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each. Blocks of all parts advance together, then each part's blocks are combined."""
    n = len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    heads = sizes % BLOCK  # the first block of a part is the short one
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
    order = np.argsort(-heads, kind="stable")
    live = np.searchsorted(-heads[order], -np.arange(BLOCK), side="left")  # how many have heads > k
    for k in range(int(heads.max(initial=0))):
        i = order[: live[k]]
        state[i] = _T[(state[i] ^ data[starts[i] + k]) & 0xFF] ^ (state[i] >> np.uint32(8))
    blocks = sizes // BLOCK
    total = int(blocks.sum())
    if total:
        owner = np.repeat(np.arange(n), blocks)
        within = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = (starts + heads)[owner] + within * BLOCK
        part = np.zeros(total, np.uint32)
        pairs = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, BLOCK)[at].view("<u2").T)
        for two in pairs:
            part = _T2[(part & np.uint32(0xFFFF)) ^ two] ^ (part >> np.uint32(16))
        first = np.cumsum(blocks) - blocks
        order = np.argsort(-blocks, kind="stable")
        live = np.searchsorted(-blocks[order], -np.arange(int(blocks.max()) + 1), side="left")
        for k in range(int(blocks.max())):
            i = order[: live[k]]
            s = state[i]
            state[i] = _SHIFT[0][s & 0xFF] ^ _SHIFT[1][(s >> np.uint32(8)) & 0xFF] ^ _SHIFT[2][(s >> np.uint32(16)) & 0xFF] ^ _SHIFT[3][s >> np.uint32(24)] ^ part[first[i] + k]
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(parts: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in parts]
    a, b = masked(crc32c_many(lengths)).tolist(), masked(crc32c_many(parts)).tolist()
    return [n + struct.pack("<I", x) + p + struct.pack("<I", y) for n, x, p, y in zip(lengths, a, parts, b, strict=True)]


def unframe(data: bytes, index: np.ndarray) -> list[bytes]:
    """The data of the records at the index's offsets; ValueError where a length or a checksum is wrong."""
    parts, lengths, want = [], [], []
    for at, size in zip(index["offset"].tolist(), index["size"].tolist(), strict=True):
        lengths.append(data[at : at + 8])
        n, a = struct.unpack_from("<QI", data, at)
        if n + 16 != size:
            raise ValueError("length differs from the index")
        parts.append(data[at + 12 : at + 12 + n])
        want.append((a, struct.unpack_from("<I", data, at + 12 + n)[0]))
    got = zip(masked(crc32c_many(lengths)).tolist(), masked(crc32c_many(parts)).tolist(), strict=True)
    if list(got) != want:
        raise ValueError("checksum differs")
    return parts


#: What stands for a null key in a record.
NO_KEY = -(1 << 63)
INDEX = np.dtype([("key", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("ids", "<i4")])


def tokenized(docs: DataFrame, vocabulary: str, end_id: int | None, bounds: list[float]) -> DataFrame:
    """part int (by the bounds of keys, null keys first), doc_id long, width int, ids binary (packed little-endian), n_tokens int; end_id is appended to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, edges = encoder(vocabulary), np.array(bounds, np.float64)
        size = enc.dtype.itemsize
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            part = np.where(b.column(0).is_null(), 0, np.searchsorted(edges, b.column(0).fill_null(0).to_numpy(), side="right")).astype(np.int32)
            yield pa.record_batch([pa.array(part), b.column(0), pa.array([size] * len(ids), pa.int32()), pa.array(ids, pa.binary()), pa.array([len(x) // size for x in ids], pa.int32())], names=["part", "doc_id", "width", "ids", "n_tokens"])

    return map_arrow(texts_of(docs), run, "part int, doc_id long, width int, ids binary, n_tokens int")


def shard_path(folder: str, part: int, serial: int) -> str:
    return f"{folder}/shard-{part:05d}-{serial:06d}"


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, rows_per_shard: int = 4096) -> DataFrame:
    """Write the shards; one row per record: doc_id long, part int, serial int, offset long, size long, n_tokens int. The returned table, which is the offset index of all shards, is stored."""
    spark = docs.sparkSession
    keys = docs.select(docs["doc_id"].cast("long").alias("k"))
    n = keys.count()
    # one range of keys for each task, from one pass over the key column; a task cuts its range into shards by count
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_shard)))
    probs = [i / parts for i in range(1, parts)]
    bounds = sorted(set(keys.where("k is not null").approxQuantile("k", probs, min(0.01, 0.1 / parts)))) if probs else []

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.RecordBatch] = []
        now, serial, blocks, index, at = None, 0, [], [], 0

        def close():
            if index:
                t = np.array([(NO_KEY if k is None else k, *rest) for k, *rest in index], INDEX)
                put_file(shard_path(folder, now, serial) + ".rec", blocks)
                put_file(shard_path(folder, now, serial) + ".idx", [t.tobytes()])
                fixed = [pa.array(np.full(len(t), x, np.int32)) for x in (now, serial)]
                done.append(pa.record_batch([pa.array([r[0] for r in index], pa.int64()), *fixed, *(pa.array(np.ascontiguousarray(t[c])) for c in ("offset", "size", "ids"))], names=["doc_id", "part", "serial", "offset", "size", "n_tokens"]))

        for b in slices(batches, 1024):
            parts = [data_of(k, w, x) for k, w, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            for p, k, ids, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), frame(parts), strict=True):
                if p != now or len(index) == rows_per_shard:
                    close()
                    now, serial, blocks, index, at = p, serial + 1 if p == now else 0, [], [], 0
                blocks.append(f)
                index.append((k, at, len(f), ids))
                at += len(f)
            yield from done
            done.clear()
        close()
        yield from done

    rows = tokenized(docs, vocabulary, end_id, bounds)
    placed = rows.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "ids")
    return stored(map_arrow(placed, write, "doc_id long, part int, serial int, offset long, size long, n_tokens int"), "record-index")


def data_of(key: int | None, width: int, ids: bytes) -> bytes:
    return struct.pack("<qIB", NO_KEY if key is None else key, len(ids) // width, width) + ids


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    k, n, w = struct.unpack_from("<qIB", data)
    return None if k == NO_KEY else k, np.frombuffer(data, f"<u{w}", n, 13).astype("<u4")


def read_records(folder: str, shards: DataFrame) -> DataFrame:
    """doc_id long, part int, serial int, seq int (place in the shard), n_tokens long, ids_crc32 long (of ids as 4 bytes) of the records of the named shards (part, serial)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index = np.frombuffer(get_file(shard_path(folder, p, s) + ".idx"), INDEX)
                data = get_file(shard_path(folder, p, s) + ".rec")
                for i in range(0, len(index), 1024):
                    rows = []
                    for j, part in enumerate(unframe(data, index[i : i + 1024]), i):
                        k, ids = parsed(part)
                        rows.append((k, p, s, j, len(ids), zlib.crc32(ids.tobytes())))
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "part", "serial", "seq", "n_tokens", "ids_crc32"])

    return map_arrow(shards.select("part", "serial"), read, "doc_id long, part int, serial int, seq int, n_tokens long, ids_crc32 long")


def shuffled_records(folder: str, index: DataFrame, seed: int, partitions: int, open_files: int = 16) -> DataFrame:
    """place long, doc_id long, ids binary (4 bytes each): single records in an order drawn by seed, each read alone at its offset.

    place numbers the records of the pseudo-random order within one partition."""
    draw = F.xxhash64(F.lit(seed), "part", "serial", "offset")
    rows = index.select(F.pmod(draw, F.lit(partitions)).alias("to"), draw.alias("draw"), "part", "serial", "offset", "size")
    rows = rows.repartition(partitions, "to").sortWithinPartitions("to", "draw", "part", "serial", "offset").select("part", "serial", "offset", "size")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            files: dict[tuple[int, int], tuple] = {}
            place = 0
            for b in slices(batches):
                out = []
                for p, s, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (p, s) not in files:
                        if len(files) >= open_files:
                            files.pop(next(iter(files))).close()
                        fs, path = filesystem(shard_path(folder, p, s) + ".rec")
                        files[p, s] = stack.enter_context(fs.open_input_file(path))
                    f = files[p, s]
                    f.seek(at)
                    k, ids = parsed(unframe(f.read(size), np.array([(0, 0, size, 0)], INDEX))[0])
                    out.append((place, k, ids.tobytes()))
                    place += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["place", "doc_id", "ids"])

    return map_arrow(rows, read, "place long, doc_id long, ids binary")


def record_digest(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, rows_per_shard: int = 4096) -> DataFrame:
    """Write docs as records, read them back: doc_id, start, n_tokens, ids_crc32, part, serial, seq."""
    spark = docs.sparkSession
    folder = scratch(spark, "records")
    rows = write_records(docs, folder, vocabulary or tokenizer_path("byte_bpe_50k.json"), end_id, rows_per_shard)
    totals = stored(rows.groupBy("part", "serial").agg(F.sum("n_tokens").cast("long").alias("n")), "shard-totals")
    # starts in two steps: of the ranges, which are as many as shuffle partitions at most, and of the shards in each
    ranges = totals.groupBy("part").agg(F.sum("n").alias("m")).select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("lead"))
    inner = totals.select("part", "serial", (F.sum("n").over(Window.partitionBy("part").orderBy("serial")) - F.col("n")).alias("before"))
    before = stored(inner.join(ranges, "part").select("part", "serial", (F.col("lead") + F.col("before")).alias("before")), "shard-starts")
    names = before.select("part", "serial").repartition(max(1, min(before.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))), "part", "serial")
    got = read_records(folder, names).join(before, ["part", "serial"])
    w = Window.partitionBy("part", "serial").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return got.select("doc_id", (F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32", "part", "serial", "seq")
