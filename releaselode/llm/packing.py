"""Best-fit packing by minimum bin slack: fill each sequence with the fullest combination of the pieces that are left.

Piece lengths are at most the capacity, so the corpus is summed up by a histogram of that many counts. The plan is made
from this histogram alone: starting with the largest length that is left, a subset-sum table over the available
lengths (one bit per reachable fill, as a Python integer) gives the fullest combination; it is taken as often as the
counts allow and removed. Rows find their place by their rank among pieces of equal length; ranks are counted in two
steps (counts per block of rows, then within the block), so that a length that half of the rows share is no hot key.

The string of an added token in a text (<|endoftext|>) is that token, as in the library. Null or empty text: the end id alone. Longer documents are cut; their first piece may be shorter. Repeated rows
and null keys are packed each. A very long text is one array of ids while it is cut. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import encoder, map_arrow, slices, stored, texts_of, tokenizer_path


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (no more of each than its count) whose sum is the largest that is at most room; larger lengths first."""
    mask = (1 << (room + 1)) - 1
    lengths = sorted((n for n, c in counts.items() if c > 0 and n <= room), reverse=True)
    reach, steps = 1, []
    for n in lengths:
        for _ in range(min(counts[n], room // n)):
            new = (reach | reach << n) & mask
            if new == reach:
                break
            steps.append((n, reach))
            reach = new
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:  # only reached with this piece
            chosen.append(n)
            at -= n
    return sorted(chosen, reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, times) of the sequences, each filled as far as the pieces that are left allow."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while left:
        top = max(left)
        rest = {n: c - (n == top) for n, c in left.items()}
        lengths = [top, *fullest(rest, capacity - top)]
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(left[n] // k for n, k in need.items())
        out.append((lengths, times))
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def slots(packed: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces of it in one sequence, first sequence, their offsets ...) in order of rank."""
    rows: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    ranks: dict[int, int] = {}
    seq = 0
    for lengths, times in packed:
        at, offsets = 0, {}
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, o in offsets.items():
            rows.setdefault(n, []).append((ranks.get(n, 0), len(o), seq, o))
            ranks[n] = ranks.get(n, 0) + len(o) * times
        seq += times
    return rows


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id long, piece int, start long, length long, ids_crc32 long, block int (of rows that one batch holds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        size = enc.dtype.itemsize
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(raw + end, enc.dtype).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for i, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if at == 0 else at + capacity]
                    rows.append((doc, i, at, len(part), zlib.crc32(part.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(texts_of(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, end_id: int = 2, block_rows: int = 65536) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id long, offset long: one row per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocabulary or tokenizer_path("byte_bpe_50k.json"), end_id, capacity), "pieces")
    blocks = max(1, -(-cut.count() // block_rows))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    # counts per length and block: at most capacity rows for each block of block_rows pieces
    counts = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block")
    firsts = counts.select("length", "block", (F.sum("n").over(before) - F.col("n")).alias("first"), "n")
    firsts = stored(firsts, "piece-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in firsts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {n: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), rows) for n, rows in table.items()}
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                i = np.flatnonzero(length == n)
                first, per, base, rows = ready[n]
                e = np.searchsorted(first, rank[i], side="right") - 1
                within = rank[i] - first[e]
                seq[i] = base[e] + within // per[e]
                offset[i] = [rows[x][3][y] for x, y in zip(e.tolist(), (within % per[e]).tolist(), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    within = Window.partitionBy("block", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("r", F.row_number().over(within)).join(firsts.select("length", "block", "first"), ["length", "block"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("r") - 1).cast("long").alias("rank"))
    return map_arrow(ranked, put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
