"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames of a few hundred kilobytes, so a frame compresses records together and can still
be read alone. A bundle ends with a seek table: a skippable frame of (compressed size, size) for each frame, and a footer of
the number of frames, a flag byte and a magic number. An index maps record identifiers to (bundle, frame, offset of the frame,
offset in the frame); records are read back through it.

Equal payloads of at least `least` bytes are stored once: the record with the largest key is the response, the others are
revisits without payload that name it. The groups come from a partial aggregation by digest, so a payload that a
third of all pages share is one row per task in the shuffle. Bundles are written by the tasks of the scan itself; a
repeated task writes a bundle of another name, and only the bundle of the attempt that succeeded is in the index.

Null or empty payloads: records of 0 bytes. A very long payload is a frame of its own. Repeated keys: one record each, and a
response for each row that has the largest key. Null keys: records with an empty page key, revisits where a row with a key has the
same payload, else responses. Null address: an empty header. Empty table: no bundle, no row. Other columns are ignored."""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, map_arrow, put_file, scratch, slices, stored

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
STAMP = "2026-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{_shown(key)}')}>"


def _shown(key: int | None) -> str:
    return "" if key is None else str(key)


def record(key: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """WARC/1.1 response, or revisit when refers_to is another record's key."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    url = "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {STAMP}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Page-Key: {_shown(key)}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Key: {refers_to}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """The record that starts at a place of a frame; it ends by its Content-Length."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    stop += 4
    end = stop + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record isn't ended")
    return fields, data[stop:end]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """From a bundle, or its end: (offset of the frame, compressed size, size) of each."""
    n, flags, magic = struct.unpack_from("<IBI", tail, len(tail) - 9)
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table")
    at, out = 0, []
    start = len(tail) - 9 - 8 * n
    for i in range(n):
        packed, size = struct.unpack_from("<II", tail, start + 8 * i)
        out.append((at, packed, size))
        at += packed
    return out


class Bundle:
    """An open bundle, of which single frames are read; the last one stays at hand."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = filesystem(uri)
        self.file, self.z = fs.open_input_file(path), zstandard.ZstdDecompressor()
        end = self.file.size()
        n = struct.unpack("<IBI", self._at(end - 9, 9))[0]
        self.frames = read_seek_table(self._at(end - 9 - 8 * n, 9 + 8 * n))
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def record(self, frame: int, offset: int, within: int) -> tuple[dict[str, str], bytes]:
        at, packed, size = self.frames[frame]
        if at != offset:
            raise ValueError("no frame starts there")
        if self.last[0] != frame:
            self.last = (frame, self.z.decompress(self._at(at, packed), max_output_size=size))
        return parse(self.last[1], within)

    def close(self) -> None:
        self.file.close()


def read_record(uri: str, frame: int, offset: int, within: int) -> tuple[dict[str, str], bytes]:
    """One record of a bundle by its row of the index, reading its frame only."""
    with contextlib.closing(Bundle(uri)) as bundle:
        return bundle.record(frame, offset, within)


def payload_groups(pages: DataFrame, least: int, key: str = "page_id", payload: str = "html") -> DataFrame:
    """same string, response long: payloads that several rows share, by SHA-256 (SHA-1, which stands in the records, has known collisions), and the largest key."""
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("long").alias("key"), F.sha2(body, 256).alias("same"), F.octet_length(body).alias("n")).where(F.col("n") >= least)
    return rows.groupBy("same").agg(F.max("key").alias("response"), F.count("*").alias("c")).where("c > 1").select("same", "response")


def write_bundles(pages: DataFrame, folder: str, least: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", most_broadcast: int = 200_000, frame_bytes: int = 1 << 18, bundle_bytes: int = 32 << 20) -> DataFrame:
    """Write all rows; the stored index: key long, record_id string, bundle string, frame int, offset long, within int."""
    body = F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[key].cast("long").alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), body.alias("body"), F.sha2(body, 256).alias("same"))
    groups = stored(payload_groups(pages, least, key, payload), "payload-groups")
    # few shared payloads travel to the scan; many are joined by digest instead, where skewed digests are split by AQE
    few = groups.limit(most_broadcast + 1).count() <= most_broadcast
    rows = rows.join(F.broadcast(groups) if few else groups, "same", "left").select("key", "url", "body", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        blocks, sizes, index, at = [], [], [], 0
        records, size = [], 0  # of the frame that is being filled

        def fill() -> None:
            nonlocal records, size, at
            packed = z.compress(b"".join(records))
            blocks.append(packed)
            sizes.append((len(packed), size))
            at += len(packed)
            records, size = [], 0

        def close() -> pa.RecordBatch:
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            put_file(f"{folder}/{name}", [*blocks, seek_table(sizes)])
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32()]
            cols = zip(*((k, record_id(k), name, i, o, w) for k, i, o, w in index), strict=True)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "record_id", "bundle", "frame", "offset", "within"])

        for b in slices(batches):
            for k, u, body, response in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(k, u, body, None if response is None or response == k else response)
                index.append((k, len(sizes), at, size))
                records.append(data)
                size += len(data)
                if size >= frame_bytes:
                    fill()
            if at > bundle_bytes:
                if records:
                    fill()
                yield close()
                blocks, sizes, index, at = [], [], [], 0
        if records:
            fill()
        if index:
            yield close()

    return stored(map_arrow(rows, write, "key long, record_id string, bundle string, frame int, offset long, within int"), "warc-index")


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """key long, payload_bytes long, payload_digest string, record_type string, refers_to long of the records that the index's rows name.

    Each is found by its frame and its offset in the frame; rows may come in any order, and cost least in that of the bundles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bundle = None, None
        for b in slices(batches):
            rows = []
            for key, rid, name, frame, offset, within in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now:
                    if bundle is not None:
                        bundle.close()
                    now, bundle = name, Bundle(f"{folder}/{name}")
                fields, body = bundle.record(frame, offset, within)
                kind = fields["WARC-Type"]
                said, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
                if fields["WARC-Record-ID"] != rid or fields["WARC-Page-Key"] != _shown(key):
                    raise ValueError("another record stands there")
                if kind == "response" and (digest(body), len(body)) != (said, n):
                    raise ValueError("payload differs from its digest")
                rows.append((key, n, said, kind, int(fields["WARC-Refers-To-Key"]) if kind == "revisit" else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if bundle is not None:
            bundle.close()

    return map_arrow(index.select("key", "record_id", "bundle", "frame", "offset", "within"), read, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages as bundles and read them back by the index: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch(pages.sparkSession, "warc")
    index = write_bundles(pages, folder, least)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a bundle's rows stay together, so that each frame is read once
    placed = index.repartition(parts, "bundle").sortWithinPartitions("bundle", "offset", "within")
    return read_records(folder, placed).withColumnRenamed("key", "page_id")
