import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from releaselode.llm import media, packing, records, sharding, warc
from releaselode.llm.common import WordEncoder, scratch, tokenizer_path

from .helpers import AWKWARD, documents, utf8


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda t: [*tk.encode(t or "", add_special_tokens=False).ids, 2]


def test_word_encoder_equals_library(ids):
    enc = WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = [t or "" for _, t in AWKWARD] + ["".join(rng.choice(["ab", "'s", ",", " ", "\n", "\t", "é", "7", " ", "."]) for _ in range(60)) for _ in range(400)]
    for text, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, enc.dtype).tolist() == ids(text)[:-1], repr(text)


def test_media(spark):
    rows = media.text_media(documents(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by_text = {}
    for r in rows:
        raw = utf8(dict(AWKWARD)[r.doc_id])
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
        assert by_text.setdefault(raw, r[1:]) == r[1:]
        assert media.summary(bytes(r.features)) == r.feature
    assert media.text_media(documents(spark, [])).count() == 0


def test_resample_against_direct_sum():
    x = np.random.default_rng(0).normal(size=301).astype(np.float32)
    for up, down in [(1, 2), (2, 1), (3, 2), (2, 5)]:
        h = media._lowpass(up, down, 24).T.reshape(-1)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = [sum(h[k] * stuffed[m * down - k] for k in range(len(h)) if 0 <= m * down - k < len(stuffed)) for m in range(-(-len(x) * up // down))]
        assert np.allclose(media.resample(x, up, down), want, atol=1e-4)


def test_features_by_direct_sums(spark):
    """The whole chain of one clip in plain sums and loops: resampling, windows, mel filters, tensors, segments, summary."""
    import json
    import math

    import pyarrow as pa

    p = media.AudioParams()
    assert p.up > 1 and math.gcd(p.up, p.down) == 1
    rng = np.random.default_rng(5)
    samples = np.clip(128 + 90 * np.sin(np.arange(6144) * 0.3) * (np.arange(6144) // 700 % 2) + rng.normal(0, 4, 6144), 0, 255).astype(np.uint8)
    x = (samples.astype(float) - 128) / 128
    h = media._lowpass(p.up, p.down, p.taps).T.reshape(-1).astype(float)
    y = []
    for m in range(-(-len(x) * p.up // p.down)):
        total = 0.0
        for k in range(m * p.down % p.up, len(h), p.up):
            j = (m * p.down - k) // p.up
            total += h[k] * x[j] if 0 <= j < len(x) else 0.0
        y.append(total)
    n = 1 + -(-(len(y) - p.window) // p.hop)
    y += [0.0] * ((n - 1) * p.hop + p.window - len(y))
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(p.out_rate / 2) * i / (p.n_mels + 1) / 2595) - 1) for i in range(p.n_mels + 2)]
    want = np.zeros((n, p.n_mels))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(p.n_fft // 2 + 1), np.arange(p.window)) / p.n_fft)
    for f in range(n):
        part = np.array([y[f * p.hop + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / (p.window - 1))) for i in range(p.window)])
        power = np.abs(turn @ part) ** 2
        for b in range(p.n_mels):
            lo, mid, hi = edges[b : b + 3]
            total = 0.0
            for i, e in enumerate(power):
                hz = i * p.out_rate / p.n_fft
                total += e * max(0.0, min((hz - lo) / (mid - lo), (hi - hz) / (hi - mid)))
            want[f, b] = 10 * math.log10(total + 1e-6)
    t = pa.ipc.open_stream(media.features(samples.tobytes(), p)).read_all()
    got = t.column("logmel").combine_chunks().to_numpy_ndarray()
    for w, block in enumerate(got):
        for i in range(p.frames):
            f = w * p.step + i
            assert np.allclose(block[i], want[f] if f < n else -60, atol=2e-2)
    assert len(got) == max(1, -(-(n - p.frames + p.step) // p.step))
    level, on, spans = want.mean(axis=1) - want.mean(axis=1).mean(), None, []
    for f, e in enumerate([*level, -1e9]):
        if on is None and e >= p.on_db:
            on = f
        elif on is not None and e < p.off_db:
            if f - on >= p.min_frames:
                spans.append([round(on * 1000 * p.hop / p.out_rate), round(f * 1000 * p.hop / p.out_rate)])
            on = None
    assert json.loads(t.schema.metadata[b"segments_ms"]) == spans and len(spans) > 2
    full = np.full(got.shape[:2] + (p.n_mels,), -60.0)
    for w in range(len(full)):
        for i in range(p.frames):
            if w * p.step + i < n:
                full[w, i] = want[w * p.step + i]
    said = dict(x.split("=") for x in media.summary(media.features(samples.tobytes(), p)).split(";"))
    assert (said["windows"], said["frames"], said["segments"], said["active_ms"]) == (str(len(got)), str(n), str(len(spans)), str(sum(b - a for a, b in spans)))
    assert abs(float(said["mean_db"]) - full.mean()) < 1e-2


def test_segments_have_hysteresis():
    e = np.array([-9, -9, 5, 5, 0.5, 0.5, 5, -9, -9, 0.5, 0.5, 0.5, -9], float)
    assert media.segments(e - e.mean(), media.AudioParams(on_db=4, off_db=-2, min_frames=2)) == [(2, 7)]
    table = __import__("pyarrow").ipc.open_stream(media.features(b"\x80" * 40000, media.AudioParams())).read_all()
    assert table.schema.field("logmel").type.shape == [32, 16] and table.column("end_ms").to_pylist()[0] == round(1000 * 32 * 80 / media.AudioParams().out_rate)


def test_crc32c_known_values():
    assert records.crc32c_many([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 255, 256, 257, 511, 512, 5000, 3)]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (records.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert records.crc32c_many(parts).tolist() == [slow(b) for b in parts]


@pytest.mark.parametrize("per_shard", [4096, 3])
def test_records(spark, ids, per_shard):
    rows = records.record_digest(documents(spark), rows_per_shard=per_shard).orderBy("start").collect()
    start = 0
    for r, (k, t) in zip(rows, sorted(AWKWARD, key=lambda x: (x[0] is not None, x[0])), strict=True):
        want = ids(t)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
        start += len(want)
    assert records.record_digest(documents(spark, [])).count() == 0


def test_shuffled_read_by_the_index(spark, ids):
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD * 5)]
    folder = scratch(spark, "r")
    index = records.write_records(documents(spark, docs), folder, tokenizer_path("byte_bpe_50k.json"), 2, 7)
    texts, orders = dict(docs), []
    for seed in (1, 2):
        rows = records.shuffled_records(folder, index, seed, 3, open_files=2).collect()
        assert sorted(r.doc_id for r in rows) == sorted(texts)
        assert all(np.frombuffer(r.ids, "<u4").tolist() == ids(texts[r.doc_id]) for r in rows)
        orders.append([r.doc_id for r in rows])
    assert orders[0] != orders[1] != sorted(texts)
    one = records.shuffled_records(folder, index.where("doc_id = 6"), 1, 1).first()
    assert np.frombuffer(one.ids, "<u4").tolist() == ids(texts[6])


def test_damaged_record_is_refused():
    data = b"".join(records.frame([b"abc", b"defg"]))
    index = np.array([(0, 0, 19, 1), (1, 19, 20, 1)], records.INDEX)
    assert records.unframe(data, index) == [b"abc", b"defg"]
    with pytest.raises(ValueError):
        records.unframe(data.replace(b"b", b"x"), index)


def test_packing(spark, ids):
    rng = random.Random(3)
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD)] + [(100 + i, "tok " * rng.randrange(1, 1500)) for i in range(150)] + [(None, "tok " * 1300)]
    rows = packing.pack(documents(spark, docs), block_rows=40).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    total = 0
    for k, t in docs:
        want, at = ids(t), 0
        total += len(want)
        for i, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            part = want[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            assert r.length == 1024 or i == 0
            at += r.length
        assert at == len(want)
    for group in by_seq.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= -(-total // 1024) + 1
    assert packing.pack(documents(spark, [])).count() == 0


def test_fullest_against_brute_force():
    from itertools import product

    rng = random.Random(0)
    for _ in range(60):
        counts = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(4)}
        room = rng.randrange(0, 50)
        best = max(s for c in product(*(range(c + 1) for c in counts.values())) if (s := sum(n * k for n, k in zip(counts, c, strict=True))) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(n) <= counts[n] for n in got)


def test_sharding(spark):
    names = [f"s{i}" for i in range(5)]
    table = sharding.lookup_table(names, 101)
    assert sorted(np.bincount(table).tolist()) == [20, 20, 20, 20, 21]
    fewer = sharding.lookup_table(names[:4], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 4) < 30
    df = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (None, "c", 9)], "doc_id long, text string, slot int")
    rows = sharding.place(df, "doc_id", names, 101).collect()
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:8], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_warc(spark):
    rows = [(1, "http://a/", "x" * 500), (2, None, "x" * 500), (3, "http://c/\r\nX: y", None), (4, "u", ""), (5, "u", "ü\r\n\r\n"), (5, "u", "ü\r\n\r\n")]
    rows += [(None, "u", "x" * 500), (None, "u", "alone"), (None, None, "twice without a key"), (None, None, "twice without a key")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, key string")
    all_rows = warc.archive_digest(pages, 0).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in all_rows) == sorted(
        [(1, "revisit", 2), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0), (5, "response", 0), (0, "revisit", 2)] + [(0, "response", 0)] * 3
    )
    for r in all_rows:
        if r.page_id is not None:
            body = utf8({p[0]: p[2] for p in rows}[r.page_id])
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    types = sorted(r.record_type for r in warc.archive_digest(pages, 100).collect())
    assert types == ["response"] * 8 + ["revisit"] * 2
    assert warc.archive_digest(pages.limit(0)).count() == 0


def test_warc_single_records_in_any_order(spark):
    pages = spark.createDataFrame([(i, f"http://{i}/", f"page {i} " * (i % 7 * 40 + 1)) for i in range(200)], "page_id long, url string, html string").coalesce(2)
    folder = scratch(spark, "w")
    index = warc.write_bundles(pages, folder, 0, frame_bytes=5000, bundle_bytes=4000)
    rows = index.collect()
    assert len({r.bundle for r in rows}) > 1 or len({r.offset for r in rows}) > 5
    assert max(r.within for r in rows) > 0
    random.Random(4).shuffle(rows)
    for r in rows[:60]:
        fields, body = warc.read_record(f"{folder}/{r.bundle}", r.frame, r.offset, r.within)
        assert fields["WARC-Record-ID"] == r.record_id and body.decode() == f"page {r.key} " * (r.key % 7 * 40 + 1)
    again = warc.read_records(folder, index.orderBy("record_id").coalesce(1)).collect()
    assert {r.key: r.payload_bytes for r in again} == {i: len(f"page {i} " * (i % 7 * 40 + 1)) for i in range(200)}
    with pytest.raises(ValueError):
        warc.read_record(f"{folder}/{rows[0].bundle}", rows[0].frame, rows[0].offset + 1, 0)
