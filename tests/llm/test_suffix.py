import hashlib
import random
import tempfile

import numpy as np
import pytest

from releaselode.llm import suffix

from .helpers import AWKWARD, documents, utf8


def brute(docs, width=100):
    seen, out = set(), []
    for k, t in sorted(docs, key=lambda x: x[0]):
        b = utf8(t)
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def make(seed):
    rng = random.Random(seed)
    vocab = ["alpha", "beta", "gé", "delta", "eps", "zeta", "été", "theta", "io", "kappa"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(40) for _ in range(4)] + ["x" * 230, "ab" * 90]
    docs = []
    for i in range(50):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 200)], text(rng.randrange(20))]
        docs.append((i * 7 % 50, rng.choice(["", " "]).join(parts)))
    near = text(80)
    for i in range(40):
        w = list(near)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("xyzé")
        docs.append((100 + i, "".join(w)))
    return docs + [(500, None), (501, ""), (502, docs[3][1]), (503, docs[3][1])]


@pytest.mark.parametrize("seed,reach,block,hot", [(1, 8, 1 << 18, 512), (2, 8, 97, 0), (3, 5, 100, 3), (4, 1, 100, 2), (5, 16, 50, 1)])
def test_against_brute_force(spark, seed, reach, block, hot):
    docs = make(seed)
    got = sorted(tuple(r) for r in suffix.dedup_digest(documents(spark, docs), reach=reach, range_bytes=5000, block=block, hot=hot).collect())
    assert got == brute(docs)


def test_suffix_order_against_sorting():
    rng = random.Random(8)
    for block, letters in ((3, "ab"), (7, "abcde"), (1000, "ab"), (20, "a")):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 9))) for _ in range(30)]
        wide = np.zeros((30, 9), np.uint8)
        for i, t in enumerate(texts):
            for k, c in enumerate(t):
                wide[i, 9 - len(t) + k] = ord(c) - 96
        with tempfile.TemporaryDirectory() as folder:
            text, size, lcp = (np.concatenate(c) for c in zip(*suffix.suffix_order(wide, np.array([len(t) for t in texts]), folder, block), strict=True))
        found = [texts[i][len(texts[i]) - n :] for i, n in zip(text, size, strict=True)]
        assert found == sorted(found) and len(found) == sum(len(t) + 1 for t in texts)
        for a, b, n in zip(found, found[1:], lcp[1:], strict=False):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert n == k


def test_a_digest_without_a_first_segment_is_told():
    held = suffix.Compared(100, 8)
    held.add(1, 0, 1, 0, True, b"a", None)
    held.add(2, 0, 1, 0, False, b"a", None)
    assert not held.unknown
    held.add(3, 0, 1, 0, False, b"b", None)
    assert held.unknown


@pytest.mark.parametrize("hot", [512, 0])
def test_one_hash_for_all_segments(spark, hot):
    """If the hashes of all bytes are equal, bytes and digests still decide."""
    docs = make(9)
    whole = suffix.texts_of(documents(spark, docs))
    dealt = suffix.dealt_segments(whole, 100, 32, 3, 2).repartition(2, "kind", "part").sortWithinPartitions("kind", "part")

    def alike(batches):
        for kind, part, blocks in suffix._by_part(batches):
            if kind == 1:
                doc, *rest, _ = suffix._unpack(blocks, suffix.SEGMENT)
                blocks = [suffix._pack(doc, *(c.astype(k) for c, k in zip(rest, suffix.SEGMENT, strict=False)), np.zeros(len(doc), "<u8"))]
            yield suffix._frame([(kind, part, x) for x in blocks])

    found = suffix.stored(suffix.shared_segments(suffix.map_arrow(dealt, alike, "kind int, part int, block binary"), 2, hot), "alike")
    asked = suffix.stored(suffix.asked_rows(found.where("kind = 2").repartition(2, "part").sortWithinPartitions("kind", "part")), "alike-asked")
    rows = lambda digests: suffix.segment_bytes(whole, asked, 100, 8, 3, digests).repartition(2, "part").sortWithinPartitions("part", "doc_id", "first")
    assert suffix.compared(rows(True), 100, 8, 2, 500).where("kind = 3").count() > 0
    more = suffix.compared(rows(False), 100, 8, 2, 500)
    assert more.where("kind = 3").count() == 0
    gone = found.where("kind = 0").union(more.where("kind = 0")).repartition(2, "part").sortWithinPartitions("kind", "part")
    got = {r.doc_id: np.frombuffer(r.runs, "<i8").reshape(-1, 2) for r in suffix.removed_runs(gone, 100).collect()}
    assert {k: (int((r[:, 1] - r[:, 0]).sum()), len(r)) for k, r in got.items()} == {k: (n, s) for k, _, n, s, _ in brute(docs) if n}


def test_null_and_repeated_keys(spark):
    """Of one key's texts that with the smaller hash is earlier; null keys come first."""
    docs = [(i % 20 if i % 9 else None, t) for i, (_, t) in enumerate(make(7))]
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in docs], "t string").selectExpr("t", "xxhash64(t) as h").collect()}
    order = sorted({(k is not None, k or 0, hashes[t or ""]) for k, t in docs})
    number = {x: i for i, x in enumerate(order)}
    numbered = [(number[k is not None, k or 0, hashes[t or ""]], t) for k, t in docs]
    want = {r[0]: r[1:] for r in brute({n: t or "" for n, t in numbered}.items())}
    got = sorted(tuple(r)[1:] for r in suffix.dedup_digest(documents(spark, docs), range_bytes=5000).collect())
    assert got == sorted(want[n] for n, _ in numbered)
    assert suffix.cut_texts(documents(spark, docs)).count() == len(docs)


def test_awkward_rows(spark):
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD)]
    assert sorted(tuple(r) for r in suffix.dedup_digest(documents(spark, docs)).collect()) == brute(docs)
    assert suffix.dedup_digest(documents(spark, [])).count() == 0


def test_cut_texts_keeps_columns_and_characters(spark):
    docs = make(1)
    df = documents(spark, docs)
    out = suffix.cut_texts(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    for k, n, gone, *_ in brute(docs):
        assert n - gone <= len(utf8(got[k])) <= n - gone + 8 * max(1, gone // 50)
    assert got[500] is None and got[503] == ""


def test_repeated_rows(spark):
    docs = make(6)
    rows = docs + [docs[k] for k in (3, 3, 10, 55, 60, 91)] + [(600, "Nothing of this stands earlier. " * 3 + "abcdefgh" * 20)] * 3
    got = sorted(tuple(r) for r in suffix.dedup_digest(documents(spark, rows), range_bytes=5000).collect())
    one = {r[0]: r for r in brute(set(rows))}
    assert got == sorted(one[k] for k, _ in rows)
    assert one[600][2] < one[600][1]
