import random
import zlib

import corpus_pipeline
import pytest

from releaselode.llm import quality
from releaselode.llm.common import tokenizer_path

from .helpers import documents, utf8
from .test_jaccard import brute as classes


def removed(docs, width=100):
    """Texts after the cut, by whole characters."""
    seen, out = set(), []
    for k, t in sorted(docs):
        b = utf8(t)
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        i = 0
        while i < len(b):  # a character goes only if all of its bytes go
            j = i + 1
            while j < len(b) and b[j] & 0xC0 == 0x80:
                j += 1
            if not all(gone[i:j]):
                gone[i:j] = bytes(j - i)
            i = j
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        if text:
            out.append((k, text))
    return out


def make():
    rng = random.Random(11)
    _, common, shares = quality.REFERENCES["en"]
    def word():
        x = rng.random()
        for w, p in zip(common.split(), shares, strict=False):
            x -= p * 1.2
            if x < 0:
                return w
        return "".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(2, 8)))

    def text(n):
        return " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))

    passage = text(60)
    docs = [text(rng.randrange(60, 160)) for _ in range(25)]
    docs += [f"{text(90)} {passage} {text(90)}" for _ in range(6)]
    for d in docs[:8]:
        w = d.split(" ")
        w[rng.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
    docs += docs[:4] + ["spam spam spam spam spam spam spam spam " * 10, "Short.", "", None]
    return list(enumerate(docs))


def test_stages_against_brute_force(spark, tmp_path):
    docs = make()
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in quality.divergence_rules(documents(spark, docs)).collect() if r.kept}
    assert {43, 44, 45, 46}.isdisjoint(kept) and len(kept) > 30
    left = [(k, t) for k, t in docs if k in kept]
    firsts = {k for k, _, c in classes(left) if k == c}
    left = removed([(k, t) for k, t in left if k in firsts])
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = set()
    for k, t in left:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        assert len(ids) <= 1024
        want.add((k, 0, 0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_and_clashing(spark, stage):
    assert stage(spark, documents(spark, []), "").count() == 0
    out = stage(spark, documents(spark, make()[:6]), "")
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == documents(spark, []).columns
    assert out.count() >= 5


def test_repeated_keys(spark):
    texts = [t for _, t in make()]
    docs = make()[:5] + [(0, texts[0]), (1, "zz " + texts[1]), (2, texts[10]), (None, texts[11]), (None, texts[11])]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, documents(spark, docs), "").collect()]
    assert [k for k, _ in got].count(1) == 1 and {t for k, t in got if k == 1} < {texts[1], "zz " + texts[1]}
    want = [(0, texts[0]), (2, texts[2]), (2, texts[10]), (3, texts[3]), (4, texts[4]), (-1, texts[11])]
    assert sorted((-1 if k is None else k, t) for k, t in got if k != 1) == sorted(want)


def test_a_map_column_is_kept(spark):
    rows = [(1, "one two three four five six", {"a": 1}), (1, "one two three four five six", {"a": 2}), (2, "seven eight nine ten eleven twelve", None)]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>"), "").collect()
    assert sorted((r.doc_id, (r.m or {}).get("a")) for r in out) == [(1, 1), (2, None)]
