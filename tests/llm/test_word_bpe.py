import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from releaselode.llm import word_bpe
from releaselode.llm.common import tokenizer_path

from .helpers import AWKWARD, documents

PATH = tokenizer_path("word_bpe_49k.json")
BITS = ["ab", "tion", "'s", ",", "  ", "\n", "\t", "é", "é", " ́", "7", "ñ", "ing", "東", "Σ", "İ", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "aaaa", "</w>", "<", "w", "don't", "ǅ", " ", "ẞ", "\U0001f600", "a", "th", "ͅ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return word_bpe.WordBpe(PATH, most=200_000)


def texts(seed, n):
    rng = random.Random(seed)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeihtns") for _ in range(rng.randint(1, 90))) for _ in range(n)]
    return out + ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0, 0x52F), rng.randint(0xE000, 0x1FFFF)])) for _ in range(12)) for _ in range(n)]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False).encode()


def test_query_equals_library(spark, library):
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD)] + [(None, "A row WITHOUT a key"), (50, "abcdefgh" * 9000), (51, "x" * 63 + " " + "y" * 64)] + list(enumerate(texts(3, 30), 100))
    got = {r.doc_id: r for r in word_bpe.encode_digest(documents(spark, docs), PATH).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        ids, text = expected(library, t)
        assert (got[k].n_tokens, bytes(got[k].ids), got[k].ids_sha256, got[k].decoded_sha256) == (len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), repr(t)[:200]


def test_many_texts_and_forgetting(library, own):
    some = texts(5, 2000)
    for i in range(0, len(some), 500):
        part = some[i : i + 500]
        for t, ids in zip(part, own.encode(part), strict=True):
            assert (ids, own.decode(ids)) == expected(library, t), repr(t)
    assert own.older  # a generation was left behind on the way
    assert own.failed


def test_pairs_are_tested_as_merging_says(own):
    m, rng = own.merges, random.Random(7)
    inner = list(m.inner.items())
    inner.sort(key=lambda x: len(x[0]))
    both = inner + list(m.final.items())
    names = {t: s for s, t in m.vocab.items()}
    pairs = [(rng.choice(inner[:4000])[1], rng.choice(both)[1]) for _ in range(6000)] + [(rng.choice(inner[:600])[1], rng.choice(inner[:600])[1]) for _ in range(6000)]
    ok = m.compatible(*np.array(pairs).T)
    true = [m.merged(m.symbols(names[a]) + m.symbols(names[b]))[0] == [a, b] for a, b in pairs]
    assert ok.tolist() == true
    assert 0 < sum(true) < len(true)


def test_rows_merge_as_the_heap_does(own):
    m, rng = own.merges, random.Random(8)
    words = ["".join(rng.choice("abcdeihtnsz") for _ in range(rng.randint(1, 16))) for _ in range(500)]
    rows = np.full((500, 16), m.size)
    for row, w in zip(rows, words, strict=True):
        row[: len(w)] = m.symbols(w + m.suffix)
    for w, row in zip(words, m.merged_rows(rows).tolist(), strict=True):
        assert [x for x in row if x != m.size] == m.merged(m.symbols(w + m.suffix))[0]


def test_overlapping_repeats_merge_from_the_left():
    m = word_bpe.Merges({"a": 0, "a.": 1, "aa": 2, "aa.": 3, "aaa": 4, "b": 5, "b.": 6}, [("a", "a"), ("a", "a."), ("aa", "a")], ".")
    for n in range(1, 12):
        assert m.encode(["a" * n])[0] == [m.merged(m.symbols("a" * n + "."))[0]]
    assert m.encode(["aaa"])[0] == [[2, 1]]


def test_a_token_that_merging_never_gives_is_not_proposed():
    m = word_bpe.Merges({"a": 0, "b": 1, "c": 2, "c.": 3, "ab": 4, "bc": 5, "abc": 6, "b.": 7, "a.": 8}, [("b", "c"), ("a", "b"), ("ab", "c")], ".")
    assert "abc" not in m.inner and m.encode(["abcc", "abcb"])[0] == [[0, 5, 3], [0, 5, 7]]


def test_repeated_rows_and_empty_table(spark):
    assert len(word_bpe.encode_digest(documents(spark, [(1, "one two"), (1, "one two")]), PATH).collect()) == 2
    assert word_bpe.encode_digest(documents(spark, []), PATH).count() == 0


def test_other_kinds_of_vocabulary_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = None
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="lower case"):
        word_bpe.WordBpe(str(tmp_path / "x.json"))
