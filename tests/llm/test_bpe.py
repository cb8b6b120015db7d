import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from releaselode.llm import bpe
from releaselode.llm.common import tokenizer_path

from .helpers import AWKWARD, documents

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("long_word", [256, 6])
def test_equals_library(spark, library, long_word):
    rng = random.Random(2)
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD)] + [(None, "a row without a key")]
    docs += [(100 + i, "".join(rng.choice(["ab", "tion", "'s", ",", " ", "\n", "\t", "é", "7", " ", "ñ", "ing", "東"]) for _ in range(80))) for i in range(60)]
    got = {r.doc_id: r for r in bpe.encode_digest(documents(spark, docs), PATH, public_tokenizers.PATTERN, chunk_bytes=5000, long_word=long_word).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        ids = library.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (got[k].n_tokens, bytes(got[k].ids), got[k].ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest()), repr(t)
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "one two"), (1, "one two")])
    assert len(bpe.encode_digest(docs, PATH, public_tokenizers.PATTERN).collect()) == 2
    assert bpe.encode_digest(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0


def test_long_words_merge_as_short_ones(library):
    ranks = bpe.load_ranks(PATH)
    rng = random.Random(4)
    for n in [*range(1, 60), 3000]:
        w = bytes(rng.choice(b"aabnthe\xc3\xa9 ") for _ in range(n))
        assert bpe.merge_long(w, ranks) == library._encode_single_piece(w)


def test_chunks_are_named_by_their_content(spark, tmp_path):
    """The same rows give the same chunk again, rows in another order one of its own."""
    rows = [(1, "one two three"), (2, "four five six"), (3, ""), (4, None)]

    def chunks(some):
        got = bpe.dealt_words(documents(spark, some).coalesce(1), tmp_path.as_uri(), public_tokenizers.PATTERN, 1 << 20, 3).collect()
        return {r.chunk for r in got}

    first = chunks(rows)
    assert len(first) == 1 and chunks(rows) == first and chunks(rows[::-1]) != first
    assert all((tmp_path / f"chunk-{c:016x}").is_file() for c in first | chunks(rows[::-1]))
