import math
import random
import re

import pytest

from releaselode.llm import quality

from .helpers import AWKWARD, documents


def brute(t):
    t = t or ""
    words = [w for w in re.split(quality.SPACE, t) if w]
    lines = [x for x in t.split("\n") if re.search(quality.WORD, x)]
    seen: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(quality.SYMBOLS, t)), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n


def test_base_columns(spark):
    rng = random.Random(6)
    docs = [(i, t) for i, (_, t) in enumerate(AWKWARD)]
    for i in range(60):
        part = " ".join(rng.choice(["a", "bb", "c#", "<d>", "é", "\n", "e\nf"]) for _ in range(rng.randrange(60)))
        docs.append((100 + i, part + rng.choice(["", part, "\n" + part])))
    got = {r.doc_id: r for r in quality.divergence_rules(documents(spark, docs)).collect()}
    for k, t in docs:
        assert tuple(got[k])[1:7] == brute(t), repr(t)
        assert not (got[k].base_failed and got[k].kept)


def test_distance(spark):
    def js(p, r):
        p = [x / sum(p) for x in p]
        t = lambda a, m: a * math.log2(a / m) if a else 0
        return math.sqrt(sum(t(a, (a + b) / 2) + t(b, (a + b) / 2) for a, b in zip(p, r, strict=True)) / 2)

    text = "The cat of THE house and the 12 dogs in # is a thing that it was on, for one." * 4
    r = quality.divergence_rules(documents(spark, [(1, text)])).first()
    chars, words, shares = quality.REFERENCES["en"]
    tokens = text.split()
    counts = [tokens.count(w) for w in words.split()]
    assert r.word_distance == pytest.approx(js([*counts, len(tokens) - sum(counts)], shares))
    kinds = [sum(c.isupper() for c in text), sum(c.isdigit() for c in text), text.count("#"), sum(c in ",." for c in text), text.count(" ")]
    assert r.char_distance == pytest.approx(js([len(text) - sum(kinds), *kinds], chars))


def test_verdicts(spark):
    rng = random.Random(1)
    shares = dict(zip(quality.REFERENCES["en"][1].split(), quality.REFERENCES["en"][2], strict=False))
    letters = "etaoinshrdlu"
    clean, shouted, table = [], [], []
    for i in range(400):
        w = next((w for w, p in shares.items() if rng.random() < p * 1.15), "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))))
        clean.append(w + ("." if i % 12 == 11 else ""))
    shouted = [w.upper() + "!!" for w in clean]
    table = ["".join(rng.choice(letters) for _ in range(6)) + " |" for _ in range(400)]
    docs = documents(spark, [(i, " ".join(x)) for i, x in enumerate([clean, shouted, table])])
    assert [r.kept for r in quality.divergence_rules(docs).orderBy("doc_id").collect()] == [True, False, False]
    out = quality.keep_documents(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]
    unknown = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert all(r.kept for r in quality.divergence_rules(unknown).collect())
    assert quality.divergence_rules(docs.limit(0)).count() == 0
