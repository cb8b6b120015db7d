import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from releaselode.llm import gru

from .helpers import AWKWARD, documents


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]


def corpus(n=400):
    rng = random.Random(3)
    tongues = [[f"{k}{i}" for i in range(150)] for k in "xyz"]
    docs = []
    for i in range(n):
        t = tongues[i % 3]
        docs.append((i, " ".join(t[min(int(rng.expovariate(0.05)), 149)] for _ in range(rng.randrange(5, 120)))))
    return docs + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]


def test_base_and_gain(spark):
    docs = corpus()
    out = zlib.crc32
    train = Counter()
    for k, t in docs:
        if out(str(k).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    rows = gru.document_scores(documents(spark, docs), params=gru.GruParams(chunk_bytes=9000, batch=32, range_words=300)).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        w = [*words(texts[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(str(r.doc_id).encode()) % 7 == 2, len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru.document_scores(documents(spark, [])).count() == 0
    one = gru.document_scores(documents(spark, [(1, "a b a"), (1, "a b a")])).collect()
    assert len(one) == 2 and one[0] == one[1]


def test_members_are_a_distribution():
    stats = np.zeros((2, 3, gru.BUCKETS, gru.HASHES), np.int64)
    counts = {0: [9, 5, 5, 2, 1, 1], 1: [100, 1], 2: []}
    singles = np.zeros(gru.HASHES, np.int64)
    for g, cs in counts.items():
        for i, c in enumerate(cs):
            stats[0, g, gru.bucket(np.array(c)), i % gru.HASHES] += 1
            stats[1, g, gru.bucket(np.array(c)), i % gru.HASHES] += c
            singles[i % gru.HASHES] += c == 1
    v = gru.vocabulary(np.append(stats.reshape(-1), singles), 3, 4, 3)
    assert (v.tokens, v.types) == (9 + 5 + 5 + 2 + 1 + 1 + 101 + 4, 9)
    mass = v.mass.reshape(-1)
    inside = Counter()
    for g, cs in counts.items():
        for i, c in enumerate(cs):
            k = int(v.of[g, gru.bucket(np.array(c)), i % gru.HASHES])
            inside[k] += c / mass[k]
    rare = (v.classes - 2) * gru.MEMBERS
    inside[rare] += 1 / mass[rare]  # the unknown type
    assert all(x == pytest.approx(1) for x in inside.values())
    assert set(inside) == set(np.flatnonzero(mass[: -gru.MEMBERS]).tolist())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    mass = rng.integers(0, 9, (5, gru.MEMBERS)) + (np.arange(gru.MEMBERS) == 0)
    net = gru.Gru.start(mass, 4, 1)
    h = np.repeat(rng.normal(size=(3, 4)).astype(np.float32), 5 * gru.MEMBERS, axis=0)
    p = np.exp(net.log_likelihood(h, np.tile(np.arange(5 * gru.MEMBERS), 3))).reshape(3, -1)
    assert p.sum(axis=1) == pytest.approx([1, 1, 1], rel=1e-5) and p[:, mass.reshape(-1) == 0].max() < 1e-20


def by_hand(net, sequence):
    """log P of a sequence of members in plain loops and 64-bit numbers."""
    sig = lambda a: 1 / (1 + math.exp(-a))
    k, h, last, total = net.h, [0.0] * net.h, net.start_token, 0.0
    x, u, w, b, v, d = (getattr(net, n).astype(float) for n in ("x", "u", "w", "b", "v", "d"))
    for m in sequence:
        gh = [sum(h[i] * u[i, j] for i in range(k)) for j in range(3 * k)]
        z = [sig(x[last, j] + gh[j]) for j in range(k)]
        r = [sig(x[last, k + j] + gh[k + j]) for j in range(k)]
        n = [math.tanh(x[last, 2 * k + j] + r[j] * gh[2 * k + j]) for j in range(k)]
        h = [(1 - z[j]) * n[j] + z[j] * h[j] for j in range(k)]
        c, i = divmod(int(m), gru.MEMBERS)
        outer = [b[q] + sum(h[j] * w[j, q] for j in range(k)) for q in range(net.c)]
        inner = [d[c, q] + sum(h[j] * v[c, q, j] for j in range(k)) for q in range(gru.MEMBERS)]
        total += outer[c] - math.log(sum(map(math.exp, outer))) + inner[i] - math.log(sum(map(math.exp, inner)))
        last = int(m)
    return total


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = gru.Gru.start(np.ones((5, gru.MEMBERS)), 4, 1)
    top = 5 * gru.MEMBERS
    x, y = rng.integers(0, top + 1, (6, 3)), rng.integers(-1, top, (6, 3))
    h = rng.normal(size=(3, 4)).astype(np.float32)
    grad, *_ = net.gradient(x, y, h)
    count = (y >= 0).sum()
    for i in rng.permutation(np.concatenate([np.flatnonzero(grad)[::9], rng.choice(len(net.flat), 20)])):
        old, loss = net.flat[i], []
        for e in (1e-2, -1e-2):
            net.flat[i] = old + e
            loss.append(net.gradient(x, y, h)[2] / count)
        net.flat[i] = old
        assert grad[i] == pytest.approx((loss[0] - loss[1]) / 2e-2, abs=2e-3)


def test_score_by_hand_over_windows():
    rng = np.random.default_rng(1)
    net = gru.Gru.start(rng.integers(1, 9, (5, gru.MEMBERS)), 4, 1)
    seqs = [rng.integers(0, 5 * gru.MEMBERS, n) for n in (1, 7, 90, 33, 90)]
    want = [by_hand(net, s) for s in seqs]
    for window in (4, 32):
        assert net.score(seqs, window) == pytest.approx(want, rel=1e-4)


def test_null_keys(spark):
    rows = gru.document_scores(documents(spark, [(None, "a b"), (3, "a b"), (None, None)])).collect()
    assert not gru.held_out(3)
    assert sorted((r.doc_id is None, r.held_out, r.n_tokens) for r in rows) == [(False, False, 3), (True, False, 1), (True, False, 3)]
    assert {r.train_tokens for r in rows} == {7}
