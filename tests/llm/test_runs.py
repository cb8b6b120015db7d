import hashlib
import random
import zlib
from array import array
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from releaselode.llm import runs

from .helpers import AWKWARD, documents


def brute(x):
    """Maximal stretches of every period, with the smallest period of each."""
    n, found = len(x), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def made(rng):
    """Words with repeats within repeats, and copies of stretches that hold runs."""
    x = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(0, 30))]
    for _ in range(rng.randint(0, 5)):
        if not x:
            break
        a = rng.randrange(len(x))
        piece = x[a : a + rng.randint(1, 12)] * rng.choice([1, 1, 2, 4, 5, 6, 9])
        at = rng.choice([len(x), rng.randrange(len(x) + 1)])
        x = x[:at] + piece[: rng.randint(1, len(piece))] + x[at:]
    return x


def test_runs_by_brute_force():
    rng = random.Random(3)
    docs = [made(rng) for _ in range(4000)]
    docs += [[rng.randint(0, 1) for _ in range(rng.randint(1, 60))] for _ in range(1500)] + [[0] * n for n in range(40)]
    got = runs.find_runs(docs)
    assert got == [brute(x) for x in docs]
    assert sum(map(bool, got)) > 1500 and max(map(len, got)) > 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=25), st.integers(1, 6), st.lists(st.integers(0, 2), max_size=25), st.integers(0, 3))
def test_runs_inside_copied_blocks(a, k, b, c):
    x = (a * k + b) * (c + 1) + a
    assert runs.find_runs([x]) == [brute(x)]


def test_batches_don_t_change_results(monkeypatch):
    rng = random.Random(5)
    docs = [made(rng) for _ in range(300)]
    whole = runs.find_runs(docs)
    monkeypatch.setattr(runs, "TOGETHER", 7)
    assert runs.find_runs(docs) == whole


def test_factors_blocks_and_ranks():
    rng = random.Random(6)
    for _ in range(200):
        x = made(rng)
        n = len(x)
        rank, live = runs.split_ranks(np.array(x, np.int64), np.full(n, n))
        assert not len(live) and np.argsort(rank).tolist() == sorted(range(n), key=lambda i: x[i:])
        size, source = runs.previous_factors(array("i", x), array("i", rank.tolist()))
        for i in range(n):
            true = max((next((h for h in range(n - i) if x[i + h] != x[j + h]), n - i) for j in range(i)), default=0)
            assert size[i] == true
            assert not true or (source[i] < i and x[source[i] : source[i] + true] == x[i : i + true])
        starts = runs.blocks_of(size)
        assert starts[-1] == n and all(z - a == max(1, size[a]) for a, z in zip(starts, starts[1:], strict=False))


def expected(key, text, plant):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(key).encode())
    if plant and key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()), [dict(zip(("start", "length", "period"), r)) for r in found], kept.decode()


def test_query_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, t) for i, (_, t) in enumerate(AWKWARD)] + [(100 + i, " ".join(f"w{v}" for v in made(rng))) for i in range(300)] + [(None, "no key " * 9), (-3, "a b c d " * 30)]
    planted = 0
    for plant in (True, False):
        got = {r.doc_id: r for r in runs.periodic_runs(documents(spark, rows), runs.planted_words if plant else None).collect()}
        assert len(got) == len(rows)
        for k, t in rows:
            row, found, kept = expected(k, t, plant)
            assert tuple(got[k])[1:8] == row, (k, t)
            assert [r.asDict() for r in got[k].runs] == found and got[k].collapsed == kept
            planted += plant and zlib.crc32(str(k).encode()) % 10 == 0
    assert planted > 20


def test_repeated_rows_and_empty_table(spark):
    assert len(runs.periodic_runs(documents(spark, [(1, "x " * 20), (1, "x " * 20)]), full=False).collect()) == 2
    assert runs.periodic_runs(documents(spark, [])).count() == 0


def test_long_text_of_one_word():
    n = 200_000
    assert runs.find_runs([["a"] * n]) == [[(0, n, 1)]]
    assert runs.find_runs([["a", "b"] * (n // 2)]) == [[(0, n, 2)]]
