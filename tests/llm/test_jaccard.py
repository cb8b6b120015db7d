import random

import pytest

from releaselode.llm import jaccard

from .helpers import AWKWARD, documents


def brute(docs):
    """doc row -> (shingles, smallest id reachable)."""
    sets = []
    for _, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in low).split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for i, (k, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), k), k)
    return sorted((k, len(sets[i]), low[find(i)]) for i, (k, _) in enumerate(docs))


def make(seed, base_len, copies, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [rng.choice(vocab) for _ in range(30)]
    docs = []
    for g in range(8):
        base = [rng.choice(vocab) for _ in range(base_len)]
        if g % 2:
            base[5:5] = shared
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w))
    docs += docs[:7] + ["Alone " * 3, "", None, " \t"]
    rng.shuffle(docs)
    return [(1000 - 3 * i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,base_len,copies,edits", [(1, 60, 12, 5), (2, 150, 9, 14), (3, 20, 12, 3), (4, 6, 6, 3)])
def test_against_brute_force(spark, seed, base_len, copies, edits):
    docs = make(seed, base_len, copies, edits)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(spark, docs), range_tokens=500).collect())
    assert got == brute(docs)


def test_awkward_rows(spark):
    rows = jaccard.near_duplicates(documents(spark)).collect()
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == brute([d for d in AWKWARD if d[0] is not None])
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(7, None)]
    assert jaccard.near_duplicates(documents(spark, [])).count() == 0


def test_null_keys_are_linked(spark):
    base = [f"w{i}" for i in range(40)]
    near, far = [*base[:-1], "x"], [f"v{i}" for i in range(40)]
    docs = [(None, " ".join(base)), (7, " ".join(near)), (None, " ".join(far)), (None, " ".join([*far[:-1], "y"])), (9, " ".join(base[::-1])), (None, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_duplicates(documents(spark, docs)).collect())
    assert got == [(0, 0, 0), (0, 36, 0), (0, 36, 0), (0, 36, 7), (7, 36, 7), (9, 36, 9)]


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 30], "a long, b long")
    got = {r.node: r.label for r in jaccard.components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(n + 1)}


def test_families_in_blocks(spark):
    docs = make(9, 40, 25, 16)
    import pyspark.sql.functions as F

    sets = jaccard.stored(jaccard.class_sets(documents(spark, docs), spark.createDataFrame([(k,) for k, _ in docs], "rep long"), 5).where("n > 0"), "sets")
    links = jaccard.stored(jaccard.set_links(sets, 75, 12, block=5), "links")
    label = {r.node: r.label for r in jaccard.components(links).collect()}
    assert sorted((k, label.get(k, k)) for k, t in docs if (t or "").strip()) == [(k, c) for k, n, c in brute(docs) if n]
    assert links.where(F.col("a") >= F.col("b")).count() == 0


def test_shared_counts():
    import numpy as np

    rng = random.Random(1)
    lists = lambda n: [np.array(sorted(rng.sample(range(60), rng.randrange(1, 30)))) for _ in range(n)]
    a, b = lists(7), lists(9)
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]
    assert jaccard._Index(a).shared(b).tolist() == want


def test_keys_of_several_texts(spark):
    docs = make(5, 40, 8, 5)
    rows = [(k // 9, t) for k, t in docs]  # three texts to a key
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(spark, rows), range_tokens=500).collect())
    assert got == brute(rows)
    # one key on unrelated texts, each with a partner
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (1, None)]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(documents(spark, rows)).collect())
    assert got == brute(rows) == [(1, 0, 1), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1)]
