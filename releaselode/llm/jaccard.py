"""N-gram Jaccard join with adaptive multi-match prefixes, and its connected components.

A document's set are its distinct shingles of `width` words, as 64-bit hashes. Sets are ordered from rare to frequent
shingles. Two sets of sizes a and b that overlap enough share at least l shingles within their first
size - need + l ones, for every l; so the prefix of a document is lengthened while its estimated cost (postings read, and
candidates to verify, which are fewer when l matches are required) falls, and a pair is verified only if its prefixes
share as many shingles as the smaller of its two l.

Order of work, with what bounds each step:
1. Classes of equal sets: one digest per document, partial aggregation.
2. Which classes can have a partner at all: a shingle that no other class has costs prefix positions but gives no
   candidate, so a class whose shared shingles are fewer than the overlap it needs is done. Shingles are counted in
   packed blocks by hash range (about `range_tokens` in a task).
3. The others are joined by prefixes. First each is verified against one pivot of its postings, the smallest class,
   which links large groups of near copies at a cost linear in their size. Posting lists that still have several
   components form families by their main one; the documents outside of it are held in blocks, the family streams past,
   and pairs with enough shared prefix shingles are verified in place. No pair is emitted but links that connect.
4. Components by label propagation with pointer jumping on stored tables; nothing about documents reaches the driver
   but counts.

Null, empty or blank text: an empty set, linked with nothing. Fewer words than `width`: the sequence is the one shingle. A very long
text is one set of 8 bytes a shingle in the task that cuts it. Rows that repeat a key, with equal or different texts: linked as
any copies. Null keys: linked likewise; component_id is null where all keys of a component are. Ties in frequency are broken by
hash. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_task_end, map_arrow, slices, stored, texts_of

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
MOST_BROADCAST = 500_000


class _Hashes(dict):
    def __missing__(self, w):
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_words = _Hashes()
at_task_end.append(_words.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, np.uint64(min(len(h), width)), np.uint64)
    for k in range(min(width, len(h))):
        acc = (acc ^ (acc >> np.uint64(29))) * _ODD[k % len(_ODD)] + h[k : k + n]
    return np.unique(_mixed(acc))


def _digest(s: np.ndarray) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(s.tobytes())) if len(s) else (0, 0)


def document_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id long, n int, s1 long, s2 long: the size and the digest of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            d = [_digest(s) for s in sets]
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64())], names=["doc_id", "n", "s1", "s2"])

    return map_arrow(texts_of(docs), run, "doc_id long, n int, s1 long, s2 long")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blocks by their number, from rows sorted by it."""
    now, blocks = None, []
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != now and blocks:
                yield now, blocks
                blocks = []
            now = k
            blocks.append(x)
    if blocks:
        yield now, blocks


def sharing_classes(docs: DataFrame, width: int, percent: int, tokens: int, classes: int, range_tokens: int) -> DataFrame:
    """s1 long of the classes whose shingles that other classes have too are as many as a partner needs."""
    spark = docs.sparkSession
    ranges = max(1, -(-tokens // range_tokens))
    groups = max(1, -(-classes // 200_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        digests: list[int] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal sets, digests, seen, size
            sizes = np.array([len(s) for s in sets], np.uint32)
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            part = (((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint32)
            order = np.argsort(part.astype(np.uint16) if ranges < 1 << 16 else part, kind="stable")
            part, owner, low = part[order], owner[order], flat[order].astype(np.uint32)
            s1 = np.array(digests, np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = []
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                o = owner[a:z]
                heads = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
                who = o[heads]
                counts = np.diff(np.append(heads, len(o))).astype("<u4")
                out.append((int(part[a]), struct.pack("<I", len(who)) + s1[who].tobytes() + sizes[who].astype("<u4").tobytes() + counts.tobytes() + low[a:z].tobytes()))
            sets, digests, seen, size = [], [], set(), 0
            return pa.record_batch([pa.array([x for x, _ in out], pa.int32()), pa.array([y for _, y in out], pa.binary())], names=["part", "block"])

        for b in slices(batches, 1024):
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                d = _digest(s)
                if not len(s) or d in seen:
                    continue
                seen.add(d)
                sets.append(s)
                digests.append(d[0])
                size += len(s)
                if size > 1_500_000:
                    yield close()
        if sets:
            yield close()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _by_group(batches):
            s1, n, per, low = [], [], [], []
            for x in blocks:
                k = struct.unpack_from("<I", x)[0]
                s1.append(np.frombuffer(x, "<i8", k, 4))
                n.append(np.frombuffer(x, "<u4", k, 4 + 8 * k))
                per.append(np.frombuffer(x, "<u4", k, 4 + 12 * k))
                low.append(np.frombuffer(x, "<u4", -1, 4 + 16 * k))
            s1, n, per, low = (np.concatenate(x) for x in (s1, n, per, low))
            ids, first = np.unique(s1, return_index=True)
            keep = np.zeros(len(s1), bool)
            keep[first] = True  # one of each class
            entry = np.repeat(np.arange(len(s1)), per)
            mine = keep[entry]
            low, entry = low[mine], entry[mine]
            order = np.argsort(low)
            edge = np.concatenate([[0], np.flatnonzero(np.diff(low[order])) + 1, [len(low)]])
            df = np.repeat(np.diff(edge), np.diff(edge))
            shared = np.bincount(entry[order][df > 1], minlength=len(s1))
            got = np.flatnonzero(shared)
            to = np.mod(s1[got], groups)
            for g in np.unique(to).tolist():
                i = got[to == g]
                yield pa.record_batch([pa.array([g], pa.int32()), pa.array([struct.pack("<I", len(i)) + s1[i].tobytes() + n[i].tobytes() + shared[i].astype("<u4").tobytes()], pa.binary())], names=["part", "block"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _by_group(batches):
            sums: np.ndarray | None = None
            rows = []
            for x in blocks:
                k = struct.unpack_from("<I", x)[0]
                rows.append(np.rec.fromarrays([np.frombuffer(x, "<i8", k, 4), np.frombuffer(x, "<u4", k, 4 + 8 * k), np.frombuffer(x, "<u4", k, 4 + 12 * k)], names="s1,n,m"))
                if len(rows) >= 64:
                    rows = [_summed(rows)]
            sums = _summed(rows)
            ok = sums["m"].astype(np.int64) * 100 >= sums["n"].astype(np.int64) * percent
            yield pa.record_batch([pa.array(np.ascontiguousarray(sums["s1"][ok]))], names=["s1"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = map_arrow(texts_of(docs), deal, "part int, block binary").repartition(max(1, min(ranges, 4 * parts)), "part").sortWithinPartitions("part")
    counted = map_arrow(dealt, count, "part int, block binary").repartition(max(1, min(groups, parts)), "part").sortWithinPartitions("part")
    return map_arrow(counted, add, "s1 long")


def _summed(rows: list[np.ndarray]) -> np.ndarray:
    s1, n, m = (np.concatenate([r[c] for r in rows]) for c in ("s1", "n", "m"))
    ids, first, inverse = np.unique(s1, return_index=True, return_inverse=True)
    return np.rec.fromarrays([ids, n[first], np.bincount(inverse, m, len(ids)).astype("<u4")], names="s1,n,m")


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, to be broadcast if its rows are few; df must be cheap to count."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def class_sets(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep long, n int, set array<long> of the documents whose ids are in reps(rep).

    With reps(rep, doc_id, s1, s2): of the classes with these digests, as several texts may have one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            d = [_digest(s) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in d], pa.int64()), pa.array([y for _, y in d], pa.int64()), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["rep", "s1", "s2", "n", "set"])

    by_digest = "s1" in reps.columns
    ids = reps.select("doc_id").distinct() if by_digest else reps.withColumnRenamed("rep", "doc_id")
    keyless = lambda df: df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    found = map_arrow(keyless(texts_of(docs)).join(small(keyless(ids)), "doc_id", "left_semi"), run, "rep long, s1 long, s2 long, n int, set array<long>")
    if not by_digest:
        return found.select("rep", "n", "set").dropDuplicates(["rep"])
    return found.drop("rep").dropDuplicates(["s1", "s2"]).join(small(reps.select("rep", "s1", "s2")), ["s1", "s2"]).select("rep", "n", "set")


def choose_prefixes(ranked: DataFrame, percent: int, longest: int) -> DataFrame:
    """rep, n, l int, prefix array<long>. ranked: rep, n, shared: array of (df, token) in ascending order, df > 1.

    Cost of l: the postings of the prefix are read; those that can match l times are at most their sum / l (Markov's
    bound), and each is verified over about n shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            reps, ns, ls, prefixes = [], [], [], []
            lists = b.column(2)
            for i in range(b.num_rows):
                flat = lists[i].values
                df, token = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                n = b.column(1)[i].as_py()
                need = -(-n * percent // 100)
                base = n - need - (n - len(df))  # shared shingles among the first n - need
                if base < 0:
                    continue
                reads = np.concatenate([[0], np.cumsum(df - 1)])
                most = min(longest, need)
                upto = np.minimum(base + np.arange(1, most + 1), len(df))
                cost = reads[upto] * (1 + 0.2 * n / np.arange(1, most + 1))
                m = int(np.argmin(cost))
                reps.append(b.column(0)[i].as_py())
                ns.append(n)
                ls.append(m + 1)
                prefixes.append(token[: upto[m]])
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(ns, pa.int32()), pa.array(ls, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], names=["rep", "n", "l", "prefix"])

    return map_arrow(ranked, run, "rep long, n int, l int, prefix array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", both.alias("i"))
    return rows.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node long, label long: the smallest node that is reachable, for each node of links(a, b)."""
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-0")
    for i in range(1, 100):
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = step.join(up, "label").select("node", F.least("label", "up").alias("label"), "old")
        after = stored(after, f"{name}-{i}")
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, range_tokens: int = 1_500_000, longest: int = 12) -> DataFrame:
    """doc_id long, n_shingles long, component_id long: one row per document.

    Links: 100 * intersection >= percent * union."""
    base = stored(document_sets(docs, width), "document-sets")
    classes = stored(base.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    total = classes.agg(F.sum(F.col("n").cast("long") * F.col("copies")).alias("t"), F.count("*").alias("c")).first()
    # a class goes by its smallest key; of several classes with that key all but one go by their digest, as do those without a key
    twice = classes.where("first is not null").groupBy("first").agg(F.count("*").alias("c"), F.min(F.struct("s1", "s2")).alias("own")).where("c > 1")
    twice = stored(twice.select("first", "own"), "keys-of-several-classes")
    clash = not (twice.isEmpty() and classes.where("first is null").isEmpty())
    if clash:
        other = F.col("first").isNull() | (F.struct("s1", "s2") != F.col("own"))
        named = classes.join(small(twice), "first", "left").withColumn("rep", F.when(other, F.col("s1")).otherwise(F.col("first")))
        classes = stored(named.select("s1", "s2", "n", "first", "copies", "rep"), "named-by-digest")
    else:
        classes = classes.withColumn("rep", F.col("first"))
    sharing = stored(sharing_classes(docs, width, percent, total["t"] or 0, total["c"], range_tokens), "sharing-classes")
    reps = stored(classes.join(small(sharing), "s1", "left_semi").select("rep", F.col("first").alias("doc_id"), "s1", "s2"), "sharing-reps")
    sets = stored(class_sets(docs, reps, width), "class-sets")
    links = set_links(sets, percent, longest)
    label = components(links)
    if clash:  # the label may be a digest: the smallest key of the component's classes instead
        known = label.join(classes.select(F.col("rep").alias("node"), "first"), "node")
        label = stored(known.join(known.groupBy("label").agg(F.min("first").alias("key")), "label").select("node", F.col("key").alias("label")), "labels-by-key")
    named = classes.join(small(label.withColumnRenamed("node", "rep")), "rep", "left").select("s1", "s2", "n", F.coalesce("label", "first").alias("class_id"), "copies", F.col("label").isNotNull().alias("linked"))
    named = stored(named.where("copies > 1 or linked").select("s1", "s2", "n", "class_id"), "named-classes")
    rows = base.join(named, ["s1", "s2", "n"], "left")
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("component_id"))


def set_links(sets: DataFrame, percent: int, longest: int, block: int = 256) -> DataFrame:
    """a, b: enough links between sets(rep, n, set) that any two similar ones are connected. sets is stored."""
    token = sets.select("rep", "n", F.explode("set").alias("token"))
    df = token.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = token.join(df, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    prefixes = stored(choose_prefixes(ranked, percent, longest), "prefixes")
    postings = stored(prefixes.select("rep", "n", "l", F.explode("prefix").alias("token")), "postings")
    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)

    # pivots: one candidate for each document, from all of its postings
    pivot = postings.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("token", F.col("p.rep").alias("a"), F.col("p.n").alias("na"))
    tried = postings.join(pivot, "token").where((F.col("a") < F.col("rep")) & fits("n", "na")).groupBy("rep", "a").agg(F.count("*").alias("c"))
    best = tried.groupBy("rep").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", F.col("rep").alias("b"))
    first = stored(verified(best, sets, percent), "pivot-links")
    label = components(first, "pivots")

    # what is left: families of postings with several components
    known = postings.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("token", "rep", F.coalesce("label", "rep").alias("comp"))
    known = stored(known, "postings-by-component")
    main = known.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").select("token", "main")
    family = stored(known.join(main, "token").groupBy("rep", "main").agg(F.first("comp").alias("comp")), "families")
    blocks = family.where("comp != main").groupBy("main").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    family = family.join(blocks, "main")
    outside = family.where("comp != main").select("main", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block"), F.lit(0).alias("turn"), "rep", "comp")
    turn = F.when(F.col("comp") == F.col("main"), 1).otherwise(2)
    inside = family.select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), turn.alias("turn"), "rep", "comp")
    full = sets.join(prefixes.select("rep", "l", "prefix"), "rep")
    rows = outside.union(inside).join(full, "rep").select("main", "block", "turn", "comp", "rep", "n", "l", "prefix", "set", F.xxhash64("rep").alias("mixed"))
    rows = rows.repartition("main", "block").sortWithinPartitions("main", "block", "turn", "mixed").drop("mixed")
    return first.union(stored(family_links(rows, percent), "family-links"))


class _Index:
    """Postings of a block's documents: which of them have a token."""

    def __init__(self, lists: list[np.ndarray]):
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(flat, kind="stable")
        self.n, self.owner = len(lists), owner[order]
        self.tokens, self.starts = np.unique(flat[order], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(flat)))

    def shared(self, lists: list[np.ndarray]) -> np.ndarray:
        """Tokens that each document of the block (row) and each of the lists (column) have in common."""
        out = np.zeros(self.n * len(lists), np.int32)
        if not len(self.tokens) or not lists:
            return out.reshape(self.n, len(lists))
        flat = np.concatenate(lists)
        column = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        at = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        hit = self.tokens[at] == flat
        at, column = at[hit], column[hit]
        size = self.counts[at]
        ends = np.cumsum(size)
        for a in range(0, int(ends[-1]) if len(ends) else 0, 1 << 22):  # a bounded number of matches at once
            i, j = np.searchsorted(ends, [a, a + (1 << 22)], side="right")
            j = min(j + 1, len(ends))
            w = np.arange(max(a, 0), min(a + (1 << 22), int(ends[-1])))
            which = np.searchsorted(ends[i:j], w, side="right") + i
            row = self.owner[self.starts[at[which]] + w - (ends[which] - size[which])]
            out += np.bincount(row * len(lists) + column[which], minlength=len(out)).astype(np.int32)
        return out.reshape(self.n, len(lists))


def family_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect the components of each family as far as any similar pair does.

    rows: main, block, turn, comp, rep, n, l, prefix, set, sorted. First come the block's documents, which are outside of the main
    component and held in memory; then the whole family streams past, members of the main component first. A document that
    has been connected with the main component is done: pairs of two such documents connect nothing, and any other
    document of the family is in a block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        parent: dict[int, int] = {}
        open_rows: np.ndarray = np.zeros(0, np.int64)
        index: tuple[_Index, _Index] | None = None

        def find(x: int) -> int:
            while (y := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[y] if y in parent else y
            return x

        def against(part: list[tuple], main: int) -> list[tuple[int, int]]:
            nonlocal open_rows, index
            if index is None:
                open_rows = np.arange(len(held))
                index = (_Index([h[3] for h in held]), _Index([h[4] for h in held]))
            got = []
            if not len(open_rows):
                return got
            x = [held[i] for i in open_rows]
            enough = np.minimum(np.array([h[2] for h in x])[:, None], np.array([y[2] for y in part])[None, :])
            maybe = index[0].shared([y[3] for y in part]) >= enough
            maybe &= np.array([h[5] for h in x])[:, None] != np.array([y[5] for y in part])[None, :]
            some = np.flatnonzero(maybe.any(axis=0))
            if not len(some):
                return got
            both = index[1].shared([part[j][4] for j in some]).astype(np.int64)
            union = np.array([h[1] for h in x])[:, None] + np.array([part[j][1] for j in some])[None, :] - both
            for i, j in np.argwhere(maybe[:, some] & (both * 100 >= union * percent)).tolist():
                a, b = find(x[i][5]), find(part[some[j]][5])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    got.append((min(x[i][0], part[some[j]][0]), max(x[i][0], part[some[j]][0])))
            top = find(main)
            left = np.array([find(h[5]) != top for h in x])
            if left.sum() <= len(left) * 0.8:
                open_rows = open_rows[left]
                index = (_Index([held[i][3] for i in open_rows]), _Index([held[i][4] for i in open_rows]))
            return got

        now, size = None, 16
        for b in batches:
            main, block, turn, comp, rep, n, ls = (b.column(c).to_numpy() for c in range(7))
            prefix, full = b.column(7), b.column(8)
            row = lambda i: (int(rep[i]), int(n[i]), int(ls[i]), prefix[i].values.to_numpy(), full[i].values.to_numpy(), int(comp[i]))  # noqa: B023, E731
            i = 0
            while i < b.num_rows:
                if (main[i], block[i]) != now:
                    now, held, parent, index, size = (main[i], block[i]), [], {}, None, 16
                if turn[i] == 0:
                    held.append(row(i))
                    i += 1
                    continue
                j = i
                while j < b.num_rows and j - i < size and (main[j], block[j]) == now:
                    j += 1
                links = against([row(k) for k in range(i, j)], int(main[i]))
                size = min(512, size * 2)
                i = j
                if links:
                    yield pa.record_batch([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return map_arrow(rows, run, "a long, b long")
