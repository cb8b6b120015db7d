"""Language-model scores: a gated recurrent network in numpy with a class-factored output softmax.

log P(text) = sum over tokens of log P(class | state) + log P(member | class, state) + log P(token | member). The state is that
of one GRU, fed with the members of all tokens before; it is carried over the windows of a document from its start to its
end. Both softmaxes are trained. Classes come from the counts of all training tokens: a word belongs to the group (say,
language) of training documents in which it is relatively most frequent and, by its count, to a bin of about equal mass;
words seen once share a class with the one unknown type; the end of a text is a class of its own. A class has sixteen
members: four bins of its counts, each dealt by four hashes of the words. A frequent word is a member of its own or nearly so; a rare
one has its share of the member's counts as P(token | member). So the model is a distribution over the known words, one
unknown type and the end, as the add-one unigram base is.

Order of work, all on tables in the shared folder:
1. Chunks: texts as numbers of the chunk's distinct words, with 64-bit hashes of these and their training counts.
2. Counts meet by range of hash, packed; each chunk gets back the counts and groups of its own words only. What meets
   grows with the distinct words of the chunks, not with tokens; a word in a third of all documents is one entry per chunk.
3. Chunks become sequences of members and sums per document.
4. Training by truncated backpropagation, in segments and windows, in rounds. In a round each task goes on from the shared
   parameters over its part of the chunks' training documents, chunk after chunk; then the models are averaged by tokens in two
   levels and shared again. Rounds are as many as the doublings of the number of chunks, and each document is trained on in
   one of them: more data trains longer, at a cost that grows with the data. Scoring runs over whole documents.

Null or empty text: the end token alone. A very long text is scored window by window; its chunk holds it whole. Repeated rows: each counts, each is
scored. Null keys: hashed as empty text, that is training documents. No training document: N = 0; every token is unknown.
Null or rare groups share one group. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored


@dataclass(frozen=True)
class GruParams:
    hidden: int = 16
    bins: int = 5
    groups: int = 8
    window: int = 32
    segment: int = 512
    batch: int = 768
    rate: float = 0.02
    seed: int = 7
    chunk_bytes: int = 12 << 20
    range_words: int = 1_000_000


#: Members of a class: bins of counts by hashes.
FINE, HASHES = 4, 4
MEMBERS = FINE * HASHES
#: What stands for a null key.
NO_KEY = -(1 << 63)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_KEY else str(doc_id).encode()) % 7 == 2


def hash_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(HASHES - 1)).astype(np.int64)


# ---- 1: chunks


class _Numbers(dict):
    def __missing__(self, w):
        v = self[w] = len(self)
        return v


def chunks(docs: DataFrame, group: str | None, values: list[str], chunk_bytes: int) -> DataFrame:
    """chunk long, doc_ids, sizes, places, hashes, counts binary. counts: for each word, by group, of training tokens."""
    at = {v: i for i, v in enumerate(values)}
    many = len(values) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, serial = TaskContext.get().partitionId() << 24, 0
        words, keys, groups, spans, size = _Numbers(), [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal words, keys, groups, spans, size, serial
            sizes = np.array([len(s) for s in spans], np.int32)
            flat = np.concatenate(spans).astype(np.int64) if spans else np.zeros(0, np.int64)
            n = len(words)
            train = np.array([not held_out(k) for k in keys])
            who = np.repeat(np.where(train, np.array(groups), -1), sizes)
            counts = np.bincount(flat[who >= 0] * many + who[who >= 0], minlength=n * many).astype("<u4")
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
            row = [base + serial, *(x.tobytes() for x in (np.array(keys, "<i8"), sizes.astype("<i4"), flat.astype("<i4"), hashes.astype("<u8"), counts))]
            serial += 1
            words, keys, groups, spans, size = _Numbers(), [], [], [], 0
            return pa.record_batch([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["chunk", "doc_ids", "sizes", "places", "hashes", "counts"])

        for b in slices(batches, 1024):
            for k, text, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode().lower().split()
                spans.append(np.fromiter(map(words.__getitem__, raw), np.int32, len(raw)))
                keys.append(k)
                groups.append(at.get(g, many - 1))
                size += len(text)
                if size >= chunk_bytes:
                    yield close()
        if keys:
            yield close()

    g = docs[group].cast("string") if group else F.lit(None).cast("string")
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_KEY)).alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), g.alias("g"))
    return map_arrow(rows, run, "chunk long, doc_ids binary, sizes binary, places binary, hashes binary, counts binary")


# ---- 2: counts


def bucket(c: np.ndarray) -> np.ndarray:
    """Of counts from 1 on: sixteen steps to each doubling."""
    return np.floor(16 * np.log2(np.maximum(c, 1))).astype(np.int64)


BUCKETS = 16 * 48


def counted(table: DataFrame, many: int, ranges: int, totals: list[float], parts: int) -> DataFrame:
    """chunk long, part int, block binary: counts (4 bytes) and groups (1) of a chunk's words in this range, in the order of
    their hashes. chunk -1: types and mass by group, bucket of the count and hash, and words seen once by hash."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, h, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                h, c = np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4").reshape(-1, many)
                order = np.argsort(h)
                h, c = h[order], c[order]
                part = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(h)]
                rows = [(int(part[a]), chunk, struct.pack("<I", z - a) + h[a:z].tobytes() + c[a:z].tobytes()) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]
                yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["part", "chunk", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = 1 / np.maximum(np.array(totals), 1)

        def done(part: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
            sizes = [struct.unpack_from("<I", x)[0] for _, x in held]
            h = np.concatenate([np.frombuffer(x, "<u8", n, 4) for (_, x), n in zip(held, sizes, strict=True)])
            c = np.concatenate([np.frombuffer(x, "<u4", n * many, 4 + 8 * n).reshape(n, many) for (_, x), n in zip(held, sizes, strict=True)])
            order = np.argsort(h)
            head = np.concatenate([[True], np.diff(h[order]) != 0])
            total = np.add.reduceat(c[order].astype(np.int64), np.flatnonzero(head), axis=0)
            n, g = total.sum(axis=1), (total * share).argmax(axis=1)
            which = np.empty(len(h), np.int64)
            which[order] = np.cumsum(head) - 1
            seen = n > 0
            part_of = hash_of(h[order][head])
            key = (g[seen] * BUCKETS + bucket(n[seen])) * HASHES + part_of[seen]
            size = many * BUCKETS * HASHES
            stats = np.stack([np.bincount(key, minlength=size), np.bincount(key, n[seen], minlength=size).astype(np.int64)])
            stats = np.append(stats.reshape(-1), np.bincount(part_of[n == 1], minlength=HASHES)).astype("<i8")
            at = np.cumsum([0, *sizes])
            out = [(k, part, n[w].astype("<u4").tobytes() + g[w].astype("u1").tobytes()) for (k, _), w in zip(held, (which[a:z] for a, z in zip(at, at[1:], strict=False)), strict=True)]
            out.append((-1, part, stats.tobytes()))
            return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "part", "block"])

        now, held = None, []
        for b in batches:
            for part, chunk, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now and held:
                    yield done(now, held)
                    held = []
                now = part
                held.append((chunk, x))
        if held:
            yield done(now, held)

    dealt = map_arrow(table.select("chunk", "hashes", "counts"), deal, "part int, chunk long, block binary")
    return map_arrow(dealt.repartition(max(1, min(ranges, parts)), "part").sortWithinPartitions("part"), meet, "chunk long, part int, block binary")


@dataclass
class Vocabulary:
    """Member of a word by group, bucket of its count and hash; masses."""

    tokens: int  # N, with the ends
    types: int  # V, with the end
    docs: int
    of: np.ndarray  # group x bucket x hash -> member, that is class * MEMBERS and its place in the class
    mass: np.ndarray  # class x MEMBERS; the last two classes are rare words and the end

    @property
    def classes(self) -> int:
        return len(self.mass)


def vocabulary(stats: np.ndarray, many: int, docs: int, bins: int) -> Vocabulary:
    (types, mass), singles = stats[:-HASHES].reshape(2, many, BUCKETS, HASHES), stats[-HASHES:]
    place, masses = np.zeros((many, BUCKETS), np.int64), []
    for g in range(many):
        m = mass[g].sum(axis=1)
        m[0] = 0  # words seen once
        above = np.cumsum(m[::-1])[::-1] - m
        fine = np.minimum(above * bins * FINE // max(1, m.sum()), bins * FINE - 1)
        used, number = np.unique(fine[m > 0] // FINE, return_inverse=True)
        place[g, m > 0] = (number + len(masses)) * FINE + fine[m > 0] % FINE
        for k in range(len(used)):
            own = np.zeros((FINE, HASHES))
            mine = m > 0
            mine[mine] = number == k
            np.add.at(own, fine[mine] % FINE, mass[g][mine])
            masses.append(own.reshape(-1))
    rare = len(masses)
    place[:, 0] = rare * FINE
    last = np.zeros((2, MEMBERS))
    last[0, :HASHES] = singles
    last[0, 0] += 1  # the unknown type stands among those of the first hash
    last[1, 0] = max(docs, 1)
    of = place[:, :, None] * HASHES + np.arange(HASHES)
    return Vocabulary(int(mass.sum()) + docs, int(types.sum()) + (docs > 0), docs, of, np.array([*masses, *last]))


# ---- 3: classes


def classed(table: DataFrame, replies: DataFrame, v: Vocabulary, ranges: int) -> DataFrame:
    """doc_ids, sizes, members, known, base, within binary: per chunk; a member for each token with the end, sums per document."""
    got = replies.where("chunk >= 0").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "block"))).alias("blocks"))
    rows = table.select("chunk", "doc_ids", "sizes", "places", "hashes").join(got, "chunk", "left")
    rows = rows.select("doc_ids", "sizes", "places", "hashes", F.coalesce(F.transform("blocks", lambda x: x["block"]), F.array().cast("array<binary>")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, end = (v.classes - 2) * MEMBERS, (v.classes - 1) * MEMBERS
        mass = v.mass.reshape(-1)
        bottom = np.log10(v.tokens + v.types + 1)
        for b in batches:
            for i in range(b.num_rows):
                keys, sizes, places, h = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in enumerate(("<i8", "<i4", "<i4", "<u8")))
                blocks = b.column(4)[i].as_py()
                c = np.zeros(len(h), np.int64)
                g = np.zeros(len(h), np.int64)
                order = np.argsort(h)
                c[order] = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4", len(x) // 5) for x in blocks)])
                g[order] = np.concatenate([np.zeros(0, "u1"), *(np.frombuffer(x, "u1", len(x) // 5, len(x) // 5 * 4) for x in blocks)])
                kind = np.where(c > 0, v.of[g, bucket(c), hash_of(h)], rare)
                inside = np.log10(np.maximum(c, 1) / np.maximum(mass[kind], 1))
                stops = np.cumsum(sizes.astype(np.int64))
                add = lambda x: np.add.reduceat(np.append(x, 0), stops - sizes) * (sizes > 0) if len(sizes) else x  # noqa: B023, E731
                base = add(np.log10(c + 1.0)[places]) + np.log10(v.docs + 1.0) - bottom * (sizes + 1.0)
                known = add((c > 0).astype(np.int64)[places]) + (v.docs > 0)
                tokens = np.insert(kind[places], stops, end).astype("<u2")
                out = (keys, sizes + 1, tokens, known.astype("<i8"), base.astype("<f8"), add(inside[places]).astype("<f8"))
                yield pa.record_batch([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in out], names=["doc_ids", "sizes", "members", "known", "base", "within"])

    return map_arrow(rows, run, "doc_ids binary, sizes binary, members binary, known binary, base binary, within binary")


# ---- 4: the network


class Gru:
    """Parameters in one vector: input weights by member (and start), recurrent weights, output weights and bias of classes, and of members."""

    def __init__(self, classes: int, hidden: int, flat: np.ndarray | None = None):
        self.c, self.h = classes, hidden
        self.start_token = classes * MEMBERS
        self.shapes = {"x": (classes * MEMBERS + 1, 3 * hidden), "u": (hidden, 3 * hidden), "w": (hidden, classes), "b": (classes,), "v": (classes, MEMBERS, hidden), "d": (classes, MEMBERS)}
        sizes = [int(np.prod(s)) for s in self.shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else flat.astype(np.float32)
        at = np.cumsum([0, *sizes])
        for (name, shape), a, z in zip(self.shapes.items(), at, at[1:], strict=False):
            setattr(self, name, self.flat[a:z].reshape(shape))

    @classmethod
    def start(cls, mass: np.ndarray, hidden: int, seed: int) -> Gru:
        """mass: classes x MEMBERS, by whose shares the biases start. A member without mass has no probability."""
        net = cls(len(mass), hidden)
        rng = np.random.default_rng(seed)
        # members of a class start near each other, so that rare ones have what their class has learned
        kind = np.repeat(rng.normal(0, 0.3, (len(mass), 3 * hidden)), MEMBERS, axis=0)
        net.x[:-1] = kind + rng.normal(0, 0.1, kind.shape)
        for p, scale in ((net.x[-1], 0.3), (net.u, 0.5 / hidden**0.5), (net.w, 0.1), (net.v, 0.05)):
            p[:] = rng.normal(0, scale, p.shape)
        total = mass.sum(axis=1)
        net.b[:] = np.log(total / total.sum())
        net.d[:] = np.log(np.maximum(mass, 1e-30) / total[:, None])
        return net

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, gates z and r, candidate n, and the recurrent part of the candidate."""
        k = self.h
        gx, gh = self.x[x], h @ self.u
        zr = 1 / (1 + np.exp(-(gx[:, : 2 * k] + gh[:, : 2 * k])))
        z, r, hn = zr[:, :k], zr[:, k:], gh[:, 2 * k :]
        n = np.tanh(gx[:, 2 * k :] + r * hn)
        return n + z * (h - n), z, r, n, hn

    def log_probs(self, h: np.ndarray) -> np.ndarray:
        logits = h @ self.w + self.b
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def inner(self, h: np.ndarray, members: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(class, rows, log P(member | class, state)) for each class that the members are of."""
        kind = members // MEMBERS
        order = np.argsort(kind.astype(np.uint8), kind="stable")
        stop = np.cumsum(np.bincount(kind, minlength=self.c))
        for c in np.flatnonzero(np.diff(stop, prepend=0)).tolist():
            rows = order[stop[c - 1] if c else 0 : stop[c]]
            logits = h[rows] @ self.v[c].T + self.d[c]
            logits -= logits.max(axis=1, keepdims=True)
            yield c, rows, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def log_likelihood(self, h: np.ndarray, members: np.ndarray) -> np.ndarray:
        """log P(member | state) of each row."""
        out = self.log_probs(h)[np.arange(len(members)), members // MEMBERS].astype(np.float64)
        for _, rows, logp in self.inner(h, members):
            out[rows] += logp[np.arange(len(rows)), members[rows] % MEMBERS]
        return out

    def score(self, sequences: list[np.ndarray], window: int = 32) -> np.ndarray:
        """Natural log-likelihood of each whole sequence of members; the state goes on from window to window."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out = np.zeros(len(sequences))
        for a in range(0, len(order), 2048):
            part = order[a : a + 2048]
            n = sizes[part]
            state, last = np.zeros((len(part), self.h), np.float32), np.full(len(part), self.start_token)
            flat = np.concatenate([sequences[i] for i in part]).astype(np.int64) if len(part) else np.zeros(0, np.int64)
            base = np.cumsum(n) - n
            for t in range(0, int(n.max(initial=0)), window):
                live = int(np.searchsorted(-n, -t, side="left"))
                state, last = state[:live], last[:live]
                states, targets, owners = [], [], []
                for k in range(t, min(t + window, int(n[0]))):
                    m = int(np.searchsorted(-n, -k, side="left"))
                    new, *_ = self.step(last[:m], state[:m])
                    state = np.concatenate([new, state[m:]]) if m < len(state) else new
                    y = flat[base[:m] + k]
                    last = np.concatenate([y, last[m:]]) if m < len(last) else y
                    states.append(new)
                    targets.append(y)
                    owners.append(m)
                got = self.log_likelihood(np.concatenate(states), np.concatenate(targets))
                at = np.cumsum([0, *owners])
                for s, z, m in zip(at, at[1:], owners, strict=False):
                    out[part[:m]] += got[s:z]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the mean loss over one window: x, y are steps x streams (y: -1 is no target). Also the last state and the summed loss."""
        steps, streams = x.shape
        k = self.h
        kept = [h]
        gates = []
        for t in range(steps):
            h, *g = self.step(x[t], h)
            kept.append(h)
            gates.append(g)
        hs = np.stack(kept)
        flat, target = hs[1:].reshape(-1, k), y.reshape(-1)
        ok = np.flatnonzero(target >= 0)
        out, member = flat[ok], target[ok]
        kind, share = member // MEMBERS, np.float32(1 / max(1, len(ok)))
        logp = self.log_probs(out)
        every = np.arange(len(ok))
        loss = -float(logp[every, kind].sum())
        d = np.exp(logp)
        d[every, kind] -= 1
        d *= share
        grad = Gru(self.c, k)
        grad.w[:] = out.T @ d
        grad.b[:] = d.sum(axis=0)
        back = d @ self.w.T
        for c, rows, logq in self.inner(out, member):
            at, one = np.arange(len(rows)), member[rows] % MEMBERS
            loss -= float(logq[at, one].sum())
            e = np.exp(logq)
            e[at, one] -= 1
            e *= share
            grad.v[c] = e.T @ out[rows]
            grad.d[c] = e.sum(axis=0)
            back[rows] += e @ self.v[c]
        dh_out = np.zeros((len(flat), k), np.float32)
        dh_out[ok] = back
        dh_out = dh_out.reshape(steps, streams, k)
        dx, du = np.empty((steps, streams, 3 * k), np.float32), np.empty((steps, streams, 3 * k), np.float32)
        after = np.zeros((streams, k), np.float32)
        ut = np.ascontiguousarray(self.u.T)
        for t in range(steps - 1, -1, -1):
            z, r, n, hn = gates[t]
            dh = dh_out[t] + after
            dn = dh * (1 - z) * (1 - n * n)
            dx[t, :, :k] = dh * (hs[t] - n) * z * (1 - z)
            dx[t, :, k : 2 * k] = dn * hn * r * (1 - r)
            dx[t, :, 2 * k :] = dn
            du[t] = dx[t]
            du[t, :, 2 * k :] *= r
            after = dh * z + du[t] @ ut
        grad.u[:] = hs[:-1].reshape(-1, k).T @ du.reshape(-1, 3 * k)
        seen = x.reshape(-1)
        order = np.argsort(seen.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(seen[order]) != 0]))
        grad.x[seen[order][heads]] = np.add.reduceat(dx.reshape(-1, 3 * k)[order], heads, axis=0)
        return grad.flat, hs[-1], loss

    def train(self, sequences: list[np.ndarray], p: GruParams, speed: float = 1.0) -> int:
        """One pass of Adam over all sequences, at `speed` of the learning rate; the number of their tokens."""
        pieces = []
        for s in sequences:
            whole = np.concatenate([[self.start_token], s]).astype(np.int64)
            pieces += [whole[a : a + p.segment + 1] for a in range(0, len(whole) - 1, p.segment)]
        rng = np.random.default_rng(p.seed)
        by_size = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        groups = [by_size[a : a + p.batch] for a in range(0, len(by_size), p.batch)]
        m, v, turn = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        total = sum(-(-(max(len(pieces[i]) for i in g) - 1) // p.window) for g in groups)
        for gi in rng.permutation(len(groups)):
            group = sorted(groups[gi], key=lambda i: -len(pieces[i]))
            n = np.array([len(pieces[i]) - 1 for i in group])
            grid = np.full((n[0] + 1, len(group)), -1, np.int64)
            for j, i in enumerate(group):
                grid[: n[j] + 1, j] = pieces[i]
            h = np.zeros((len(group), self.h), np.float32)
            for t in range(0, int(n[0]), p.window):
                live = int(np.searchsorted(-n, -t, side="left"))
                stop = min(t + p.window, int(n[0]))
                x = grid[t:stop, :live]
                grad, h, _ = self.gradient(np.where(x < 0, self.start_token, x), grid[t + 1 : stop + 1, :live], h[:live])
                size = float(np.sqrt((grad * grad).sum()))
                if size > 1:
                    grad *= 1 / size
                turn += 1
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                rate = p.rate * speed * min(1, turn / 10) * max(0.05, 1 - turn / (total + 1))
                self.flat -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        return sum(len(s) for s in sequences)


def _sequences(doc_ids: bytes, sizes: bytes, members: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, n, flat = np.frombuffer(doc_ids, "<i8"), np.frombuffer(sizes, "<i4"), np.frombuffer(members, "<u2")
    return keys, n, np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def trained(table: DataFrame, v: Vocabulary, p: GruParams, chunks: int) -> np.ndarray:
    """The parameters after all rounds; what reaches the driver is one model for each of at most 16 tasks a round."""
    first = Gru.start(v.mass, p.hidden, p.seed).flat
    rounds = max(1, chunks.bit_length())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(first)), 0.0
        for b in batches:
            for x, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, weight = total + np.frombuffer(x), weight + w
        if weight:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary()), pa.array([weight])], names=["total", "weight"])

    shared = first
    for turn in range(rounds):
        before = shared

        def run(batches: Iterator[pa.RecordBatch], before: np.ndarray = before, turn: int = turn) -> Iterator[pa.RecordBatch]:
            net, weight = Gru(v.classes, p.hidden, before.copy()), 0.0
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    keys, _, seqs = _sequences(*row)
                    mine = [s for i, (k, s) in enumerate(zip(keys.tolist(), seqs, strict=True)) if i % rounds == turn and not held_out(k)]
                    if mine:
                        weight += net.train(mine, p, 1 / (1 + turn))
            if weight:
                yield pa.record_batch([pa.array([(weight * net.flat.astype(np.float64)).tobytes()], pa.binary()), pa.array([weight])], names=["total", "weight"])

        models = map_arrow(table.select("doc_ids", "sizes", "members"), run, "total binary, weight double")
        rows = map_arrow(models.repartition(16), add, "total binary, weight double").collect()
        weight = sum(r["weight"] for r in rows)
        if weight:
            shared = (sum(np.frombuffer(r["total"]) for r in rows) / weight).astype(np.float32)
    return shared


def document_scores(docs: DataFrame, group: str | None = "lang", params: GruParams = GruParams()) -> DataFrame:
    """doc_id long, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double."""
    spark, p = docs.sparkSession, params
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = [r["g"] for r in docs.groupBy(docs[group].cast("string").alias("g")).count().orderBy(F.desc("count"), "g").limit(p.groups).collect() if r["g"] is not None] if group else []
    many = len(values) + 1
    table = stored(chunks(docs, group, values, p.chunk_bytes), "chunks")

    # totals: one small row per chunk
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = np.frombuffer(counts, "<u4").reshape(-1, many)
                yield pa.record_batch([pa.array([c.sum(axis=0).tolist()], pa.list_(pa.int64())), pa.array([len(c)]), pa.array([sum(not held_out(k) for k in np.frombuffer(keys, "<i8").tolist())])], names=["tokens", "words", "docs"])

    total = map_arrow(table.select("doc_ids", "counts"), sums, "tokens array<long>, words long, docs long")
    total = total.agg(*(F.sum(F.get("tokens", F.lit(i))).alias(f"g{i}") for i in range(many)), F.sum("words").alias("words"), F.sum("docs").alias("docs")).first()
    totals = [float(total[f"g{i}"] or 0) for i in range(many)]
    ranges = max(1, -(-(total["words"] or 0) // p.range_words))
    replies = stored(counted(table, many, ranges, totals, parts), "word-counts")
    stats = np.zeros(2 * many * BUCKETS * HASHES + HASHES, np.int64)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * many * BUCKETS * HASHES + HASHES, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                out += np.frombuffer(x, "<i8")
        yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["block"])

    for r in map_arrow(replies.where("chunk = -1").select("block").repartition(8), added, "block binary").collect():
        stats += np.frombuffer(r["block"], "<i8")
    v = vocabulary(stats, many, total["docs"] or 0, p.bins)
    sequences = stored(classed(table, replies, v, ranges), "members")
    flat = trained(sequences, v, p, table.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Gru(v.classes, p.hidden, flat)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for b in batches:
            for ids, sizes, members, known, base, within in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, n, seqs = _sequences(ids, sizes, members)
                score = net.score(seqs, p.window) / np.log(10) + np.frombuffer(within, "<f8")
                cols = [pa.array(keys, mask=keys == NO_KEY), pa.array([held_out(k) for k in keys.tolist()]), pa.array(n.astype(np.int64)), pa.array(np.frombuffer(known, "<i8")), pa.array(np.full(len(n), v.tokens, np.int64)), pa.array(np.frombuffer(base, "<f8")), pa.array(score)]
                yield pa.record_batch(cols, names=names)

    return map_arrow(sequences, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
