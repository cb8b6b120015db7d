"""BPE with word ends by speculation: propose by greedy longest match, verify all adjacent pairs, merge exactly where that fails.

A sequence of tokens is what ranked merging gives for a word if each token is what merging gives for its own symbols and no
merge across the border of two neighbours comes before those that build them. The second condition concerns two tokens at
a time, so it is tested for all pairs of all new words at once: the later merge of the pair's two sides is undone step by step,
and at each step the two symbols at the border must not be a merge that would have come earlier.

1. Text is cut at ASCII white space, over which neither the normalizer composes nor the pattern matches. Each distinct unit
   is normalized and cut into words once for many texts, by the library's own normalizer and pre-tokenizer.
2. Each new word is proposed as its longest tokens from the left (an automaton's leftmost longest matches); words with a pair
   that fails are merged exactly, lowest rank and place first: a matrix of words takes one merge a row and round, and a word too
   long for a row goes through a heap of (rank, place). Tokens that merging doesn't yield from their own symbols are never proposed.
3. Ids are put together, digested, and decoded from the ids alone: without a decoder, the library joins token strings by a space.

No shuffle: every row depends on itself. The units that a worker keeps are bounded by bytes; those that come again outlive the others.
The string of an added token (as <|endoftext|>) in a text becomes that token's id, as the library has it.

Null or empty text, or white space alone: no id, digests of nothing. A very long text or word is encoded whole, in time of its
size times its logarithm and memory of some fifteen times its bytes within one task. Repeated rows: one result each; null keys
stay null. Empty table: no row. Other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, slices, texts_of

NEVER = 1 << 40
#: Stands for a word's end in the automaton; words are shown as bytes, which have no such character.
END = "\n"
#: Words of fewer than 2 ** WIDEST symbols are merged as rows of a matrix, others one by one with a heap, by the same ranks and places.
WIDEST = 6
#: Fixed value: the pattern of words in the vocabulary's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space that str.split() knows besides U+0020 and U+0009 to U+000D.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = re.compile("[\x20\x09-\x0d]+")


#: Latin letters, which the normalizer only lowers, and what ASCII punctuation but an apostrophe follows: one word or two.
_PLAIN = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\\[-`{-~]*)")


class Merges:
    """Ranked merges of a vocabulary, forwards as a lookup and backwards as each token's last merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.size = max(vocab.values()) + 1
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(merges)))}
        # the id `size` fills rows and is in no pair
        keys = np.array([a * (self.size + 1) + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.key_made = keys[order], *np.array([*self.rank.values()], np.int64).reshape(-1, 2)[order].T
        # each token's last merge: -1 for single symbols
        self.made = np.full(self.size, -1, np.int64)
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        steady = set()
        for token, t in sorted(vocab.items(), key=lambda x: len(x[0])):
            parts = self.symbols(token)
            if parts is None:
                continue
            ids, last = self.merged(parts)
            if ids != [t]:
                continue
            if last is not None:
                r, a, b = last
                if a not in steady or b not in steady or r <= max(self.made[a], self.made[b]):
                    continue
                self.made[t], self.left[t], self.right[t] = r, a, b
            steady.add(t)
        inner = {s: t for s, t in vocab.items() if t in steady and not s.endswith(suffix)}
        self.inner = inner
        self.final = {s[: -len(suffix)]: t for s, t in vocab.items() if t in steady and s.endswith(suffix)}
        self.longest, self.length = ahocorasick.Automaton(), {t: len(s) for s, t in inner.items()}
        for s, t in inner.items():
            self.longest.add_word(s, (t, len(s)))
        for s, t in self.final.items():
            self.longest.add_word(s + END, (t, len(s) + 1))
        self.longest.make_automaton()

    def symbols(self, token: str) -> list[int] | None:
        """Of a token's string; None where a symbol is no token."""
        body, end = (token[: -len(self.suffix)], self.suffix) if token.endswith(self.suffix) else (token, "")
        ids = [self.vocab.get(c) for c in body[:-1]] + [self.vocab.get(body[-1:] + end)]
        return None if None in ids else ids

    def merged(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Exact merging by (rank, place), and the last merge: its rank and two sides.

        Entries of the heap are rank * n + place; one is stale when the place's own rank is another by now."""
        n, ids, last, rank = len(ids), list(ids), None, self.rank
        now = [m[0] if (m := rank.get(p)) else -1 for p in pairwise(ids)]
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now.append(-1)
        while heap:
            r, i = divmod(heappop(heap), n)
            if now[i] != r:
                continue
            j = after[i]
            a, b = ids[i], ids[j]
            last = (r, a, b)
            ids[i] = made = rank[a, b][1]
            ids[j] = now[j] = now[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := rank.get((made, ids[k])):
                    now[i] = m[0]
                    heappush(heap, m[0] * n + i)
            if (h := before[i]) >= 0:
                if m := rank.get((ids[h], made)):
                    now[h] = m[0]
                    heappush(heap, m[0] * n + h)
                else:
                    now[h] = -1
        return [x for x in ids if x >= 0], last

    def merged_rows(self, ids: np.ndarray) -> np.ndarray:
        """As merged, for a row each: in every round each row merges its leftmost pair of lowest rank. Rows end with `size`."""
        out, live, places = ids.copy(), np.arange(len(ids)), np.arange(ids.shape[1])
        rank, _ = self.pairs(ids[:, :-1], ids[:, 1:])
        rank = np.column_stack([rank, np.full(len(ids), NEVER)])
        while len(live):
            rows, at = np.arange(len(live)), rank.argmin(axis=1)
            some = rank[rows, at] < NEVER
            out[live[~some]] = ids[~some]
            live, ids, rank, at, rows = live[some], ids[some], rank[some], at[some], rows[: int(some.sum())]
            ids[rows, at] = self.pairs(ids[rows, at], ids[rows, at + 1])[1]
            # what follows moves up by one place
            moved = places + (places > at[:, None])
            moved[:, -1] = places[-1]
            ids, rank = np.take_along_axis(ids, moved, 1), np.take_along_axis(rank, moved, 1)
            ids[:, -1] = self.size
            rank[rows, at] = self.pairs(ids[rows, at], ids[rows, np.minimum(at + 1, places[-1])])[0]
            left = rows[at > 0]
            rank[left, at[left] - 1] = self.pairs(ids[left, at[left] - 1], ids[left, at[left]])[0]
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NEVER if it is no merge) and what it makes."""
        if not len(self.keys):
            return np.full(a.shape, NEVER), np.zeros(a.shape, np.int64)
        want = a * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.key_ranks[at], NEVER), self.key_made[at]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of a and b together leaves both as they are, for steady tokens."""
        ok = np.ones(len(a), bool)
        live, x, y, limit = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER)
        while len(live):
            crossed = self.pairs(x, y)[0] < limit
            ok[live[crossed]] = False
            rx, ry = self.made[x], self.made[y]
            # of two merges of one rank the left one comes first, so the right one is undone first, and a merge across the border comes before it
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            keep = ~crossed & (undo_x | (ry >= 0))
            live, x, y, limit = live[keep], x[keep], y[keep], limit[keep]
        return ok

    def proposed(self, word: str) -> list[int] | None:
        """Longest tokens from the left, the last with the word's end; None where none fits."""
        out, size = [], 0
        for end, (t, n) in self.longest.iter_long(word + END):
            size += n
            if end + 1 != size:
                return None
            out.append(t)
        if size == len(word):  # a token without the end has taken the last symbol: one symbol less of it
            rest = self.length[out.pop()] - 1
            cut, last = word[size - 1 - rest : size - 1], self.final.get(word[-1:])
            if last is None or (rest and cut not in self.inner):
                return None
            out += [self.inner[cut], last] if rest else [last]
        return out if size >= len(word) else None

    def encode(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Ids of each word (none of them empty), and how many words failed the verification."""
        found = [self.proposed(w) for w in words]
        sizes = np.fromiter((len(f) if f else 0 for f in found), np.int64, len(found))
        flat = np.fromiter((t for f in found if f for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        inside = owner[1:] == owner[:-1]
        wrong = {i for i, f in enumerate(found) if f is None}
        wrong.update(owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])].tolist())
        rows: dict[int, list[int]] = {}
        for i in wrong:
            symbols = found[i] = self.symbols(words[i] + self.suffix)
            if symbols is None:
                raise ValueError("a byte without a token")
            rows.setdefault(len(symbols).bit_length(), []).append(i)
        for bits, group in rows.items():
            if bits > WIDEST:
                for i in group:
                    found[i] = self.merged(found[i])[0]
                continue
            ids = np.full((len(group), 1 << bits), self.size, np.int64)
            for row, i in zip(ids, group, strict=True):
                row[: len(found[i])] = found[i]
            ids = self.merged_rows(ids)
            for i, n, row in zip(group, (ids < self.size).sum(axis=1).tolist(), ids.tolist(), strict=True):
                found[i] = row[:n]
        return found, len(wrong)


class WordBpe:
    """Encoder of whole texts; keeps the packed ids of the units it met: two generations of up to `most` bytes each."""

    def __init__(self, path: str, most: int = 64 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        cut = [s for s in steps if s and s["type"] == "Split"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or not model["end_of_word_suffix"] or spec["decoder"] or spec.get("post_processor") or [s["type"] for s in steps if s] != ["Split", "ByteLevel"] or (cut[0]["behavior"], cut[0]["invert"]) != ("Removed", True) or steps[1]["add_prefix_space"] or steps[1]["use_regex"] or any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("a BPE vocabulary is needed whose words are matches of a pattern, shown as bytes, without post-processor and decoder")
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise NotImplementedError("ids are packed as four bytes in the machine's order, which must be little-endian")
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if normal != ["NFC", "Replace", "Lowercase"] or cut[0]["pattern"].get("Regex") != PATTERN:
            raise ValueError("plain words are cut here as NFC, lower case and the pattern of this module have it")
        self.library = Tokenizer.from_file(path)
        # a byte is shown as itself where that is a printable character, or as the next free one from U+0100 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {x: x for x in visible} | {x: 256 + i for i, x in enumerate(sorted(set(range(256)) - set(visible)))}
        self.merges = Merges(model["vocab"], [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], model["end_of_word_suffix"])
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {t: s for s, t in [*model["vocab"].items(), *self.added.items()]}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.most, self.size, self.failed = most, 0, 0
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, unit: str) -> list[str | int]:
        """A unit's words, shown as bytes, and ids of added tokens."""
        if (m := _PLAIN.fullmatch(unit)) and not any(x in unit for x in self.added):
            letters, marks = m[1].lower(), m[2]
            letters = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.shown)
            return [letters, marks] if marks else [letters]
        out: list[str | int] = []
        for part in self.find_added.split(unit) if self.find_added else [unit]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part) if self.library.normalizer else part))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text, four bytes each, little-endian."""
        if self.size > self.most:
            self.older, self.units, self.size = self.units, {}, 0
        cut = [_SPACE.split(t) if _OTHER_SPACE.search(t) else t.split() for t in texts]
        fresh = {}
        for u in set().union(*cut).difference(self.units):
            if (ids := self.older.get(u)) is None:
                fresh[u] = self.words(u)
            else:
                self.keep(u, ids)
        distinct = list({w for ws in fresh.values() for w in ws if isinstance(w, str)})
        found, failed = self.merges.encode(distinct)
        self.failed += failed
        known = {w: array("I", f).tobytes() for w, f in zip(distinct, found, strict=True)}
        for u, ws in fresh.items():
            self.keep(u, b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in ws]))
        return [b"".join(map(self.units.__getitem__, c)) for c in cut]

    def keep(self, unit: str, ids: bytes) -> None:
        self.units[unit] = ids
        self.size += len(unit) + len(ids) + 200

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_known: dict[str, WordBpe] = {}


def encoder(path: str) -> WordBpe:
    if path not in _known:
        _known[path] = WordBpe(path)
    return _known[path]


def encode_digest(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string; with_ids: ids binary (4 bytes each, little-endian)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            ids = enc.encode(b.column(1).to_pylist())
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])]
            yield pa.record_batch([*columns, *[pa.array(ids, pa.binary())] * with_ids], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return map_arrow(texts_of(docs), run, schema)
