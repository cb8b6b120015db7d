"""What several operators share: scratch tables, shipping of this package, tokenization by distinct words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch, ship

#: White space between words, as every contract here has it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else Path(uri).as_uri())


def put_file(uri: str, blocks: Iterable[bytes]) -> int:
    """Write a file under a temporary name, then rename it, so that a killed task leaves no torn file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(temp, compression=None) as out:
        for b in blocks:
            out.write(b)
            size += len(b)
    fs.move(temp, path)
    return size


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow; at a task's end the worker gives its free memory back, since idle workers live on beside later tasks."""
    spark = df.sparkSession
    ship(spark)
    # whole texts: a batch of Spark's default size would hold tens of megabytes on either side
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, 2001):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


#: Called at the end of each task, to drop what a module has kept.
at_task_end: list[Callable[[], None]] = []


def release() -> None:
    for f in at_task_end:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, under fixed names; a null text is empty."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word of Latin letters, and what ASCII punctuation follows: two matches of the byte-level pattern, or one.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")


class _Words(dict):
    """Packed ids of each distinct word, found when first asked for; KeyError for one with white space at its ends.

    Two generations: when `turn` is called, the words asked for since the last call stay at hand and older ones go."""

    def __init__(self, enc: WordEncoder, lead: str):
        self.enc, self.lead, self.shown, self.old = enc, lead, enc.visible(lead), {}

    def __missing__(self, w: str) -> bytes:
        ids = self.old.get(w)
        if ids is None:
            ids = self.made(w)
        self[w] = ids
        return ids

    def made(self, w: str) -> bytes:
        enc = self.enc
        if w.isascii() and w.isalpha():  # one match of the pattern, whose bytes are shown as themselves
            return array(enc.code, [x.id for x in enc.tokenize(self.shown + w)]).tobytes()
        if m := _PLAIN.fullmatch(w):
            if m.end(1) == len(w):
                return enc.piece(self.shown + enc.visible(w))
            tail = enc.tails.get(m[2])
            if tail is None:
                tail = enc.tails[m[2]] = enc.piece(m[2])
            return self[m[1]] + tail
        if not w or w[0].isspace() or w[-1].isspace():
            raise KeyError(w)
        return enc.whole(self.lead + w)

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()

    def trim(self, most: int) -> None:
        """Keep the words first asked for of this generation, among which are the frequent ones."""
        self.old = {}
        kept = list(islice(self.items(), most))
        if len(kept) < len(self):
            self.clear()
            self.update(kept)


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    A byte-level pre-tokenizer always cuts before a single space that stands between two other characters that are
    no white space, and around a single line feed likewise. So a text is the concatenation of its words' ids. Plain
    words go to the library's BPE model straight away. A text with any other white space pattern is encoded whole, and so
    is one that holds the string of an added token (as <|endoftext|>), which the library turns into that token's id. The
    words that are kept are bounded by `most`, and between tasks by `idle`; words that come again outlive those that don't."""

    def __init__(self, path: str, most: int = 600_000, idle: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tk = Tokenizer.from_file(path)
        if not isinstance(self.tk.pre_tokenizer, pre_tokenizers.ByteLevel) or self.tk.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.tokenize = self.tk.model.tokenize
        self.code = "H" if self.tk.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code).newbyteorder("<")
        self.added = [x.content for x in self.tk.get_added_tokens_decoder().values()]
        # the pre-tokenizer shows each byte as a printable character: itself, or the next free one from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        self.shown = {**{x: x for x in shown}, **{x: 256 + i for i, x in enumerate(hidden)}}
        self.most, self.idle = most, idle
        self.spaced, self.first, self.tails = _Words(self, " "), _Words(self, ""), {}
        self.newline = self.whole("\n")

    def visible(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.shown)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tk.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, shown: str) -> bytes:
        """Of one match of the pre-tokenizer's pattern, as the pre-tokenizer shows it."""
        return array(self.code, [x.id for x in self.tokenize(shown)]).tobytes()

    def trim(self) -> None:
        self.spaced.trim(self.idle)
        self.first.trim(self.idle // 4)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, self.dtype) of each text."""
        for words in (self.spaced, self.first):
            if len(words) > self.most // 2:
                words.turn()
        if len(self.tails) > self.most // 8:
            self.tails.clear()
        out = []
        spaced, first = self.spaced.__getitem__, self.first.__getitem__
        for t in texts:
            if any(x in t for x in self.added):
                out.append(self.whole(t))
                continue
            try:
                parts: list[bytes] = []
                for line in t.split("\n"):
                    if parts:
                        parts.append(self.newline)
                    ws = line.split(" ")
                    parts.append(first(ws[0]))
                    if len(ws) > 1:
                        del ws[0]
                        parts.extend(map(spaced, ws))
                out.append(b"".join(parts))
            except KeyError:  # white space that isn't single
                out.append(self.whole(t))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and vocabulary, so that later tasks know the frequent words of earlier ones."""
    if path not in _encoders:
        if sys.byteorder != "little":
            raise NotImplementedError("ids are packed in the machine's order, which must be little-endian")
        _encoders[path] = WordEncoder(path)
        at_task_end.append(_encoders[path].trim)
    return _encoders[path]
