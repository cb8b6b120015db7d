"""How filters interact: every order of five filters, from one histogram of who fails what.

A document's mask has a bit for each filter that it fails. All that an order of filters does to a document depends on its
mask alone, so each part of the corpus is three rows of 32 counts: all documents, those labelled good, those labelled
toxic. The rows of many parts, stacked, are multiplied by integer matrices of 32 by 600 (120 orders of five steps) that say
whether a mask is kept after a step, removed at it, redundant there (failing, but removed before) or failing there alone.

Order of work:
1. One pass over the texts gives part, mask of the filters on single texts, and a digest (SHA-256) of the text.
2. Equal rows are counted first. The smallest key of each digest passes the filter on copies; it is joined back on digest and
   key, so that a group of copies of any size is spread by its keys.
3. Counts by key, part and mask (at most 32 for a key and part) meet the labels; counts by part and mask are what is left, 32
   rows a part, and are multiplied part by part in tasks.

Null text: empty. Null part: the empty string. A null key is no smaller than any and has no label, so it fails the filter on
copies never. Repeated rows count each; those of the smallest key with the same text all pass. A key with several label rows has quality or toxic
1 if any row says so. A very long text is split into words within its row, in memory of some ten times its bytes. No documents:
no row. Other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored

FILTERS = "ABCDE"
#: Step by step, as letters.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_LETTERS = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: Bytes that begin no code point.
_INSIDE = bytes(range(0x80, 0xC0))


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: under 100 words; under 80 % distinct words; over 10 % capitals; a mark."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INSIDE))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * points) << 2 | (len(text.translate(None, _MARKS)) < len(text)) << 3


def incidence() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kept, removed, redundant, unique: 32 by 600, of 0 and 1."""
    bits = np.arange(32)[:, None] >> np.arange(5) & 1
    fails = bits[:, _LETTERS]
    before = np.cumsum(fails, axis=2) - fails > 0
    fails = fails > 0
    alone = (bits.sum(axis=1) == 1)[:, None, None]
    return tuple(m.reshape(32, -1).astype(np.int64) for m in (~fails & ~before, fails & ~before, fails & before, fails & alone))


def multiplied(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Of part x (all, good, toxic) x 32 counts, each result as part x 600."""
    kept, removed, redundant, unique = incidence()
    flat = rows.reshape(-1, 32)
    gone = (flat @ removed).reshape(len(rows), 3, -1)
    all_ = rows[:, 0]
    letter = _LETTERS.reshape(-1)
    # removed by a filter, over all orders and steps: the sum over the columns of its letter
    same = (letter[:, None] == np.arange(len(FILTERS))).astype(np.int64)
    return {
        "kept": all_ @ kept, "removed": gone[:, 0], "redundant": all_ @ redundant, "unique_fails": all_ @ unique,
        "good_lost": gone[:, 1], "toxic_lost": gone[:, 2], "shapley": (gone[:, 0] @ same)[:, letter],
    }


def text_facts(docs: DataFrame, part: str) -> DataFrame:
    """doc_id long, part string, mask int (of single texts), digest binary."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(text_mask, texts), pa.int32()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return map_arrow(rows, run, "doc_id long, part string, mask int, digest binary")


def histograms(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part string, mask int (of all five filters), n long, good long, toxic long: one row for each part and mask that occur."""
    facts = stored(text_facts(docs, part), "filter-facts")
    rows = facts.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(copies, 16).otherwise(0))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    flag = lambda c: F.max(F.coalesce((labels[c] == 1).cast("long"), F.lit(0)))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    told = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), told("good"), told("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    counts = histograms(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, steps = np.repeat(ORDERS, 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
        for b in slices(batches, 64):
            rows = np.zeros((b.num_rows, 3, 32), np.int64)
            for row, some in zip(rows, b.column(1).to_pylist(), strict=True):
                for x in some:
                    row[:, x["mask"]] = x["n"], x["good"], x["toxic"]
            found = multiplied(rows)
            yield pa.record_batch([pa.array(np.repeat(np.array(b.column(0).to_pylist(), object), 600), pa.string()), pa.array(np.tile(orders, b.num_rows)), pa.array(np.tile(steps, b.num_rows)), *(pa.array(found[c].reshape(-1)) for c in names)], names=["part", "filter_order", "step", *names])

    return map_arrow(counts, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in names))


#: The same in SQL, order by order and document by document.
ORACLE_SQL = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first from t),
f as (select doc_id, part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > first, false) as e from w),
l as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
x as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
  case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end || case when d then 'D' else '' end || case when e then 'E' else '' end as fails
  from f left join l using (doc_id)),
h as (select part, fails, good, toxic, count(*) as n from x group by all),
s as (select unnest(['A', 'B', 'C', 'D', 'E']) as s),
o as (select p.s || q.s || r.s || u.s || v.s as filter_order from s p, s q, s r, s u, s v where len(list_distinct([p.s, q.s, r.s, u.s, v.s])) = 5),
k as (select filter_order, cast(step as integer) as step, substr(filter_order, step, 1) as letter, left(filter_order, step - 1) as earlier from o, range(1, 6) g(step)),
y as (select part, filter_order, step, letter, n, good, toxic, contains(fails, letter) as failing, fails = letter as alone,
  len(regexp_replace(fails, '[' || earlier || '_]', '', 'g')) < len(fails) as gone from h, k),
z as (select part, filter_order, step, letter, cast(coalesce(sum(n) filter (where not failing and not gone), 0) as bigint) as kept,
  cast(coalesce(sum(n) filter (where failing and not gone), 0) as bigint) as removed, cast(coalesce(sum(n) filter (where failing and gone), 0) as bigint) as redundant,
  cast(coalesce(sum(n) filter (where alone), 0) as bigint) as unique_fails, cast(coalesce(sum(n) filter (where failing and not gone and good), 0) as bigint) as good_lost,
  cast(coalesce(sum(n) filter (where failing and not gone and toxic), 0) as bigint) as toxic_lost from y group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, letter) as bigint) as shapley from z"""
