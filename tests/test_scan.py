"""The scan over blocks of lines against windows over whole texts, with cuts anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from releaselode.operators import notes as N
from releaselode.operators import scan as S

import one_window as one

LINES = [
    "", "", "  ", "=====", "-----", "~~~~", "# Title", "## 1.2.0", "## 2.0 (2024)", "1.3.1 (x)", "2.0.0", "**Fixes**", "Bug Fixes", "Features", "features",
    "- Fixed a crash in the reader", "  on a second line of it", "* Added support for files", "1. First point is made", "was removed in this release", "Plain words that go on", "now deprecated and changed", "Thanks to @dev", "ok", "(gh-12)",
]


def drawn(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        some = rng.sample(LINES, rng.randint(1, 6)) if rng.random() < 0.6 else LINES
        texts.append([rng.choice(some) for _ in range(rng.randint(0, 24))])
    # runs of candidates over many blocks, of both parities, and texts that begin or end with them
    for n in range(1, 9):
        texts += [["1.0"] + ["====="] * n, ["====="] * n + ["x y z words"], ["words here"] + ["-----"] * n + ["more words here", "-----"]]
    return texts


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i if i else None, "a" if i % 2 else None, p, x) for i, t in enumerate(drawn(11)) for p, x in enumerate(t)]
    return spark.createDataFrame(rows, "k int, l string, pos int, line string").cache()


def rows(df, *columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


KEY = ["k", "l"]
PARTS = {"heading_lines": ["pos", "line", "heading"], "version_sections": ["section", "pos", "heading", "body"], "paragraphs": ["para", "section", "block", "is_change", "lines"], "entries": ["ord", "section", "entry"]}


@pytest.fixture(scope="module")
def whole(lines):
    """What windows over whole texts give."""
    return {name: rows(getattr(one, name)(lines, KEY), *KEY, *columns) for name, columns in PARTS.items()}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_any_cut_gives_the_same(lines, whole, size):
    for name, columns in PARTS.items():
        assert rows(getattr(N, name)(lines, KEY, size), *KEY, *columns) == whole[name], name


def test_places_may_have_gaps(lines, whole):
    apart = lines.withColumn("pos", F.col("pos") * 7 + F.col("pos") % 3)
    assert rows(N.entries(apart, KEY, 10), *KEY, *PARTS["entries"]) == whole["entries"]
    assert rows(N.version_sections(apart, KEY, 4), *KEY, "section", "heading", "body") == rows(one.version_sections(lines, KEY), *KEY, "section", "heading", "body")


def test_empty_table(lines):
    none = lines.where("false")
    assert N.entries(none, KEY).count() == N.version_sections(none, KEY).count() == 0


def test_one_text_is_spread_over_tasks(spark):
    """A text of 200,000 lines: no task of the scan sees more than its share of blocks."""
    long = spark.range(200_000).select(F.lit("x").alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("## 1."), F.col("id"))).otherwise(F.concat(F.lit("- Fixed point "), F.col("id"))).alias("line"))
    dealt = S.dealt(long, ["k"], "pos", 1000).repartition(16, S.TEXT, S.PART).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 60_000
    cut = N.version_sections(long, ["k"], 1000)
    assert cut.count() == 4000
    assert cut.agg(F.sum(F.size(F.split("body", "\n")))).first()[0] == 196_000
    assert N.entries(long, ["k"], 1000).agg(F.max("ord"), F.count("*"), F.countDistinct("ord")).first() == (196_000, 196_000, 196_000)
