"""The note cache as state: what was put, asked and forgotten, over batches, a restart and late rows, against the table's answer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from releaselode.operators import sources
from releaselode.streaming import cache as C
from releaselode.streaming import notes as stream

AT = dt.datetime(2024, 1, 1)
HOUR, DAY = dt.timedelta(hours=1), dt.timedelta(days=1)


@pytest.fixture
def store(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", C.STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def put(package, at, prio, notes):
    return ("pypi", package, "1", at, None, prio, notes is not None, notes)


def ask(package, at, number):
    return ("pypi", package, "1", at, number, None, None, None)


class Stream:
    def __init__(self, spark, path, late="1 hour"):
        self.spark, self.path, self.late = spark, path, late

    def batch(self, rows):
        """Land rows and run a query of the same checkpoint until they are done: every batch is a restart."""
        self.spark.createDataFrame(rows, C.EVENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        df = C.cached(self.spark.readStream.schema(C.EVENTS).parquet(f"{self.path}/in"), self.late)
        q = df.writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    def answers(self):
        rows = self.spark.read.parquet(f"{self.path}/out").collect()
        assert len({r.ask for r in rows if r.ask is not None}) == sum(r.ask is not None for r in rows)
        return {r.ask: (r.state, r.notes) for r in rows if r.ask is not None}, sorted((r.package, r.at, r.notes) for r in rows if r.state == "expired")


def table(spark, rows):
    return {r.ask: (r.state, r.notes) for r in sources.cache_lookups(spark.createDataFrame(rows, C.EVENTS), C.KEY).collect()}


def test_put_ask_and_forget(store, tmp_path):
    s = Stream(store, str(tmp_path))
    one = [put("p", AT, 2, "posted"), put("q", AT, 4, None), ask("p", AT, 1), ask("q", AT + HOUR, 2), ask("r", AT, 3), put("p", AT + HOUR, 1, "curated"), ask("p", AT + 2 * HOUR, 4)]
    two = [ask("q", AT + DAY, 5), ask("q", AT + DAY + dt.timedelta(seconds=1), 6), put("p", AT + DAY, 1, None), ask("p", AT + DAY, 7)]
    # the entry of priority 1 found nothing and lasts a day; then that of priority 2 until its own time is over
    three = [ask("p", AT + 3 * DAY, 8), ask("p", AT + 4 * DAY, 13), ask("p", AT + 30 * DAY, 9), ask("p", AT + 30 * DAY + dt.timedelta(seconds=1), 10), put("p", AT + 40 * DAY, 3, "later")]
    for rows in (one, two, three):
        s.batch(rows)
    # later than the watermark: neither put nor answered
    s.batch([put("p", AT + 20 * DAY, 1, "late"), ask("p", AT + 20 * DAY, 11), ask("p", AT + 40 * DAY, 12)])
    got, expired = s.answers()
    assert got == {1: ("hit", "posted"), 2: ("none", None), 3: ("miss", None), 4: ("hit", "curated"), 5: ("none", None), 6: ("miss", None), 7: ("hit", "posted"), 8: ("hit", "posted"), 13: ("hit", "posted"), 9: ("hit", "posted"), 10: ("miss", None), 12: ("hit", "later")}
    assert {k: v for k, v in table(store, one + two + three + [ask("p", AT + 40 * DAY, 12)]).items()} == got
    second = dt.timedelta(seconds=1)
    assert expired == [("p", AT + 2 * DAY + second, None), ("p", AT + 30 * DAY + second, "posted"), ("q", AT + DAY + second, None)]


def test_stream_gives_what_the_table_gives(store, tmp_path):
    """Events at random, out of order within what the watermark allows; entries before the asks of their batch."""
    rng = random.Random(4)
    s, everything, t = Stream(store, str(tmp_path), late="6 hours"), [], AT
    for b in range(4):
        rows = []
        for _ in range(120):
            t += rng.choice([0, 1, 2, 9]) * HOUR / 2
            p = rng.choice("pqrst")
            rows.append(put(p, t, rng.randint(1, 4), None if p == "t" else rng.choice([None, f"n{rng.random()}"])) if rng.random() < 0.6 else ask(p, t, len(everything) + len(rows)))
        rng.shuffle(rows)
        everything += rows
        s.batch(rows)
    got, _ = s.answers()
    assert got == table(store, everything)
    assert {v for v, _ in got.values()} == {"hit", "none", "miss"}


def test_empty_stream_and_table(store, tmp_path):
    s = Stream(store, str(tmp_path))
    s.batch([])
    assert table(store, []) == {}


def test_an_old_entry_hides_no_later_one(spark, tmp_path):
    """Kept as a table: priority 1 of January is over in June, when priority 2 still lives."""
    january, june = AT, dt.datetime(2024, 6, 1)
    spark.createDataFrame([("pypi", "p", "1", 1, "known_adapter", "old", False, january), ("pypi", "p", "1", 2, "github_release", "new", False, june)], stream.CANDIDATES).repartition(2).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(stream.CANDIDATES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.keep_cache(source, str(tmp_path / "cache"), str(tmp_path / "ck"), compact_every=1).awaitTermination()
    found = lambda now: [(r.prio, r.notes) for r in stream.read_cache(spark, str(tmp_path / "cache"), now).collect()]
    assert found(F.lit(june)) == [(2, "new")] and found(F.lit(january)) == [(1, "old")] and found(None) == [(1, "old")]
    got = sources.cache_get(spark.createDataFrame([("pypi", "p", "1")], "ecosystem string, package string, version string"), stream.read_cache(spark, str(tmp_path / "cache"), F.lit(june)), stream.KEY, F.lit(june))
    assert (got.first().state, got.first().notes) == ("hit", "new")
