"""The note cache as state of a stream: entries are put, asked for and forgotten by event time.

events: ecosystem, package, version, at timestamp, ask long (null for an entry that is put), prio int, found boolean, notes string.
Each key's state holds its entries by priority: those later than the watermark, and the last one before it. A timer of event time
forgets an entry 30 days after it was put, or one day where nothing was found. An ask is answered by the live entry (put by then,
not yet forgotten) that ranks first: with notes before without, then by priority, then the latest. Answers are what
operators.sources.cache_lookups gives, as far as entries came before the asks; rows later than the watermark are dropped.

The state of a key is a handful of entries. The rows of one key in one batch are sorted in memory, so the source's limit on a
batch (as maxFilesPerTrigger) bounds them. State and timers live in the checkpoint; a query that is started again goes on from there."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sources import FOUND_TTL, MISSING_TTL
from ..session import ship

KEY = ["ecosystem", "package", "version"]
EVENTS = "ecosystem string, package string, version string, at timestamp, ask long, prio int, found boolean, notes string"
ANSWERS = "ecosystem string, package string, version string, at timestamp, ask long, state string, notes string"
#: Value of spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _expiry(at: int, found: bool) -> int:
    """The last microsecond at which an entry is live: ages count in whole seconds."""
    return (at // 1_000_000 + (FOUND_TTL if found else MISSING_TTL) + 1) * 1_000_000 - 1


class NoteCache(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "prio int, at long", "found boolean, notes string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        mark = (timerValues.getCurrentWatermarkInMs() or 0) * 1000
        known = {tuple(k): tuple(v) for k, v in self.entries.iterator()}
        came = pd.concat(list(rows))
        # of one time, entries come before asks
        came = came.assign(asks=came["ask"].notna()).sort_values(["us", "asks"], kind="stable")
        answers, put = [], set()
        for r in came.itertuples():
            if not r.asks:
                one, value = (int(r.prio), int(r.us)), (bool(r.found), r.notes if isinstance(r.notes, str) else None)
                # of one time and priority, notes rank as in the table's answer
                if one not in known or (value[0], value[1] or "") > (known[one][0], known[one][1] or ""):
                    known[one] = value
                    put.add(one)
                continue
            latest: dict[int, int] = {}
            for p, t in known:
                if t <= r.us:
                    latest[p] = max(t, latest.get(p, t))
            live = [(not known[p, t][0], p, t) for p, t in latest.items() if r.us <= _expiry(t, known[p, t][0])]
            best = min(live)[1:] if live else None
            state = "miss" if best is None else "hit" if known[best][0] else "none"
            answers.append((*key, int(r.us), int(r.ask), state, known[best][1] if state == "hit" else None))
        # of each priority only the last entry before the watermark can still answer
        for p in {p for p, _ in known}:
            for t in sorted(t for q, t in known if q == p and t <= mark)[:-1]:
                self._forget(p, t, known.pop((p, t)))
                put.discard((p, t))
        for p, t in put:
            self.entries.updateValue((p, t), known[p, t])
            self.handle.registerTimer(_expiry(t, known[p, t][0]) // 1000 + 1)
        yield _frame(answers)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        known = {tuple(k): tuple(v) for k, v in self.entries.iterator()}
        over = {(p, t) for (p, t), (found, _) in known.items() if _expiry(t, found) < now}
        gone = []
        for p, t in sorted(over):
            ends = _expiry(t, known[p, t][0])
            if not any(q == p and t < u <= ends for q, u in known):
                gone.append((*key, ends + 1, None, "expired", known[p, t][1]))
        # what an entry has replaced goes with it, so that it never comes back
        for p, t in {(q, u) for q, u in known if any(q == p and u <= t for p, t in over)}:
            self.entries.removeKey((p, t))
        yield _frame(gone)

    def _forget(self, p: int, t: int, value: tuple[bool, str | None]) -> None:
        if self.entries.containsKey((p, t)):
            self.entries.removeKey((p, t))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[*KEY, "us", "ask", "state", "notes"]).astype({"us": "int64", "ask": "Int64"})


def cached(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ANSWERS as a stream: one row for each ask, and one with state 'expired' for each entry that no other one replaced before its time was over.

    The session's state store must be the one on disk (STORE), which keeps timers."""
    spark: SparkSession = events.sparkSession
    ship(spark)
    # times go in and out as microseconds, since pandas would have them in the session's time zone
    rows = events.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    out = rows.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=NoteCache(), outputStructType=ANSWERS.replace("at timestamp", "us long"), outputMode="append", timeMode="EventTime")
    return out.select(*KEY, F.timestamp_micros("us").alias("at"), "ask", "state", "notes")
