"""Which source's notes count, whether a second one agrees, and what was found before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import disagree

PRIORITY = ["known_adapter", "github_release", "changelog", "commits"]
FOUND_TTL, MISSING_TTL = 30 * 86400, 86400


def resolve_source(candidates: DataFrame, key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """key, prio, kind, notes_text, carry, had_error, unavailable: the first source in order of priority that has notes."""
    return _resolved(candidates, key, carry)


def cross_check(candidates: DataFrame, key: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """resolve_source, with the release notes as second source where the first is curated, and whether they disagree.

    What is carried is there for the second source too, as cross_<name>. One aggregation gives both."""
    second = F.max(F.when(F.col("kind") == "github_release", F.struct("notes_text", *carry))).alias("second")
    both = _resolved(candidates, key, carry, second)
    curated = F.col("kind").isin("known_adapter", "changelog") & F.col("second.notes_text").isNotNull()
    both = both.withColumns({"cross_text" if c == "notes_text" else f"cross_{c}": F.when(curated, F.col(f"second.{c}")) for c in ("notes_text", *carry)}).drop("second")
    return both.withColumn("discrepancy", F.coalesce(disagree(F.col("notes_text"), F.col("cross_text")), F.lit(False)))


def _resolved(candidates: DataFrame, key: list[str], carry: tuple[str, ...], *more: Column) -> DataFrame:
    has = F.col("notes_text").isNotNull()
    best = F.min(F.when(has, F.struct("prio", "kind", "notes_text", *carry))).alias("best")
    out = candidates.groupBy(*key).agg(best, F.coalesce(F.bool_or(F.col("had_error") & F.col("kind").isin("github_release", "commits")), F.lit(False)).alias("had_error"), *more)
    found = [F.col(f"best.{c}").alias(c) for c in ("prio", "kind", "notes_text", *carry)]
    return out.select(*key, *found, "had_error", (F.col("best").isNull() & F.col("had_error")).alias("unavailable"), *(["second"] if more else []))


def note_status() -> Column:
    return F.when(F.col("notes_text").isNotNull(), "notes").when(F.col("unavailable"), "unavailable").otherwise("no_notes")


def cache_key(ecosystem: Column, package: Column, version: Column, source: Column) -> Column:
    joined = F.concat(ecosystem, F.lit(":"), package, F.lit(":"), version, F.lit(":"), source)
    return F.concat(F.substring(F.sha2(joined, 256), 1, 24), F.lit(".json"))


def cache_set(entries: DataFrame, key: list[str]) -> DataFrame:
    """The latest entry of each key."""
    rest = [c for c in entries.columns if c not in {*key, "cached_at"}]
    return entries.groupBy(*key).agg(F.max(F.struct("cached_at", *rest)).alias("r")).select(*key, "r.*")


def cache_get(asked: DataFrame, cache: DataFrame, key: list[str], now: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """asked with state (hit, none, miss), and notes and what is carried of a hit: an entry lives 30 days if notes were found, one day if not."""
    age = F.unix_timestamp(now) - F.unix_timestamp("cached_at")
    live = F.col("cached_at").isNotNull() & (age <= F.when(F.col("found"), FOUND_TTL).otherwise(MISSING_TTL))
    out = asked.join(cache.select(*key, "found", "notes", "cached_at", *carry), key, "left")
    out = out.withColumn("state", F.when(F.coalesce(live, F.lit(False)) & F.col("found"), "hit").when(F.coalesce(live, F.lit(False)), "none").otherwise("miss"))
    return out.withColumns({c: F.when(F.col("state") == "hit", F.col(c)) for c in ("notes", *carry)}).drop("found", "cached_at")


def cache_lookups(events: DataFrame, key: list[str]) -> DataFrame:
    """key, at, ask, state, notes of every row that asks, by the entries that were put until then.

    events: key, at, ask (null for an entry), prio, found, notes. Of each priority the latest entry counts while it lives (30 days if notes
    were found, one day if not); of these one with notes comes first, then the one of the higher priority. A running value over a
    key's events, so a busy key is sorted and read once, never held."""
    w = Window.partitionBy(*key).orderBy("at", F.col("ask").isNotNull(), "found", F.coalesce("notes", F.lit(""))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.struct(F.col("at").alias("put"), "found", "notes")
    latest = [F.last(F.when(F.col("ask").isNull() & (F.col("prio") == i), entry), ignorenulls=True).over(w) for i in range(1, len(PRIORITY) + 1)]
    age = lambda x: F.unix_timestamp(F.col("at")) - F.unix_timestamp(x["put"])
    live = lambda x: x.isNotNull() & (age(x) <= F.when(x["found"], FOUND_TTL).otherwise(MISSING_TTL))
    ranked = F.transform(F.filter(F.array(*latest), live), lambda x: F.struct((~x["found"]).alias("empty"), x["notes"].alias("notes")))
    found = F.filter(ranked, lambda x: ~x["empty"])
    out = events.withColumns({"_live": ranked, "_found": found}).where("ask is not null")
    state = F.when(F.size("_found") > 0, "hit").when(F.size("_live") > 0, "none").otherwise("miss")
    return out.select(*key, "at", "ask", state.alias("state"), F.get("_found", F.lit(0))["notes"].alias("notes"))
