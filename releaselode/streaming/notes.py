"""Notes as a stream: landed candidates are resolved as they come, and the cache of resolved notes is kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sources import FOUND_TTL, MISSING_TTL, resolve_source

KEY = ["ecosystem", "package", "version"]
CANDIDATES = "ecosystem string, package string, version string, prio int, kind string, notes_text string, had_error boolean, landed_at timestamp"


def landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(CANDIDATES).parquet(path)


def busy_packages(candidates: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ecosystem, package, window, candidates, missing: windowed counts; candidates later than the watermark don't count."""
    return (
        candidates.withWatermark("landed_at", late)
        .groupBy(F.window("landed_at", window), "ecosystem", "package")
        .agg(F.count("*").alias("candidates"), F.count_if(F.col("notes_text").isNull()).alias("missing"))
    )


def keep_cache(candidates: DataFrame, cache: str, checkpoint: str, compact_every: int = 16) -> StreamingQuery:
    """Each batch resolves its versions and adds one generation of entries (prio, found, notes, cached_at) to the cache; versions whose
    sources were unavailable are left for a later batch. A batch that is repeated replaces its own generation.

    Entries keep the priority of their source: the latest one of each priority stays, and readers choose among those that live. Every `compact_every` batches all generations are merged into one; those merged before that go."""

    def upsert(batch: DataFrame, number: int) -> None:
        at = batch.groupBy(*KEY).agg(F.max("landed_at").alias("cached_at"))
        out = resolve_source(batch, KEY).where("not unavailable").join(at, KEY)
        rows = out.select(*KEY, F.lit("resolved").alias("source"), "prio", F.col("notes_text").isNotNull().alias("found"), F.col("notes_text").alias("notes"), "cached_at")
        rows.write.mode("overwrite").parquet(f"{cache}/generation={2 * number}")
        if number % compact_every == compact_every - 1:
            # merged entries under the next number; a generation that was merged, but is still there, changes nothing
            spark = batch.sparkSession
            _entries(spark, cache).write.mode("overwrite").parquet(f"{cache}/generation={2 * number + 1}")
            _drop_before(spark, cache, 2 * (number - compact_every) + 1)

    return candidates.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _drop_before(spark: SparkSession, cache: str, number: int) -> None:
    """Delete the generations up to the merged one before the last, so that readers of the last one aren't disturbed."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(cache)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("generation=") and int(name.split("=")[1]) < number:
            fs.delete(f.getPath(), True)


def _entries(spark: SparkSession, cache: str) -> DataFrame:
    """The latest entry of each key and priority over all generations; of one time, one with notes."""
    rows = spark.read.parquet(cache).drop("generation")
    latest = F.max(F.struct("cached_at", "found", "notes")).alias("e")
    return rows.groupBy(*KEY, "source", "prio").agg(latest).select(*KEY, "source", "prio", "e.found", "e.notes", "e.cached_at")


def read_cache(spark: SparkSession, cache: str, now: Column | None = None) -> DataFrame:
    """One entry of each key: one with notes before one without, then by priority. Where `now` is given, only of those that still live
    then, so that an old entry never hides a later one of lower priority."""
    rows = _entries(spark, cache)
    if now is not None:
        age = F.unix_timestamp(now) - F.unix_timestamp("cached_at")
        rows = rows.where(age <= F.when(F.col("found"), FOUND_TTL).otherwise(MISSING_TTL))
    best = F.struct((~F.col("found")).alias("o"), "prio", "found", "notes", "cached_at")
    return rows.groupBy(*KEY, "source").agg(F.min(best).alias("b")).select(*KEY, "source", "b.prio", "b.found", "b.notes", "b.cached_at")
