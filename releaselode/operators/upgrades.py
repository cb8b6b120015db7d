"""Upgrade paths: which releases lie between two versions, and how large each step is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import BUMPS
from ..functions.versions import classify_bump, is_prerelease, version_bytes, version_key


def releases(df: DataFrame) -> DataFrame:
    """ecosystem, package, version, key: once each; without files or without a valid version a release doesn't count."""
    has_files = F.col("n_files") > 0 if "n_files" in df.columns else F.lit(True)
    return df.where(has_files).select("ecosystem", "package", "version").distinct().withColumn("key", version_key(F.col("version"))).where("key is not null")


def version_order(df: DataFrame) -> DataFrame:
    """releases(df) with `ord` from 1 in each package of each ecosystem; equal versions of different spelling by spelling."""
    w = Window.partitionBy("ecosystem", "package").orderBy("key", "version")
    return releases(df).select("ecosystem", "package", "version", F.row_number().over(w).cast("long").alias("ord"))


def land_releases(df: DataFrame, path: str) -> None:
    """Write releases(df) sorted by ecosystem, package and version, in ranges: ecosystem, package, version, order binary.

    A path of one request is then a range of one or two files' row groups; see landed_path."""
    rows = releases(df).select("ecosystem", "package", "version", version_bytes(F.col("key")).alias("order"))
    by = ["ecosystem", "package", "order", "version"]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def landed_path(spark: SparkSession, path: str, ecosystem: str, package: str, current: str, target: str, prereleases: bool = False) -> DataFrame:
    """version, step: what upgrade_path gives for one request, read from landed releases by filters that reach the files; none where it isn't ok."""
    rows = spark.read.parquet(path).where((F.col("ecosystem") == ecosystem) & (F.col("package") == package))
    asked = spark.createDataFrame([(current, target)], "a string, z string").select(*(version_bytes(version_key(F.col(c))).alias(c) for c in "az")).first()
    ends = {r.version for r in rows.where(F.col("version").isin(current, target)).select("version").collect()}
    if ends != {current, target} or asked.a >= asked.z:
        return rows.where("false").select("version", F.lit(0).cast("long").alias("step"))
    rows = rows.where((F.col("order") > F.lit(bytes(asked.a))) & (F.col("order") <= F.lit(bytes(asked.z))))
    if not prereleases:
        rows = rows.where(~is_prerelease(version_key(F.col("version"))))
    return rows.select("version", F.row_number().over(Window.orderBy("order", "version")).cast("long").alias("step"))


def request_status(requests: DataFrame, found: DataFrame) -> DataFrame:
    """requests with current_key, target_key and status: ok, current_not_found, target_not_found or not_newer."""
    end = lambda name: found.select("ecosystem", "package", F.col("version").alias(name), F.col("key").alias(name.replace("version", "key")))
    out = requests.join(end("current_version"), ["ecosystem", "package", "current_version"], "left").join(end("target_version"), ["ecosystem", "package", "target_version"], "left")
    status = F.when(F.col("current_key").isNull(), "current_not_found").when(F.col("target_key").isNull(), "target_not_found").when(F.col("current_key") >= F.col("target_key"), "not_newer").otherwise("ok")
    return out.withColumn("status", status)


def upgrade_path(requests: DataFrame, df: DataFrame, prereleases: bool = False) -> DataFrame:
    """ecosystem, package, current_version, target_version, version, key, step, bump: current < version <= target, oldest first.

    Requests are joined with the releases of their package only; the order within a request is a window over its path."""
    found = releases(df)
    ok = request_status(requests, found).where("status = 'ok'")
    path = ok.join(found, ["ecosystem", "package"]).where((F.col("key") > F.col("current_key")) & (F.col("key") <= F.col("target_key")))
    if not prereleases:
        path = path.where(~is_prerelease(F.col("key")))
    w = Window.partitionBy("ecosystem", "package", "current_version", "target_version").orderBy("key", "version")
    path = path.withColumn("step", F.row_number().over(w).cast("long")).withColumn("bump", classify_bump(F.lag("key", 1).over(w), F.col("key")))
    path = path.withColumn("bump", F.when(F.col("step") == 1, classify_bump(F.col("current_key"), F.col("key"))).otherwise(F.col("bump")))
    return path.withColumn("previous", F.coalesce(F.lag("version", 1).over(w), "current_version")).select("ecosystem", "package", "current_version", "target_version", "version", "key", "step", "previous", "bump")


def overall_bump(requests: DataFrame, path: DataFrame) -> DataFrame:
    """package, bump: the largest step of each request; patch for an empty path."""
    rank = F.array_position(F.lit(BUMPS), F.col("bump"))
    top = path.groupBy("ecosystem", "package", "current_version", "target_version").agg(F.max(rank).alias("r"))
    return requests.join(top, ["ecosystem", "package", "current_version", "target_version"], "left").select("package", F.element_at(F.lit(BUMPS), F.coalesce("r", F.lit(1)).cast("int")).alias("bump"))
