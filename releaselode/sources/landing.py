"""Landed tables laid out by repository, so that those whose notes are known already are not read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders of a landed table.
BUCKETS = 512


def bucket_of(repo: Column) -> Column:
    return F.pmod(F.xxhash64(repo), F.lit(BUCKETS)).cast("int")


def land(rows: DataFrame, path: str, files: int = 8) -> None:
    """Append rows (with a repo) below path, a folder a bucket; a repository with very many rows goes to up to `files` files."""
    out = rows.withColumn("bucket", bucket_of(F.col("repo")))
    out.repartition("bucket", F.pmod(F.xxhash64(*rows.columns), F.lit(files))).write.mode("append").partitionBy("bucket").parquet(path)


def of_repositories(landed: DataFrame, repos: DataFrame) -> DataFrame:
    """The rows of these repositories. Folders without any of them are not read: their numbers, BUCKETS at most, come to the driver."""
    repos = repos.select("repo").where("repo is not null").distinct()
    if "bucket" in landed.columns:
        wanted = [r.bucket for r in repos.select(bucket_of(F.col("repo")).alias("bucket")).distinct().collect()]
        landed = landed.where(F.col("bucket").isin(wanted)).drop("bucket")
    return landed.join(repos, "repo", "left_semi")
