"""Landed registry and advisory documents as tables. Fetching is not part of a query: a loader writes what it got to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import REPO_KEYS
from ..functions.paths import repository
from ..functions.versions import version_key

PYPI = "info struct<name:string,home_page:string,project_urls:map<string,string>>, releases map<string,array<struct<filename:string>>>"
NPM = "name string, versions map<string,struct<version:string,deprecated:string>>, repository string"
ADVISORY = "ghsa_id string, summary string, severity string, html_url string, vulnerabilities array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string>>"


def read_pypi(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PYPI).option("multiLine", True).json(path)


def read_npm(spark: SparkSession, path: str) -> DataFrame:
    """repository stays JSON text, since it is an object or a string."""
    return spark.read.schema(NPM).option("multiLine", True).json(path)


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ADVISORY).option("multiLine", True).json(path)
    v = F.transform(F.coalesce("vulnerabilities", F.array().cast("array<struct<package:struct<ecosystem:string,name:string>,vulnerable_version_range:string>>")), lambda x: F.struct(x["package"]["ecosystem"].alias("ecosystem"), x["package"]["name"].alias("name"), x["vulnerable_version_range"].alias("range")))
    return raw.select("ghsa_id", F.trim(F.coalesce("summary", F.lit(""))).alias("summary"), F.coalesce("severity", F.lit("unknown")).alias("severity"), F.coalesce("html_url", F.lit("")).alias("html_url"), v.alias("vulnerabilities"))


def pypi_releases(meta: DataFrame) -> DataFrame:
    """ecosystem, package, version, n_files of releases with files and a valid version."""
    rows = meta.select(F.lit("pypi").alias("ecosystem"), F.col("info.name").alias("package"), F.explode("releases").alias("version", "files"))
    return rows.where((F.size("files") > 0) & version_key(F.col("version")).isNotNull()).select("ecosystem", "package", "version", F.size("files").cast("long").alias("n_files"))


def npm_releases(meta: DataFrame) -> DataFrame:
    rows = meta.select(F.lit("npm").alias("ecosystem"), F.col("name").alias("package"), F.explode(F.map_keys("versions")).alias("version"))
    return rows.where(version_key(F.col("version")).isNotNull()).withColumn("n_files", F.lit(None).cast("long"))


def registry(pypi: DataFrame, npm: DataFrame) -> DataFrame:
    return pypi_releases(pypi).unionByName(npm_releases(npm))


def npm_repository(field: Column) -> Column:
    """Of an object with url, or of a string; null for anything else or another host."""
    text = field.cast("string")
    url = F.when(text.startswith("{"), F.get_json_object(text, "$.url")).otherwise(F.regexp_replace(text, r'^"|"$', ""))
    return F.when(F.contains(url, F.lit("github.com")), repository(url))


def pypi_repository(meta: DataFrame, package: str = "package") -> DataFrame:
    """package, repo of rows (package, urls array<struct<key, url>> in order, home_page): by the key that ranks first, else the
    first address that names a repository."""
    home = F.when(F.contains(F.coalesce("home_page", F.lit("")), F.lit("github.com")), F.array(F.struct(F.lit("home_page").alias("key"), F.col("home_page").alias("url")))).otherwise(F.array().cast("array<struct<key:string,url:string>>"))
    urls = F.filter(F.coalesce("urls", F.array().cast("array<struct<key:string,url:string>>")), lambda x: F.contains(x["url"], F.lit("github.com")))
    ok = F.filter(F.transform(F.concat(urls, home), lambda x: F.struct(F.lower(x["key"]).alias("key"), repository(x["url"]).alias("repo"))), lambda x: x["repo"].isNotNull())
    rank = lambda x: F.coalesce(F.array_min(F.filter(F.transform(F.lit([k.lower() for k in REPO_KEYS]), lambda k, i: F.when(F.contains(x["key"], k), i)), lambda v: v.isNotNull())), F.lit(len(REPO_KEYS)))
    best = F.array_min(F.transform(ok, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x["repo"].alias("repo"))))
    return meta.select(package, best["repo"].alias("repo"))


def npm_deprecations(meta: DataFrame) -> DataFrame:
    """package, version, source, text, url of versions that carry a notice."""
    rows = meta.select(F.col("name").alias("package"), F.explode("versions").alias("version", "v")).where("v.deprecated is not null and v.deprecated != ''")
    return deprecation_notes(rows.select("package", "version", F.col("v.deprecated").alias("message")))


def deprecation_notes(rows: DataFrame) -> DataFrame:
    return rows.where("message is not null and message != ''").select(
        "package", "version", F.lit("npm Registry Deprecation Notice").alias("source"),
        F.concat(F.lit("This version is marked deprecated by the maintainer: "), "message").alias("text"),
        F.concat(F.lit("https://www.npmjs.com/package/"), "package", F.lit("/v/"), "version").alias("url"),
    )
