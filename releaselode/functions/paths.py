"""Addresses of repositories and paths of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import SKIPPED_FOLDERS, SOURCE_EXTENSIONS
from .text import strip


def repository(url: Column) -> Column:
    """owner/name of a repository's address, or null."""
    u = F.replace(F.replace(F.regexp_replace(strip(url), "/+$", ""), F.lit("git+"), F.lit("")), F.lit(".git"), F.lit(""))
    parts = F.split(F.substring_index(u, "github.com/", -1), "/")
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.when((a != "") & (b != ""), F.concat_ws("/", a, b))


def folders(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))


def is_skipped(path: Column) -> Column:
    return F.arrays_overlap(folders(path), F.lit(SKIPPED_FOLDERS))


def is_test(path: Column) -> Column:
    parts = folders(F.lower(path))
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.lit(["tests", "test"])) | name.startswith("test_") | name.rlike(r"_test\.pyi?$")


def is_source(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^\.*[^.].*?(\.[^.]*)$", 1)).isin(SOURCE_EXTENSIONS)
