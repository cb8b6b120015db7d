"""Notes from landed files, releases and commits: repo, branch, path, text of raw files; repo, tag, body of releases.

Each reader gives rows repo, package, version, source, text, url: the first hit in the source's own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import ADAPTERS, CHANGELOGS
from ..operators.notes import exploded_lines, sections_of, version_sections


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path (below root), content of text files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/").split("://")[-1]
    return reader.load(root).select(F.substring_index("path", f"{base}/", -1).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def raw_files(files: DataFrame) -> DataFrame:
    """Those that say anything."""
    return files.where(T.strip(F.coalesce("text", F.lit(""))) != "")


def blob_url(repo: Column, branch: Column, path: Column) -> Column:
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), branch, F.lit("/"), path)


def release_tags(versions: DataFrame) -> DataFrame:
    """repo, package, version with i, tag: six spellings in the order in which they are tried."""
    v, name = F.col("version"), F.substring_index("repo", "/", -1)
    tags = F.array(v, F.concat(F.lit("v"), v), F.concat(F.lit("V"), v), F.concat(F.lit("release-"), v), F.concat(name, F.lit("-"), v), F.concat(F.col("package"), F.lit("=="), v))
    return versions.select("repo", "package", "version", F.posexplode(tags).alias("i", "tag"))


def first_release(asked: DataFrame, got: DataFrame) -> DataFrame:
    """got: repo, tag, text, html_url, had_error. The first tag that is there decides."""
    best = asked.join(got, ["repo", "tag"]).groupBy("repo", "package", "version").agg(F.min(F.struct("i", "had_error", "tag", "text", "html_url")).alias("b"))
    fine = lambda c: F.when(~F.col("b.had_error"), c)
    url = F.coalesce("b.html_url", F.concat(F.lit("https://github.com/"), "repo", F.lit("/releases/tag/"), "b.tag"))
    return best.select("repo", "package", "version", F.lit("GitHub Release Notes").alias("source"), fine(F.col("b.text")).alias("text"), fine(url).alias("url"), F.col("b.had_error").alias("had_error"))


def release_notes(versions: DataFrame, posts: DataFrame) -> DataFrame:
    """versions: repo, package, version. Six spellings of the tag are tried in order."""
    link = F.col("html_url") if "html_url" in posts.columns else F.lit(None).cast("string").alias("html_url")
    got = posts.select("repo", "tag", T.strip(F.coalesce("body", F.lit(""))).alias("text"), link, F.lit(False).alias("had_error"))
    return first_release(release_tags(versions), got.where("text != ''")).drop("had_error")


def changelog_notes(versions: DataFrame, files: DataFrame) -> DataFrame:
    """The first of twenty branch and file names with a section for the version. Each file is cut once for all versions."""
    ranked = F.broadcast(_ranked_names(files.sparkSession))
    some = raw_files(files).join(ranked, ["branch", "path"])
    cut = version_sections(exploded_lines(some, ["repo", "branch", "path", "i"]), ["repo", "branch", "path", "i"])
    asked = versions.select("repo", "version").distinct().join(some.select("repo", "branch", "path", "i").distinct(), "repo")
    hits = sections_of(asked, cut, ["repo", "branch", "path", "i"])
    best = hits.groupBy("repo", "version").agg(F.min(F.struct("i", "branch", "path", "body")).alias("b"))
    out = versions.select("repo", "package", "version").join(best, ["repo", "version"])
    return out.select("repo", "package", "version", F.concat(F.lit("CHANGELOG ("), "b.path", F.lit(")")).alias("source"), F.col("b.body").alias("text"), blob_url(F.col("repo"), F.col("b.branch"), F.col("b.path")).alias("url"))


def _ranked_names(spark: SparkSession) -> DataFrame:
    rows = [(b, p, i * len(CHANGELOGS) + j) for i, b in enumerate(("main", "master")) for j, p in enumerate(CHANGELOGS)]
    return spark.createDataFrame(rows, "branch string, path string, i int")


def compare_pairs(versions: DataFrame, key: list[str]) -> DataFrame:
    """key with i, old_tag, new_tag: both spellings of the previous version with both of the version."""
    pairs = F.flatten(F.transform(F.array(F.concat(F.lit("v"), "previous"), F.col("previous")), lambda o: F.transform(F.array(F.concat(F.lit("v"), "version"), F.col("version")), lambda n: F.struct(o.alias("old_tag"), n.alias("new_tag")))))
    return versions.where("previous is not null and previous != ''").select(*key, F.posexplode(pairs).alias("i", "p")).select(*key, "i", "p.*")


def first_compare(asked: DataFrame, got: DataFrame, key: list[str]) -> DataFrame:
    """got: repo, old_tag, new_tag, messages, had_error. The first pair that has messages, or failed, decides."""
    heads = F.filter(F.transform(F.coalesce("messages", F.array().cast("array<string>")), lambda m: F.substring_index(m, "\n", 1)), lambda m: T.strip(m) != "")
    got = got.withColumn("heads", heads).where(F.col("had_error") | (F.size("heads") > 0))
    best = asked.join(got, ["repo", "old_tag", "new_tag"]).groupBy(*key).agg(F.min(F.struct("i", "had_error", "old_tag", "new_tag", "heads")).alias("b"))
    fine = lambda c: F.when(~F.col("b.had_error"), c)
    text = F.array_join(F.transform("b.heads", lambda m: F.concat(F.lit("- "), m)), "\n")
    url = F.concat(F.lit("https://github.com/"), "repo", F.lit("/compare/"), "b.old_tag", F.lit("..."), "b.new_tag")
    return best.select(*key, F.lit("GitHub Commits").alias("source"), fine(text).alias("text"), fine(url).alias("url"), F.col("b.had_error").alias("had_error"))


def commit_notes(versions: DataFrame, compares: DataFrame, key: tuple[str, ...] = ("repo", "package", "version")) -> DataFrame:
    """versions: key with previous. compares: repo, old_tag, new_tag, messages array<string>."""
    return first_compare(compare_pairs(versions, [*key]), compares.withColumn("had_error", F.lit(False)), [*key]).drop("had_error")


def adapter_table(spark: SparkSession) -> DataFrame:
    rows = [(p, i, b, path, mode, label) for p, branches, path, mode, label in ADAPTERS for i, b in enumerate(branches)]
    return spark.createDataFrame(rows, "adapter string, branch_ord int, branch string, template string, mode string, source string")


def adapter_notes(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Notes of packages that keep them in a known place; versions without a minor part have none where the path needs it.

    files: one row for each repo, branch and path. A file of many versions is picked by its place and cut once; its sections or blocks
    meet the versions by their numbers, so a whole text never does."""
    known = F.broadcast(adapter_table(versions.sparkSession))
    parts = F.split("version", r"\.")
    minor = F.get(parts, F.lit(1))
    path = F.replace(F.replace(F.replace(F.col("template"), F.lit("{v}"), F.col("version")), F.lit("{maj}"), F.get(parts, F.lit(0))), F.lit("{min}"), F.coalesce(minor, F.lit("")))
    asked = versions.select("repo", "package", "version", F.lower(T.strip(F.col("package"))).alias("adapter")).join(known, "adapter")
    asked = asked.where(~F.contains("template", F.lit("{maj}")) | minor.isNotNull()).withColumn("path", path)
    key = ["repo", "branch", "path"]
    texts = raw_files(files).select(*key, "text")
    columns = ["repo", "package", "version", "branch_ord", "branch", "path", "source", "text"]
    of = {mode: asked.where(F.col("mode") == mode) for mode in ("file", "section", "directive")}
    picked = lambda mode: texts.join(of[mode].select(*key).distinct(), key, "left_semi")
    whole = of["file"].join(texts, key).select(*columns)
    cut = version_sections(exploded_lines(picked("section"), key), key)
    found = sections_of(of["section"].select(*key, "version").distinct(), cut, key).withColumnRenamed("body", "text")
    sections = of["section"].join(found, [*key, "version"]).select(*columns)
    blocks = of["directive"].join(directive_blocks(picked("directive"), key), [*key, "version"]).select(*columns)
    best = whole.union(sections).union(blocks).groupBy("repo", "package", "version").agg(F.min(F.struct("branch_ord", "branch", "path", "source", "text")).alias("b"))
    anchor = F.when(F.lower(T.strip(F.col("package"))) == "fastapi", F.concat(F.lit("#"), F.replace("version", F.lit("."), F.lit("")))).otherwise("")
    return best.select("repo", "package", "version", "b.source", "b.text", F.concat(blob_url(F.col("repo"), F.col("b.branch"), F.col("b.path")), anchor).alias("url"))


def directive_blocks(files: DataFrame, key: list[str]) -> DataFrame:
    """key, version, text: the prose of each file's `.. changelog::` blocks by their `:version:`; the first of a version that says anything."""
    chunks = F.slice(F.split("text", r"(?<=^|\n)\.\. changelog::\s*\n"), 2, 1 << 30)
    pattern = r"(?s)^\s*:version:\s*([\d.]+)(.*)$"
    rows = files.select(*key, F.posexplode(chunks).alias("i", "chunk")).withColumn("version", F.regexp_extract("chunk", pattern, 1)).where("version != ''")
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("chunk", pattern, 2), r"(?m)^\s*:\w[\w-]*:.*$", ""), r"\.\. change::\s*", "")
    body = T.strip(F.regexp_replace(body, r"\n{3,}", "\n\n"))
    return rows.withColumn("text", body).where("text != ''").groupBy(*key, "version").agg(F.min_by("text", "i").alias("text"))
