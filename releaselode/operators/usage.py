"""What a project's files use: every distinct content is parsed once into facts; paths and interfaces are joined with these.

Python's parser is the one thing here that columns can't express, so the facts come from mapInPandas, content by content. Facts
belong to a content's digest: copies of a file are parsed once, and what was parsed in an earlier run need not be parsed again."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_skipped, is_source, is_test
from ..session import ship

FACTS = "digest string, fact string, name string, ord int, line int, code string, method string"


def source_files(files: DataFrame) -> DataFrame:
    """path, content, is_test of the files that count as a user's sources."""
    return files.where(is_source(F.col("path")) & ~is_skipped(F.col("path"))).withColumn("is_test", is_test(F.col("path")))


def scan_summary(files: DataFrame) -> DataFrame:
    """files_scanned, files_skipped, skipped_directories: skipped folders are never entered, so they aren't counted."""
    return source_files(files).agg(F.count("*").alias("files_scanned"), F.lit(0).cast("long").alias("files_skipped"), F.array().cast("array<string>").alias("skipped_directories"))


def _names(tree: ast.AST) -> tuple[set[str], dict[str, str], bool]:
    """Names bound to the module or parts of it, names bound to its members, and whether all were imported by *."""
    modules, members, star = set(), {}, False
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                if a.name == "numpy":
                    modules.add(a.asname or "numpy")
                    members[a.asname or "numpy"] = "numpy"
                elif a.name.startswith("numpy."):
                    modules.add(a.asname or a.name.split(".")[1])
        elif isinstance(node, ast.ImportFrom) and node.module == "numpy":
            for a in node.names:
                if a.name == "*":
                    star = True
                else:
                    members[a.asname or a.name] = f"numpy.{a.name}"
    for node in ast.walk(tree):
        match node:
            case ast.Assign(targets=[ast.Name(id=target)], value=ast.Attribute(value=ast.Name(id=owner), attr=attr)) if owner in modules:
                members[target] = f"numpy.{attr}"
            case ast.Assign(targets=[ast.Name(id=target)], value=ast.Name(id=name)) if name in members:
                members[target] = members[name]
    return modules, members, star


def facts_of(digest: str, content: str) -> Iterator[tuple]:
    """(digest, fact, name, ord, line, code, method); a file that can't be parsed has none."""
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    modules, members, star = _names(tree)
    for i, node in enumerate(ast.walk(tree)):
        code = lambda: ast.get_source_segment(content, node)  # noqa: B023, E731
        match node:
            case ast.Call(func=ast.Attribute(value=ast.Name(id=owner), attr=attr)) if owner in modules:
                yield digest, "call", f"numpy.{attr}", i, node.lineno, code(), "ast_attribute_call"
            case ast.Call(func=ast.Attribute(value=ast.Attribute(value=ast.Name(id="numpy")), attr=attr)):
                yield digest, "call", f"numpy.{attr}", i, node.lineno, code(), "ast_attribute_call"
            case ast.Call(func=ast.Name(id=name)):
                if name in members:
                    yield digest, "call", members[name], i, node.lineno, code(), "ast_call"
                if star:
                    yield digest, "star_call", name, i, node.lineno, code(), "ast_wildcard_import_name_match"
            case ast.Assign() | ast.AugAssign():
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                for attr in dict.fromkeys(t.attr for t in targets if isinstance(t, ast.Attribute)):
                    yield digest, "attribute", attr, i, node.lineno, code(), "ast_attribute_assignment (type not verified)"


def _digested(files: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return source_files(files).select("path", "is_test", content.alias("content"), F.sha2(content, 256).alias("digest"))


def new_contents(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """digest, content of the source files: each content once, none whose digest is among known(digest).

    The file with the smallest path stands for its copies; it is found by path and digest, so that very many copies of one file never meet."""
    rows = _digested(files)
    shown = rows.groupBy("digest").agg(F.min("path").alias("path"))
    if known is not None:
        shown = shown.join(known.select("digest").distinct(), "digest", "left_anti")
    return rows.join(shown, ["digest", "path"], "left_semi").select("digest", "content")


def content_facts(contents: DataFrame) -> DataFrame:
    """digest, fact, name, ord, line, code, method of each content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            rows = [f for d, c in zip(b["digest"], b["content"], strict=True) for f in facts_of(d, c)]
            yield pd.DataFrame(rows, columns=names).astype({"ord": "int32", "line": "int32"})

    ship(contents.sparkSession)
    # a path that is listed twice gives its content twice
    return contents.select("digest", "content").mapInPandas(run, FACTS).distinct()


def usage_facts(files: DataFrame, parsed: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """path, fact, name, ord, line, code, method, is_test. parsed: content_facts of an earlier run, and known(digest) all contents it has
    seen (some have no facts); then only new ones are parsed."""
    facts = content_facts(new_contents(files, known))
    if parsed is not None:
        facts = facts.unionByName(parsed.select(*facts.columns))
    names = [c.split()[0] for c in FACTS.split(", ")][1:]
    return _digested(files).select("path", "is_test", "digest").join(facts, "digest").select("path", *names, "is_test")


def api_usage(apis: DataFrame, facts: DataFrame) -> DataFrame:
    """api, path, line, code, kind, confidence, detection_method, is_test for apis(api).

    Confirmed: the first call in each file that resolves to the name. Potential: if there is none anywhere, the
    first call of the bare name in the first file that imports everything; first is the smallest path."""
    first = lambda f: f.groupBy("name", "path").agg(F.min(F.struct("ord", "line", "code", "method", "is_test")).alias("r"))
    calls = first(facts.where("fact = 'call'")).select(F.col("name").alias("api"), "path", "r.*")
    asked = apis.where(F.col("api").startswith("numpy.")).select("api").distinct()
    sure = asked.join(calls, "api").select("api", "path", "line", "code", F.lit("confirmed").alias("kind"), F.lit("HIGH").alias("confidence"), F.col("method").alias("detection_method"), "is_test")
    starred = first(facts.where("fact = 'star_call'")).groupBy("name").agg(F.min(F.struct("path", "r")).alias("f"))
    open_ = asked.join(sure.select("api").distinct(), "api", "left_anti").withColumn("name", F.substring_index("api", ".", -1))
    maybe = open_.join(starred, "name").select("api", "f.path", "f.r.line", "f.r.code", F.lit("potential").alias("kind"), F.lit("LOW").alias("confidence"), F.col("f.r.method").alias("detection_method"), "f.r.is_test")
    return sure.union(maybe)


def attribute_usage(attributes: DataFrame, facts: DataFrame) -> DataFrame:
    """attribute, path, line, code, kind, confidence, detection_method, is_test for attributes(attribute): every assignment."""
    found = facts.where("fact = 'attribute'").withColumnRenamed("name", "attribute")
    return attributes.select("attribute").distinct().join(found, "attribute").select("attribute", "path", "line", "code", F.lit("potential").alias("kind"), F.lit("MEDIUM").alias("confidence"), F.col("method").alias("detection_method"), "is_test")


def usage_status(rank: Column, scanned: Column) -> Column:
    """rank: 2 if any hit is confirmed, 1 if any is potential, else 0 or null."""
    r = F.coalesce(rank, F.lit(0))
    return F.when(~scanned, "NOT_SCANNED").when(r == 2, "SCANNED_CONFIRMED").when(r == 1, "SCANNED_POTENTIAL").otherwise("SCANNED_NOT_FOUND")
