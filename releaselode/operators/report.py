"""Reports as text: lines are made as rows with their order and joined once for each request.

A report of usual length is one row of the result; of a very long one each row holds a part. Lines come sorted, and put_together appends them one by one."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..session import ship
from .risk import level, verdict_head, verdict_note

RULE = "=" * 60


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _lines(*lines: Column | str) -> Column:
    """array<string> without nulls."""
    return F.filter(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines)), lambda x: x.isNotNull())


def _section(rows: DataFrame, key: list[str], number: int | Column, title: str | Column, order: list, body: Column, numbered: bool = False) -> DataFrame:
    """key, section, ord, text: body (array<string>) of each row in order, maybe with its place before it; the heading stands before the first."""
    df = rows.withColumns({"section": F.lit(number) if isinstance(number, int) else number, "heading": F.lit(title) if isinstance(title, str) else title, "lines": body})
    w = Window.partitionBy(*key, "section").orderBy(*order)
    df = df.withColumn("ord", F.row_number().over(w).cast("long"))
    place = _join(F.col("ord").cast("string"), ". ") if numbered else F.lit("")
    head = F.when(F.col("ord") == 1, _join(f"{RULE}\n## ", F.col("heading"), "\n")).otherwise("")
    return df.select(*key, F.col("section").cast("int").alias("section"), "ord", F.concat(head, place, F.array_join("lines", "\n")).alias("text"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


#: Bytes of a part: a longer report goes on in further rows. Parquet's writer keeps 100 rows before it looks at their size, with several copies, in each task.
PART = 1 << 20
#: Finished parts are handed over when they come to this many bytes.
BATCH = 1 << 22


def put_together(rows: DataFrame, key: list[str], size: int = PART) -> DataFrame:
    """key (strings), part, report: the texts of each key, nulls left out, in order of section, ord, at (if there is one) and text; null if there is none.

    A report of up to `size` bytes is one row, with part 0. A longer one is cut between two texts into parts, from 0, that "\\n" joins. An aggregate
    would hold the lines of all reports of a task, before the shuffle too, and copy them several times; here a task sorts its lines, which Spark
    may spill, and holds one part."""
    order = [c for c in ("section", "ord", "at", "text") if c in rows.columns]

    def batch(done: list[tuple]) -> pa.RecordBatch:
        keys = [pa.array([k[i] for k, _, _ in done], pa.string()) for i in range(len(key))]
        reports = pa.array([None if r is None else bytes(r) for _, _, r in done], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*keys, pa.array([n for _, n, _ in done], pa.int32()), reports], [*key, "part", "report"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, part, text = None, 0, None
        for b in batches:
            for *k, line in zip(*(b.column(c).to_pylist() for c in key), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        yield now, part, text
                    now, part, text = k, 0, None
                if line is None:
                    continue
                if text is not None and len(text) + 1 + len(line) > size:
                    yield now, part, text
                    part, text = part + 1, None
                if text is None:
                    text = bytearray(line)
                else:
                    text += b"\n"
                    text += line
        if now is not None:
            yield now, part, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, n = [], 0
        for p in parts(batches):
            done.append(p)
            n += len(p[2] or b"") + 100
            if n > BATCH:
                yield batch(done)
                done, n = [], 0
        if done:
            yield batch(done)

    ship(rows.sparkSession)
    ranked = rows.repartition(*key).sortWithinPartitions(*key, *order)
    return ranked.select(*key, "text").mapInArrow(run, ", ".join([*(f"`{k}` string" for k in key), "part int", "report string"]))


def summary_report(requests: DataFrame, key: list[str], merged: DataFrame, changes: DataFrame, facts: DataFrame, discrepancies: DataFrame, statuses: DataFrame, scan: dict | None = None) -> DataFrame:
    """key, section, ord, at, text: the lines of the risk-oriented report.

    requests: key, package, current_version, target_version, bump. merged: key, category, version_ord, entry_ord, line (with its section). changes: of
    build_changes, with the same orders. facts: key and overall_status, dropped, supported, counts, confidences.
    discrepancies: key, version_ord, version, first_source, first_text, second_source, second_text. statuses: key, version_ord, version,
    status. scan: root and files of the project that was scanned."""
    c = F.col
    head = requests.join(facts, key)
    mark = lambda n, what: _join(F.when(n > 0, F.lit("⚠ ")).otherwise("✓ "), F.when(n > 0, n.cast("string")).otherwise("No"), f" {what}")
    project = [F.lit(f"Status: SCANNED ({scan['root']})"), F.lit(f"Files scanned: {scan['files']}"), mark(c("confirmed_apis"), "confirmed affected API(s)/operation(s)"), mark(c("potential_apis"), "potential affected API(s)/operation(s)"), mark(c("production_files"), "affected production file(s)"), mark(c("test_files"), "affected test file(s)")] if scan else [F.lit("Status: NOT SCANNED"), F.lit("Set PROJECT_SCAN_ROOT to your project's path to determine actual exposure.")]
    python = F.when((F.size("dropped") > 0) | c("supported").isNotNull(), F.array_join(F.concat(F.array(F.lit("Python Compatibility:")), F.transform("dropped", lambda v: _join("⚠ Python ", v, " is no longer supported.")), F.filter(F.array(_join("✓ Python ", c("supported"), " supported.")), lambda x: x.isNotNull())), "\n"))
    label = F.element_at(F.create_map(*(F.lit(x) for kv in X.BUMP_LABELS.items() for x in kv)), c("bump"))
    top = _lines(RULE, "## UPGRADE SUMMARY", _join("Package: ", c("package")), _join("From: ", c("current_version")), _join("To: ", c("target_version")), _join("Release Type: ", label), _join("Overall Risk: ", c("overall_status")), python, "Project Scan:", *project)
    parts = [head.select(*key, F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), F.array_join(top, "\n").alias("text"))]

    subject = F.coalesce("affected_api", "affected_operation", F.lit("Not explicitly identified"))
    replacement = F.coalesce("replacement_api", F.lit("Not explicitly specified"))
    source = F.when(F.coalesce("url", F.lit("")) != "", _join("   Source: ", c("url")))
    place = lambda h: _join("\n     File: ", h["path"], "\n     Line: ", h["line"].cast("string"), F.when(h["is_test"], " [test]").otherwise(" [production]"), F.when(F.coalesce(h["code"], F.lit("")) != "", _join("\n     Code: ", h["code"])).otherwise(""))
    three = F.slice(F.coalesce("hits", F.array()), 1, 3)
    found = F.coalesce("n_hits", F.lit(0)).cast("string")
    usage = (
        F.when(c("usage_status") == "NOT_SCANNED", "   Project Usage: NOT SCANNED")
        .when(c("usage_status") == "SCANNED_CONFIRMED", _join("   Project Usage: CONFIRMED (", found, " location(s))", F.array_join(F.transform(three, lambda h: _join(place(h), "\n     Detection: ", h["detection_method"])), "")))
        .when(c("usage_status") == "SCANNED_POTENTIAL", _join("   Project Usage: POTENTIAL (", found, " location(s), unproven)", F.array_join(F.transform(three, place), "")))
        .otherwise("   Project Usage: SCANNED - NOT FOUND")
    )
    old, new = (F.when(c(f"{w.lower()}_behavior").isNotNull(), _join(f"   {w} Behavior: ", c(f"{w.lower()}_behavior"))) for w in ("Old", "New"))
    first, affected, sure, advice = _join("Change: ", c("title")), _join("   Affected API/Operation: ", subject), _join("   Confidence: ", c("extraction_confidence")), _join("   Recommendation: ", c("recommendation"))
    impact = _join("   Impact: ", c("risk"))
    excerpt = _join('   Source Excerpt: "', T.strip(F.substring("source_excerpt", 1, 200)), '"')
    order = ["cat_ord", "version_ord", "entry_ord"]
    breaking = c("category").isin("Breaking Changes", "Expired Deprecations")
    deprecated, secure = c("category") == "New Deprecations", c("category") == "Security Updates"
    number = F.when(breaking, 1).when(deprecated, 2).when(secure, 5).otherwise(3)
    title = F.when(breaking, "BREAKING / MIGRATION IMPACT").when(deprecated, "DEPRECATIONS").when(secure, "SECURITY").otherwise("COMPATIBILITY CHANGES")
    body = (
        F.when(breaking, _lines(first, _join("   Type: ", c("change_type")), affected, old, new, _join("   Replacement: ", replacement), usage, sure, impact, advice, source, excerpt))
        .when(deprecated, _lines(first, affected, _join("   Replacement: ", replacement), sure, advice, source))
        .when(secure, _lines(c("title"), advice, source))
        .otherwise(_lines(first, affected, old, new, sure, impact, advice, source))
    )
    parts.append(_section(changes, key, number, title, order, body, numbered=True))
    listed = {"Build / Toolchain Changes": (4, "BUILD / TOOLCHAIN"), "New Features": (6, "NEW FEATURES"), "Performance Improvements": (7, "PERFORMANCE"), "Bug Fixes": (8, "BUG FIXES")}
    rest = merged.where(c("category").isin(list(listed))).withColumn("line", T.strip_section(c("line"))["text"])
    is_build = c("category") == "Build / Toolchain Changes"
    rest = rest.where(~((is_build | (c("category") == "New Features")) & T.is_noise_fragment(c("line"))))
    # titles of build changes are told apart by case-insensitive text, all others by their place
    rest = rest.withColumn("line", F.when(is_build, T.shortened(c("line"), 90)).otherwise(c("line")))
    same = F.when(is_build, F.lower("line")).otherwise(_join(c("version_ord").cast("string"), "/", c("entry_ord").cast("string"), "/", c("line")))
    rest = rest.groupBy(*key, "category", same.alias("same")).agg(F.min(F.struct("version_ord", "entry_ord", "line")).alias("b")).select(*key, "category", "b.*")
    by = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in listed.items() for x in (k, v[i]))), c("category"))
    parts.append(_section(rest, key, by(0), by(1), order[1:], _lines(_join("- ", c("line")))))
    cut = lambda t: T.strip(F.substring(t, 1, 200))
    parts.append(_section(discrepancies, key, 9, "SOURCE DISCREPANCIES", ["version_ord"], _lines(_join("⚠ Sources disagree for ", c("version"), ":"), _join("  ", c("first_source"), ": ", cut("first_text")), _join("  ", c("second_source"), ": ", cut("second_text")))))
    silent = statuses.where("status != 'notes'")
    why = F.when(c("status") == "unavailable", "source unavailable after retries - re-run later or set GITHUB_TOKEN").otherwise("unverified - no official source found")
    parts.append(_section(silent, key, 10, "VERIFICATION NOTES", [F.when(c("status") == "unavailable", 0).otherwise(1), "version_ord"], _lines(_join("⚠ ", c("version"), ": ", why))))
    if scan:
        count = lambda what, n: _join(f"{what}: ", c(n).cast("string"))
        lines = _lines(f"Scanned project: {scan['root']}", f"Files scanned: {scan['files']}", "Files skipped: 0", count("Confirmed affected APIs", "confirmed_apis"), count("Potential affected APIs", "potential_apis"), count("Affected production files", "production_files"), count("Affected test files", "test_files"))
        parts.append(_section(facts, key, 11, "CODE SCAN SUMMARY", [F.lit(1)], lines))
    score = lambda what, n: _join(f"{what}: ", level(c(n)), " (", c(n).cast("string"), "%)")
    capped = F.lit(None if scan else "(Capped by project scan not being performed - set PROJECT_SCAN_ROOT to improve this.)")
    lines = _lines("", score("Release-note retrieval", "retrieval"), score("API/operation identification", "identification"), score("Project scan", "project_scan"), "", _join("Overall Analysis Confidence: ", c("overall").cast("string"), "%"), capped)
    parts.append(_section(facts, key, 12, "ANALYSIS CONFIDENCE", [F.lit(1)], lines))
    parts.append(_section(facts, key, 13, "VERDICT", [F.lit(1)], _lines(verdict_head(c("overall_status"), bool(scan)))))
    # the titles of severe changes are lines of their own, between the verdict's head and its note
    severe = changes.where("baseline_severity = 'HIGH'").join(facts.select(*key, "overall_status"), key)
    severe = severe.where(((c("overall_status") == "CRITICAL") & (c("usage_status") == "SCANNED_CONFIRMED")) | ((c("overall_status") == "MEDIUM") & (c("usage_status") == "SCANNED_POTENTIAL")))
    parts.append(severe.select(*key, F.lit(13).alias("section"), F.lit(2).cast("long").alias("ord"), F.struct(*order).alias("at"), _join("  - ", c("title")).alias("text")))
    note = facts.where(F.size("dropped") > 0)
    parts.append(note.select(*key, F.lit(13).alias("section"), F.lit(3).cast("long").alias("ord"), _join("\n", verdict_note(c("dropped"))).alias("text")))
    return _all(parts)


def legacy_report(requests: DataFrame, key: list[str], merged: DataFrame, path: DataFrame, discrepancies: DataFrame, statuses: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """key, section, ord, text: the lines of the report that has all categories one after the other, changed or not.

    merged: key, category, version_ord, entry_ord, version, line (with its section), url. path: key, step, version, bump. statuses: key,
    version_ord, version, status, other_signal boolean (an advisory or a notice). usage: name, hits, rank, as build_changes takes."""
    c = F.col
    labels = F.create_map(*(F.lit(x) for kv in X.BUMP_LABELS.items() for x in kv))
    head = F.array_join(_lines(_join("Package: ", c("package"), " (", F.when(c("ecosystem") == "npm", "npm").otherwise("PyPI"), ")"), _join("Current Version: ", c("current_version")), _join("Target Version: ", c("target_version")), "", "Release Path"), "\n")
    parts = [requests.select(*key, F.lit(0).alias("section"), F.lit(0).cast("long").alias("ord"), head.alias("text"))]
    marks = F.when(c("status") == "unavailable", "  ⚠ Source unavailable after retries").when((c("status") != "notes") & ~c("other_signal"), "  ⚠ Unverified (no official source found)").otherwise("")
    steps = path.join(statuses.select(*key, "version", "status", "other_signal"), [*key, "version"], "left").fillna("no_notes", ["status"]).fillna(False, ["other_signal"])
    parts.append(steps.select(*key, F.lit(1).alias("section"), F.col("step").cast("long").alias("ord"), _join("  - ", c("version"), " [", F.element_at(labels, c("bump")), "]", marks).alias("text")))
    parts.append(requests.select(*key, F.lit(1).alias("section"), F.lit(2**40).alias("ord"), F.lit(f"\n{RULE}").alias("text")))
    text = _join("[", c("version"), " · ", F.element_at(labels, F.coalesce("bump", F.lit("patch"))), "] ", c("line"))
    sec = F.regexp_extract("line", r"\[Section: (.+?)\]", 1)
    rows = merged.join(path.select(*key, "version", "bump"), [*key, "version"], "left").withColumn("api", F.get(T.api_names(c("line")), F.lit(0)))
    none = F.lit(None).cast("array<struct<path:string,line:int,code:string,kind:string,detection_method:string,is_test:boolean>>")
    if usage is None:
        rows = rows.withColumns({"hits": none, "rank": F.lit(0)})
    else:
        rows = rows.join(usage.where("not is_attribute").select(F.col("name").alias("api"), "hits", "rank"), "api", "left")
    places = F.array_join(F.transform(F.slice(F.coalesce("hits", none, F.array()), 1, 3), lambda h: _join("\n      - ", h["path"], ":", h["line"].cast("string"), F.when(h["is_test"], " [test]").otherwise(" [production]"))), "")
    used = F.when(c("rank") == 2, _join("\n    Confirmed Usage: ", c("api"), places)).when(c("rank") == 1, _join("\n    Potential Usage: ", c("api"), "\n    Confidence: Low", places)).otherwise("")
    rows = rows.withColumn("text", _join(text, F.when(sec != "", _join("\n    Section: ", sec)).otherwise(""), used, F.when(F.coalesce("url", F.lit("")) != "", _join("\n    Source: ", c("url"))).otherwise("")))
    w = Window.partitionBy(*key, "category").orderBy("version_ord", "entry_ord")
    sections = F.create_map(*(F.lit(x) for i, cat in enumerate(X.CATEGORY_ORDER) for x in (cat, 2 + i)))
    rows = rows.select(*key, F.element_at(sections, c("category")).alias("section"), F.row_number().over(w).cast("long").alias("ord"), "text")
    cats = F.array(*(F.struct(F.lit(2 + i).alias("section"), F.lit(cat).alias("category")) for i, cat in enumerate(X.CATEGORY_ORDER)))
    grid = requests.select(*key, F.explode(cats).alias("s")).select(*key, "s.*")
    none_text = F.when(c("category") == "Security Updates", "No security-related changes were identified in the official release notes.").otherwise("(No changes found in this category)")
    grid = grid.join(rows.groupBy(*key, "section").agg(F.count("*").alias("n")), [*key, "section"], "left")
    head = _join("\n", c("category"), "\n", F.repeat(F.lit("-"), F.length("category")), F.when(c("n").isNull(), _join("\n", none_text)).otherwise(""))
    ends = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("ord"), head.alias("text")), F.struct(F.lit(2**40).alias("ord"), F.lit(f"\n{RULE}").alias("text"))))
    parts += [rows, grid.select(*key, "section", ends.alias("e")).select(*key, "section", "e.*")]
    title = "Source Discrepancies"
    heads = discrepancies.select(*key).distinct()
    parts.append(heads.select(*key, F.lit(20).alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(f"\n{title}\n{'-' * len(title)}\nTwo official sources disagreed for the same version - shown\nside by side rather than silently picking one:").alias("text")))
    cut = lambda t: T.strip(F.substring(t, 1, 300))
    pair = F.array_join(_lines("", _join("⚠ Source discrepancy detected for ", c("version"), ":"), _join("  ", c("first_source"), ":"), _join("    ", cut("first_text")), _join("    Source: ", c("first_url")), _join("  ", c("second_source"), ":"), _join("    ", cut("second_text")), _join("    Source: ", c("second_url"))), "\n")
    parts.append(discrepancies.select(*key, F.lit(20).alias("section"), (c("version_ord") + 1).cast("long").alias("ord"), pair.alias("text")))
    parts.append(heads.select(*key, F.lit(20).alias("section"), F.lit(2**40).alias("ord"), F.lit(f"\n{RULE}").alias("text")))
    for number, status, note in (
        (21, "unavailable", "\nNote: The following version(s) could not be checked because\nsources were unavailable after retries (e.g. a rate limit).\nRe-run later, or set a GITHUB_TOKEN, to check them:"),
        (22, "no_notes", "\nNote: No official release notes, changelog, or commit data\ncould be found for the following version(s). Treat these as\nunverified - check the project's release page manually:"),
    ):
        some = statuses.where(c("status") == status)
        parts.append(some.select(*key).distinct().select(*key, F.lit(number).alias("section"), F.lit(-1).cast("long").alias("ord"), F.lit(note).alias("text")))
        parts.append(some.select(*key, F.lit(number).alias("section"), c("version_ord").cast("long").alias("ord"), _join("  - ", c("version")).alias("text")))
    return _all(parts)
