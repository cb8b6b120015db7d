"""Whole reports, line by line, and what requests without a report are told."""

from releaselode.plans import upgrade

REQUESTS = [("npm", "grid", "1.0", "1.2"), ("npm", "grid", "0.1", "1.2"), ("npm", "grid", "1.2", "1.0"), ("npm", "grid", "1.0", "9"), ("npm", "grid", "1.2", "1.3rc1"), ("npm", "grid", "1.2", "2.0"), ("npm", "grid", "2.0", "2.1")]
NOTES = {
    "1.1": """New Features

- Added support for {i} placeholders in titles
- Added support for sparse masks

Expired Deprecations

- numpy.polydiv_old was removed in favor of numpy.polydiv. (gh-812)

Bug Fixes

- Solves a crash in tile
""",
    "1.2": "- Solves a crash in tile\n- Setting the strides attribute is deprecated. As an alternative, np.moveaxis is there.\n- numpy.load behavior change. Previously, it kept the file open. Now, it closes the file.\n- Drops support for Python 3.8\n- Wheels require another msvc runtime",
}
FILES = [("src/a.py", "import numpy as np\nx = f'{i}' + str(np.polydiv_old(1))\n"), ("tests/test_b.py", "import numpy as np\nv.strides = (1, 2)\nnp.polydiv_old(2)\n"), ("src/c.py", "w.strides = 3\n")]


def inputs(spark, scanned):
    key = "ecosystem string, package string"
    requests = spark.createDataFrame(REQUESTS, f"{key}, current_version string, target_version string")
    releases = spark.createDataFrame([("npm", "grid", v) for v in ("1.0", "1.1", "1.2", "1.3rc1", "2.0", "2.1")], f"{key}, version string")
    rows = [("npm", "grid", v, "CHANGELOG (CHANGES.md)", t, f"http://n/{v}", False, "entirely other words" if v == "1.1" else None, "http://r/1.1", v == "1.1") for v, t in NOTES.items()]
    rows += [("npm", "grid", "2.0", None, None, None, True, None, None, False)]
    notes = spark.createDataFrame(rows, f"{key}, version string, kind string, notes_text string, url string, unavailable boolean, cross_text string, cross_url string, discrepancy boolean")
    advisories = spark.createDataFrame([(i, f"G{i}", s, "high", f"http://g/{i}", [("npm", "GRID", "< 1.2")]) for i, s in ((0, "Zip bombs"), (1, "An open door"), (2, "zip bombs!"))], "advisory long, ghsa_id string, summary string, severity string, html_url string, vulnerabilities array<struct<ecosystem:string,name:string,range:string>>")
    notices = spark.createDataFrame([("grid", "1.2", "This version is marked deprecated by the maintainer: use mesh", "http://m/1.2")], "package string, version string, text string, url string")
    return upgrade.Inputs(requests, releases, notes, advisories, notices, spark.createDataFrame(FILES, "path string, content string") if scanned else None)


SUMMARY = """============================================================
## UPGRADE SUMMARY
Package: grid
From: 1.0
To: 1.2
Release Type: MINOR
Overall Risk: CRITICAL
Python Compatibility:
⚠ Python 3.8 is no longer supported.
Project Scan:
Status: SCANNED (project)
Files scanned: 3
⚠ 1 confirmed affected API(s)/operation(s)
⚠ 1 potential affected API(s)/operation(s)
⚠ 2 affected production file(s)
⚠ 1 affected test file(s)
============================================================
## BREAKING / MIGRATION IMPACT
1. Change: numpy.polydiv_old removed
   Type: REMOVAL
   Affected API/Operation: numpy.polydiv_old
   Replacement: numpy.polydiv
   Project Usage: CONFIRMED (2 location(s))
     File: src/a.py
     Line: 2 [production]
     Code: np.polydiv_old(1)
     Detection: ast_attribute_call
     File: tests/test_b.py
     Line: 3 [test]
     Code: np.polydiv_old(2)
     Detection: ast_attribute_call
   Confidence: HIGH
   Impact: CRITICAL
   Recommendation: Replace with numpy.polydiv.
   Source: http://n/1.1
   Source Excerpt: "numpy.polydiv_old was removed in favor of numpy.polydiv. (gh-812)"
============================================================
## DEPRECATIONS
1. Change: strides attribute assignment (deprecated)
   Affected API/Operation: strides attribute assignment
   Replacement: numpy.moveaxis
   Confidence: MEDIUM
   Recommendation: Migrate to numpy.moveaxis before this is removed in a future release.
   Source: http://n/1.2
2. Change: This version is marked deprecated by the maintainer: use mesh (deprecated)
   Affected API/Operation: This version is marked deprecated by the maintainer: use mesh
   Replacement: mesh
   Confidence: MEDIUM
   Recommendation: Migrate to mesh before this is removed in a future release.
   Source: http://m/1.2
============================================================
## COMPATIBILITY CHANGES
1. Change: numpy.load behavior changed
   Affected API/Operation: numpy.load
   Old Behavior: it kept the file open
   New Behavior: it closes the file
   Confidence: HIGH
   Impact: LOW
   Recommendation: Review any code relying on the previous behavior, and test after upgrading.
   Source: http://n/1.2
============================================================
## SECURITY
1. [HIGH] Zip bombs
   Recommendation: Upgrade promptly; this addresses a security issue.
   Source: http://g/0
2. [HIGH] An open door
   Recommendation: Upgrade promptly; this addresses a security issue.
   Source: http://g/1
============================================================
## NEW FEATURES
- Added support for {i} placeholders in titles
- Added support for sparse masks
============================================================
## SOURCE DISCREPANCIES
⚠ Sources disagree for 1.1:
  CHANGELOG (CHANGES.md): New Features

- Added support for {i} placeholders in titles
- Added support for sparse masks

Expired Deprecations

- numpy.polydiv_old was removed in favor of numpy.polydiv. (gh-812)

Bug Fixes

- S
  GitHub Release Notes: entirely other words
============================================================
## CODE SCAN SUMMARY
Scanned project: project
Files scanned: 3
Files skipped: 0
Confirmed affected APIs: 1
Potential affected APIs: 1
Affected production files: 2
Affected test files: 1
============================================================
## ANALYSIS CONFIDENCE

Release-note retrieval: HIGH (100%)
API/operation identification: HIGH (100%)
Project scan: HIGH (100%)

Overall Analysis Confidence: 100%
============================================================
## VERDICT
✗ UPGRADE BLOCKED / MIGRATION REQUIRED

Confirmed usage of APIs or behaviors affected by the target
release was detected:
  - numpy.polydiv_old removed

Note: this release drops support for Python 3.8. Verify your runtime."""

LEGACY = """Package: grid (npm)
Current Version: 1.0
Target Version: 1.2

Release Path
  - 1.1 [MINOR]
  - 1.2 [MINOR]

============================================================

Breaking Changes
----------------
(No changes found in this category)

============================================================

Security Updates
----------------
[1.1 · MINOR] [HIGH] Zip bombs
    Source: http://g/0
[1.1 · MINOR] [HIGH] An open door
    Source: http://g/1

============================================================

Expired Deprecations
--------------------
[1.1 · MINOR] numpy.polydiv_old was removed in favor of numpy.polydiv. (gh-812) [Section: Expired Deprecations]
    Section: Expired Deprecations
    Source: http://n/1.1

============================================================

New Deprecations
----------------
[1.2 · MINOR] Setting the strides attribute is deprecated. As an alternative, np.moveaxis is there.
    Source: http://n/1.2

============================================================

Compatibility Changes
---------------------
[1.2 · MINOR] numpy.load behavior change. Previously, it kept the file open. Now, it closes the file.
    Source: http://n/1.2

============================================================

Build / Toolchain Changes
-------------------------
(No changes found in this category)

============================================================

New Features
------------
[1.1 · MINOR] Added support for {i} placeholders in titles [Section: New Features]
    Section: New Features
    Source: http://n/1.1
[1.1 · MINOR] Added support for sparse masks [Section: New Features]
    Section: New Features
    Source: http://n/1.1

============================================================

Bug Fixes
---------
(No changes found in this category)

============================================================

Performance Improvements
------------------------
(No changes found in this category)

============================================================

Database / ORM Changes
----------------------
(No changes found in this category)

============================================================

API Changes
-----------
(No changes found in this category)

============================================================

Deprecations
------------
[1.2 · MINOR] This version is marked deprecated by the maintainer: use mesh
    Source: http://m/1.2

============================================================

Other User-Impacting Changes
----------------------------
[1.1 · MINOR] Solves a crash in tile [Section: Bug Fixes]
    Section: Bug Fixes
    Source: http://n/1.1
[1.2 · MINOR] Solves a crash in tile
    Source: http://n/1.2
[1.2 · MINOR] Drops support for Python 3.8
    Source: http://n/1.2

============================================================

Source Discrepancies
--------------------
Two official sources disagreed for the same version - shown
side by side rather than silently picking one:

⚠ Source discrepancy detected for 1.1:
  CHANGELOG (CHANGES.md):
    New Features

- Added support for {i} placeholders in titles
- Added support for sparse masks

Expired Deprecations

- numpy.polydiv_old was removed in favor of numpy.polydiv. (gh-812)

Bug Fixes

- Solves a crash in tile
    Source: http://n/1.1
  GitHub Release Notes:
    entirely other words
    Source: http://r/1.1

============================================================"""

#: Of the summary without a scan, the lines that differ.
UNSCANNED = [
    '-Overall Risk: CRITICAL',
    '+Overall Risk: UNKNOWN',
    '-Status: SCANNED (project)',
    '-Files scanned: 3',
    '-⚠ 1 confirmed affected API(s)/operation(s)',
    '-⚠ 1 potential affected API(s)/operation(s)',
    '-⚠ 2 affected production file(s)',
    '-⚠ 1 affected test file(s)',
    '+Status: NOT SCANNED',
    "+Set PROJECT_SCAN_ROOT to your project's path to determine actual exposure.",
    '-   Project Usage: CONFIRMED (2 location(s))',
    '-     File: src/a.py',
    '-     Line: 2 [production]',
    '-     Code: np.polydiv_old(1)',
    '-     Detection: ast_attribute_call',
    '-     File: tests/test_b.py',
    '-     Line: 3 [test]',
    '-     Code: np.polydiv_old(2)',
    '-     Detection: ast_attribute_call',
    '+   Project Usage: NOT SCANNED',
    '-   Impact: CRITICAL',
    '+   Impact: UNKNOWN',
    '-   Impact: LOW',
    '+   Impact: UNKNOWN',
    '-## CODE SCAN SUMMARY',
    '-Scanned project: project',
    '-Files scanned: 3',
    '-Files skipped: 0',
    '-Confirmed affected APIs: 1',
    '-Potential affected APIs: 1',
    '-Affected production files: 2',
    '-Affected test files: 1',
    '-============================================================',
    '-Project scan: HIGH (100%)',
    '+Project scan: LOW (0%)',
    '-Overall Analysis Confidence: 100%',
    '+Overall Analysis Confidence: 67%',
    '+(Capped by project scan not being performed - set PROJECT_SCAN_ROOT to improve this.)',
    '-✗ UPGRADE BLOCKED / MIGRATION REQUIRED',
    '+⚠ CONDITIONAL — PROJECT SCAN REQUIRED',
    '-Confirmed usage of APIs or behaviors affected by the target',
    '-release was detected:',
    '-  - numpy.polydiv_old removed',
    '+The release contains potentially breaking changes, but',
    '+project-level exposure could not be determined.',
    "+Set PROJECT_SCAN_ROOT to your project's path and re-run.",
]


def only(df):
    return {(r.current_version, r.target_version): (r.status, r.report) for r in df.collect()}


def test_summary_is_whole(spark):
    got = only(upgrade.upgrade_reports(inputs(spark, True)))
    assert got["1.0", "1.2"] == ("ok", SUMMARY)


def test_legacy_is_whole(spark):
    got = only(upgrade.upgrade_reports(inputs(spark, False), legacy=True))
    assert got["1.0", "1.2"] == ("ok", LEGACY)


def test_summary_without_a_scan(spark):
    import difflib

    got = only(upgrade.upgrade_reports(inputs(spark, False)))["1.0", "1.2"][1]
    found = difflib.unified_diff(SUMMARY.split("\n"), got.split("\n"), lineterm="", n=0)
    assert [x for x in found if not x.startswith(("---", "+++", "@@"))] == UNSCANNED


def test_every_request_has_a_row(spark):
    got = only(upgrade.upgrade_reports(inputs(spark, True)))
    assert {k: s for k, (s, _) in got.items()} == {
        ("1.0", "1.2"): "ok", ("0.1", "1.2"): "current_not_found", ("1.2", "1.0"): "not_newer", ("1.0", "9"): "target_not_found",
        ("1.2", "1.3rc1"): "no_versions", ("1.2", "2.0"): "unavailable", ("2.0", "2.1"): "nothing_found",
    }
    assert all(text == upgrade.MESSAGES[s] for s, text in got.values() if s != "ok")


def test_hits_are_counted_but_three_are_kept(spark):
    files = spark.createDataFrame([(f"src/m{i:02}.py", "import numpy as np\nnp.polydiv_old(1)\nq.strides = 1\n") for i in range(30)], "path string, content string")
    lines = spark.createDataFrame([("numpy.polydiv_old was removed. [Section: X]",), ("Setting the strides attribute is deprecated.",)], "line string")
    used, places = upgrade.usage_of(lines, files)
    assert sorted((r.name, r.n_hits, [h.path for h in r.hits]) for r in used.collect()) == [(n, 30, ["src/m00.py", "src/m01.py", "src/m02.py"]) for n in ("numpy.polydiv_old", "strides")]
    assert places.count() == 60


def test_notes_from_landed_sources(spark):
    versions = spark.createDataFrame([("pypi", "o/flask", "flask", "1.1", "1.0"), ("pypi", "o/flask", "flask", "1.2", "1.1"), ("pypi", "o/q", "q", "3.0", "2.0"), ("pypi", "o/q", "q", "4.0", "3.0")], "ecosystem string, repo string, package string, version string, previous string")
    raw = spark.createDataFrame([("o/flask", "main", "CHANGES.rst", "## 1.1\n- Added a door\n## 1.0\n- old")], "repo string, branch string, path string, text string")
    posts = spark.createDataFrame([("o/flask", "v1.1", "wholly other prose here"), ("o/flask", "1.2", "posted")], "repo string, tag string, body string")
    compares = spark.createDataFrame([("o/q", "v2.0", "v3.0", ["first\nmore", "second"])], "repo string, old_tag string, new_tag string, messages array<string>")
    got = {(r.package, r.version): r for r in upgrade.resolved_notes(versions, upgrade.Landed(raw, posts, None, compares)).collect()}
    one = got["flask", "1.1"]
    assert (one.kind, one.notes_text, one.cross_text, one.cross_url, one.discrepancy) == ("Flask Official Changelog", "- Added a door", "wholly other prose here", "https://github.com/o/flask/releases/tag/v1.1", True)
    assert (got["flask", "1.2"].notes_text, got["q", "3.0"].notes_text, got["q", "4.0"].notes_text) == ("posted", "- first\n- second", None)
    assert upgrade.resolved_notes(versions, upgrade.Landed()).where("notes_text is null and not discrepancy").count() == 4


def test_no_task_holds_the_lines_of_a_report(spark):
    """Lines are sorted and appended; a report longer than a part goes on in the next row, and nothing of it is lost."""
    from pyspark.sql import functions as F
    from releaselode.operators import report

    rows = [("a", s, o, f"{s}/{o} " + "⚠" * 40) for s in range(9, -1, -1) for o in range(50)] + [("a", 3, 7, None), ("b", 0, 1, ""), ("b", 0, 0, "x"), ("c", 0, 0, None), (None, 0, 0, "z")]
    df = spark.createDataFrame(rows, "k string, section int, ord long, text string")
    whole = "\n".join(x for _, _, _, x in sorted(r for r in rows if r[0] == "a" and r[3] is not None))
    few = {"b": [(0, "x\n")], "c": [(0, None)], None: [(0, "z")]}
    for size in (1000, 10**6):
        made = report.put_together(df, ["k"], size)
        got = {}
        for r in made.orderBy("part").collect():
            got.setdefault(r.k, []).append((r.part, r.report))
        texts = [x for _, x in got["a"]]
        assert "\n".join(texts) == whole and [n for n, _ in got["a"]] == list(range(len(texts)))
        assert (len(texts) == 1) == (size > len(whole.encode())) and all(len(x.encode()) <= size for x in texts)
        assert {k: v for k, v in got.items() if k != "a"} == few
    # verdicts list titles as lines, in the order of their changes
    assert "collect_list" not in report.put_together(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    at = df.where("k = 'b'").withColumn("at", F.struct(-F.length("text"))).withColumn("ord", F.lit(1))
    assert [r.report for r in report.put_together(at, ["k"]).collect()] == ["x\n"]
