"""Sections, paragraphs, entries, merging, sources, cache, usage, reports and streaming."""

import datetime as dt

from pyspark.sql import functions as F

from releaselode.operators import notes as N
from releaselode.operators import risk, sources, usage
from releaselode.plans import upgrade
from releaselode.sources import notes as landed
from releaselode.sources import registry, sinks
from releaselode.streaming import notes as stream

MARKDOWN = "# Changelog\n\n## 2.1.0 (2024-05-20)\n**Features**\n- Added support for x\n  on two lines\n- Fixed a crash in y\n\n## 2.0.10\n- ten\n## 2.0.1\n\n"
RST = "2.1.0 (2024)\n------------\n\n**Fixes**\n\n- Fixed a crash in z\n\n1.9.02\n------\n- other\n\n1.9.0\n-----\n- right\n"


def texts(spark, *ts):
    return N.exploded_lines(spark.createDataFrame(list(enumerate(ts)), "k int, text string"), ["k"])


def section(spark, text, version):
    cut = N.version_sections(texts(spark, text), ["k"])
    rows = N.sections_of(spark.createDataFrame([(0, version)], "k int, version string"), cut, ["k"]).collect()
    return rows[0].body if rows else None


def test_sections(spark):
    assert section(spark, MARKDOWN, "2.1.0").startswith("**Features**\n- Added support") and "ten" not in section(spark, MARKDOWN, "2.1.0")
    assert section(spark, MARKDOWN, "2.0.1") is None and section(spark, MARKDOWN, "2.0.10") == "- ten" and section(spark, MARKDOWN, "9.9") is None
    assert section(spark, RST, "1.9.0") == "- right" and section(spark, RST, "1.9.02") == "- other"
    assert section(spark, "## 1.9.0.1\n- dotted", "1.9.0") == "- dotted"


ENTRIES = {
    # "ten" alone is noise
    MARKDOWN: [(None, "Added support for x on two lines"), (None, "Fixed a crash in y")],
    "Bug Fixes\n- Fixed a crash in reader\n": [("Bug Fixes", "Fixed a crash in reader")],
    # a bare name already holds for the paragraph that it ends
    "Some words that are long\nBug Fixes\nOther words that are long": [("Bug Fixes", "Some words that are long"), ("Bug Fixes", "Other words that are long")],
    # a heading ends the block, so nothing of the next one is merged
    "First change of the module\nwas removed here\n\nCompatibility notes\n-------------------\nSecond thing entirely different\n": [(None, "First change of the module was removed here"), (None, "Second thing entirely different")],
    # lone lines of one block are one entry, a paragraph with a verb after its first line is its own
    "Alpha words go here\n\nBeta words go here\n\nGamma words go\nnow removed again": [(None, "Alpha words go here Beta words go here"), (None, "Gamma words go now removed again")],
    # of underline-like lines every other one is taken
    "Title of this\n=====\n=====\n-----\nBody words are here": [(None, "Body words are here")],
    "**Header**\n\n1. First point is made\n2. Second point is made": [(None, "First point is made"), (None, "Second point is made")],
}


def test_entries(spark):
    got = {i: [] for i in range(len(ENTRIES))}
    for r in N.entries(texts(spark, *ENTRIES), ["k"]).orderBy("k", "ord").collect():
        got[r.k].append((r.section, r.entry))
    assert dict(zip(ENTRIES, got.values(), strict=True)) == ENTRIES


def test_merging_keeps_the_first(spark):
    rows = [("r", "Bug Fixes", 1, 1, "Fixed a bug."), ("r", "Bug Fixes", 2, 1, "fixed A bug!"), ("r", "Other", 2, 1, "fixed a bug"), ("s", "Bug Fixes", 3, 1, "Fixed a bug")]
    df = spark.createDataFrame(rows, "req string, category string, v int, e int, line string")
    out = N.merged(df, ["req"], ["v", "e"], "line").orderBy("req", "category").collect()
    assert [(r.req, r.category, r.line) for r in out] == [("r", "Bug Fixes", "Fixed a bug."), ("r", "Other", "fixed a bug"), ("s", "Bug Fixes", "Fixed a bug")]


def test_model_answers(spark):
    df = spark.createDataFrame([(1, '```json\n[{"category": "Bug Fixes", "summary": " a "}, {"category": "X", "summary": "b"}, {"summary": ""}]\n```'), (2, "{}"), (3, "oops"), (4, None)], "k int, answer string")
    assert [(r.k, r.category, r.entry) for r in N.from_model(df, ["k"]).orderBy("ord").collect()] == [(1, "Bug Fixes", "a"), (1, "Other User-Impacting Changes", "b")]


def test_sources_and_cross_check(spark):
    rows = [("p", "1", 1, "known_adapter", "alpha beta gamma", False), ("p", "1", 2, "github_release", "one two three", False), ("p", "2", 2, "github_release", None, True), ("p", "2", 4, "commits", None, False), ("p", "3", 3, "changelog", None, True), ("p", "4", 2, "github_release", None, True), ("p", "4", 4, "commits", "- x", False)]
    df = spark.createDataFrame(rows, "package string, version string, prio int, kind string, notes_text string, had_error boolean")
    got = {r.version: r for r in sources.cross_check(df, ["package", "version"]).collect()}
    assert (got["1"].kind, got["1"].cross_text, got["1"].discrepancy) == ("known_adapter", "one two three", True)
    assert (got["2"].unavailable, got["3"].unavailable, got["4"].unavailable, got["4"].kind) == (True, False, False, "commits")


def test_cache(spark):
    now = dt.datetime(2024, 6, 1)
    ago = lambda **k: now - dt.timedelta(**k)
    rows = [("a", True, "n", ago(days=29)), ("b", True, "n", ago(days=31)), ("c", False, None, ago(hours=23)), ("d", False, None, ago(hours=25)), ("e", True, "old", ago(days=2)), ("e", True, "new", ago(days=1)), ("f", True, "n", ago(days=30))]
    cache = sources.cache_set(spark.createDataFrame(rows, "k string, found boolean, notes string, cached_at timestamp"), ["k"])
    asked = spark.createDataFrame([(x,) for x in "abcdefz"], "k string")
    got = {r.k: (r.state, r.notes) for r in sources.cache_get(asked, cache, ["k"], F.lit(now)).collect()}
    assert got == {"a": ("hit", "n"), "b": ("miss", None), "c": ("none", None), "d": ("miss", None), "e": ("hit", "new"), "f": ("hit", "n"), "z": ("miss", None)}


FILES = {
    "src/a.py": "import numpy as np\nnp.polydiv_old(x)\n",
    "src/b.py": "from numpy import polydiv_old as rs\nrs(x)\n",
    "src/c.py": "import numpy as np\nstack = np.polydiv_old\nstack(x)\n",
    "src/d.py": "# np.polydiv_old(x)\ns = 'np.polydiv_old(x)'\n",
    "tests/e.py": "from numpy import *\npolydiv_old(x)\npolydiv(y)\n",
    "a/.venv/f.py": "import numpy as np\nnp.polydiv_old(x)\n",
    "src/g.py": "arr.shape = (1, 2)\narr.size += 1\n",
    "src/h.py": "def broken(:\n",
    "src/i.ts": "np.polydiv_old(x)",
    "src/j.py": "import numpy\nnumpy.linalg.eig(x)\n",
}


def test_usage(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    facts = usage.usage_facts(files)
    apis = spark.createDataFrame([("numpy.polydiv_old",), ("numpy.polydiv",), ("numpy.linalg.eig",), ("pandas.x",)], "api string")
    hits = {(r.api, r.path): r for r in usage.api_usage(apis, facts).collect()}
    assert {k: (r.kind, r.line, r.is_test) for k, r in hits.items()} == {("numpy.polydiv_old", f"src/{x}.py"): ("confirmed", n, False) for x, n in (("a", 2), ("b", 2), ("c", 3))} | {("numpy.polydiv", "tests/e.py"): ("potential", 3, True)}
    assert hits["numpy.polydiv_old", "src/a.py"].code == "np.polydiv_old(x)"
    attributes = spark.createDataFrame([("shape",), ("size",), ("dtype",)], "attribute string")
    assert sorted((r.attribute, r.path, r.line) for r in usage.attribute_usage(attributes, facts).collect()) == [("shape", "src/g.py", 1), ("size", "src/g.py", 2)]
    assert usage.scan_summary(files).first().files_scanned == 9


def test_python_support(spark):
    rows = [("p", 2, "Supports Python versions 3.9 - 3.12."), ("p", 1, "Drops support for Python 3.7 and no longer supports Python 2.7"), ("p", 3, "removes support for python 3.7. Supports Python version 3.13"), ("q", 1, "nothing")]
    got = {r.k: (r.dropped, r.supported) for r in risk.python_support(spark.createDataFrame(rows, "k string, o int, text string"), ["k"], ["o"]).collect()}
    assert got == {"p": (["3.7", "2.7"], "3.9 - 3.12"), "q": ([], None)}


def test_registry(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"info": {"name": "p", "home_page": "https://github.com/h/p", "project_urls": {"Docs": "https://github.com/d/p"}}, "releases": {"1.0": [{"filename": "x"}], "2.0": [], "odd": [{"filename": "x"}]}}')
    (tmp_path / "n.json").write_text('{"name": "q", "repository": {"url": "git+https://github.com/o/q.git"}, "versions": {"1.0.0": {"version": "1.0.0", "deprecated": "use r"}, "x": {}}}')
    pypi, npm = registry.read_pypi(spark, str(tmp_path / "a.json")), registry.read_npm(spark, str(tmp_path / "n.json"))
    assert sorted((r.ecosystem, r.package, r.version) for r in registry.registry(pypi, npm).collect()) == [("npm", "q", "1.0.0"), ("pypi", "p", "1.0")]
    assert npm.select(registry.npm_repository(F.col("repository")).alias("r")).first().r == "o/q"
    assert registry.npm_deprecations(npm).first().text == "This version is marked deprecated by the maintainer: use r"
    urls = spark.createDataFrame([("p", [("Docs", "https://github.com/d/p"), ("Source Code", "https://github.com/s/p")], None), ("q", [], "https://github.com/h/q"), ("r", None, "https://x.y")], "package string, urls array<struct<key:string,url:string>>, home_page string")
    assert {r.package: r.repo for r in registry.pypi_repository(urls).collect()} == {"p": "s/p", "q": "h/q", "r": None}


def test_directive_blocks(spark):
    text = ".. changelog::\n    :version: 2.0.5\n    :released: May\n\n    .. change::\n        :tags: bug\n\n        Fixed a thing\n\n.. changelog::\n    :version: 2.0.4\n\n    .. change::\n        Old thing\n"
    files = spark.createDataFrame([("o/s", "main", "doc/build/changelog/changelog_20.rst", text)], "repo string, branch string, path string, text string")
    v = spark.createDataFrame([("o/s", "SQLAlchemy ", "2.0.5"), ("o/s", "sqlalchemy", "2.0.4"), ("o/s", "sqlalchemy", "2")], "repo string, package string, version string")
    got = {r.version: r.text for r in landed.adapter_notes(v, files).collect()}
    assert set(got) == {"2.0.5", "2.0.4"} and got["2.0.4"] == "Old thing" and "Fixed a thing" in got["2.0.5"] and ":tags:" not in got["2.0.5"]


def test_reports(spark, tmp_path):
    requests = spark.createDataFrame([("pypi", "p", "1.0", "1.2")], "ecosystem string, package string, current_version string, target_version string")
    releases = spark.createDataFrame([("pypi", "p", v) for v in ("1.0", "1.1", "1.2")], "ecosystem string, package string, version string")
    text = "- numpy.polydiv_old has been removed in favor of numpy.polydiv.\n- Fixed a crash in reader\n- Added support for arrays\nDrops support for Python 3.8 now"
    notes = spark.createDataFrame([("pypi", "p", "1.1", "CHANGELOG", text, "http://u", False)], "ecosystem string, package string, version string, kind string, notes_text string, url string, unavailable boolean")
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    report = upgrade.upgrade_reports(upgrade.Inputs(requests, releases, notes, files=files)).first().report
    for part in ("Release Type: MINOR", "Overall Risk: CRITICAL", "⚠ Python 3.8 is no longer supported.", "1. Change: numpy.polydiv_old removed", "Project Usage: CONFIRMED (3 location(s))", "File: src/a.py", "Impact: CRITICAL", "Replace with numpy.polydiv.", "## NEW FEATURES\n- Added support for arrays", "## BUG FIXES\n- Fixed a crash in reader", "⚠ 1.2: unverified", "UPGRADE BLOCKED"):
        assert part in report, part
    unscanned = upgrade.upgrade_reports(upgrade.Inputs(requests, releases, notes)).first().report
    assert "Status: NOT SCANNED" in unscanned and "Impact: UNKNOWN" in unscanned and "CONDITIONAL" in unscanned and "(Capped by project scan" in unscanned
    legacy = upgrade.upgrade_reports(upgrade.Inputs(requests, releases, notes), legacy=True)
    assert "[1.1 · MINOR] numpy.polydiv_old has been removed" in legacy.first().report and "1.2 [MINOR]  ⚠ Unverified" in legacy.first().report
    sinks.write_reports(legacy.select(F.lit(7).alias("request_id"), "report"), str(tmp_path / "r"))
    sinks.write_reports(legacy.select(F.lit(8).alias("request_id"), F.lit("x").alias("report")), str(tmp_path / "r"))
    assert sinks.read_report(spark, str(tmp_path / "r"), 7).first().report == legacy.first().report and sinks.read_report(spark, str(tmp_path / "r"), 9).count() == 0


def test_stream_keeps_the_cache(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    def land(n, rows):
        spark.createDataFrame(rows, stream.CANDIDATES).write.parquet(str(tmp_path / "in" / f"b{n}"))

    land(1, [("pypi", "p", "1", 2, "github_release", "first", False, at), ("pypi", "p", "2", 2, "github_release", None, True, at)])
    run = lambda: stream.keep_cache(spark.readStream.schema(stream.CANDIDATES).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), str(tmp_path / "cache"), str(tmp_path / "ck"), compact_every=1).awaitTermination()
    run()
    land(2, [("pypi", "p", "1", 4, "commits", "- lower priority", False, at + dt.timedelta(days=3)), ("pypi", "p", "1", 2, "github_release", "second", False, at + dt.timedelta(days=1)), ("pypi", "p", "2", 4, "commits", "- c", False, at)])
    run()
    assert sorted((r.version, r.notes) for r in stream.read_cache(spark, str(tmp_path / "cache")).collect()) == [("1", "second"), ("2", "- c")]
    land(3, [("pypi", "p", "1", 4, "commits", "- later, of lower priority", False, at + dt.timedelta(days=9)), ("pypi", "p", "2", 1, "known_adapter", "curated", False, at), ("pypi", "p", "3", 1, "known_adapter", None, False, at)])
    run()
    assert sorted((r.version, r.notes) for r in stream.read_cache(spark, str(tmp_path / "cache")).collect()) == [("1", "second"), ("2", "curated"), ("3", None)]
    assert len(list((tmp_path / "cache").glob("generation=*"))) <= 4
    counted = stream.busy_packages(stream.landed(spark, str(tmp_path / "in" / "*")))
    q = counted.writeStream.format("memory").queryName("busy").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(candidates) as n from busy").first().n == 8


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.py").write_bytes(b"\xff\xfe")
    got = {r.path: r.content for r in landed.read_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "x = 1\n", "src/b.py": None}
