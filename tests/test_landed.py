"""From landed sources to notes and statuses: two registries, the log of attempts, the cache in front of the sources."""

import datetime as dt
import json

from pyspark.sql import functions as F

from releaselode.operators import upgrades
from releaselode.plans import upgrade
from releaselode.sources import attempts, landing

VERSIONS = "ecosystem string, repo string, package string, version string, previous string"
POSTS = "repo string, tag string, body string"


def test_one_name_in_two_registries(spark):
    versions = spark.createDataFrame([("pypi", "o/py", "x", "1.1", "1.0"), ("npm", "o/js", "x", "1.1", "0.9")], VERSIONS)
    posts = spark.createDataFrame([("o/py", "v1.1", "python notes"), ("o/js", "1.1", "javascript notes")], POSTS)
    got = upgrade.resolved_notes(versions, upgrade.Landed(posts=posts)).collect()
    assert sorted((r.ecosystem, r.notes_text, r.url) for r in got) == [("npm", "javascript notes", "https://github.com/o/js/releases/tag/1.1"), ("pypi", "python notes", "https://github.com/o/py/releases/tag/v1.1")]


def test_one_repository_for_both_registries(spark):
    """The text is read once for both; commits go by each registry's own previous version."""
    versions = spark.createDataFrame([("pypi", "o/m", "x", "1.1", "1.0"), ("npm", "o/m", "x", "1.1", "0.9"), ("pypi", "o/m", "x", "1.2", "1.1"), ("npm", "o/m", "x", "1.2", "1.1")] * 2, VERSIONS)
    posts = spark.createDataFrame([("o/m", "1.2", "of both")], POSTS)
    compares = spark.createDataFrame([("o/m", "v1.0", "v1.1", ["from one"]), ("o/m", "0.9", "1.1", ["from nine"])], "repo string, old_tag string, new_tag string, messages array<string>")
    got = upgrade.resolved_notes(versions, upgrade.Landed(posts=posts, compares=compares)).collect()
    assert sorted((r.ecosystem, r.version, r.notes_text) for r in got) == [("npm", "1.1", "- from nine"), ("npm", "1.2", "of both"), ("pypi", "1.1", "- from one"), ("pypi", "1.2", "of both")]


def test_version_order_counts_each_registry_by_itself(spark):
    rows = [("pypi", "x", "1.0"), ("npm", "x", "1.1"), ("pypi", "x", "1.2"), ("npm", "x", "1.0")]
    got = upgrades.version_order(spark.createDataFrame(rows, "ecosystem string, package string, version string")).collect()
    assert sorted((r.ecosystem, r.version, r.ord) for r in got) == [("npm", "1.0", 1), ("npm", "1.1", 2), ("pypi", "1.0", 1), ("pypi", "1.2", 2)]


def log(spark, rows):
    return spark.createDataFrame(rows, attempts.SCHEMA)


def test_outcomes_of_attempts(spark):
    def tries(request, *states):
        return [("release", "o/r", request, i, s, b) for i, (s, b) in enumerate(states, 1)]

    gone = (None, None)
    rows = [
        *tries("answered", gone, (200, "{}"), (404, None)), *tries("never", gone, gone, gone, (200, "{}")), *tries("once", gone), *tries("limited", (403, "API Rate Limit exceeded"), (200, "{}")),
        *tries("forbidden", (403, "no")), *tries("forbidden_null", (403, None)), *tries("broken", (500, "x"), (200, "{}")), *tries("third", gone, gone, (200, "late")),
    ]
    got = {r.request: (r.state, r.attempts, r.body) for r in attempts.outcomes(log(spark, rows + rows), ["repo", "request"]).collect()}
    assert got == {
        "answered": ("ok", 2, "{}"), "never": ("network", 3, None), "once": ("network", 1, None), "limited": ("rate_limit", 1, None), "forbidden": ("missing", 1, None),
        "forbidden_null": ("missing", 1, None), "broken": ("missing", 1, None), "third": ("ok", 3, "late"),
    }
    assert attempts.outcomes(log(spark, []), ["repo", "request"]).count() == 0


def release(tag, *states, repo="o/r"):
    return [("release", repo, tag, i, s, json.dumps(b) if isinstance(b, dict) else b) for i, (s, b) in enumerate(states, 1)]


def compare(pair, *states, repo="o/r"):
    return [("compare", repo, pair, i, s, json.dumps({"commits": [{"commit": {"message": m}} for m in b]}) if isinstance(b, list) else b) for i, (s, b) in enumerate(states, 1)]


LIMIT = (403, "API rate limit exceeded")
LOG = [
    # 1.1: a failure at the first tag ends the search, though a later one has notes; commits are tried and found
    *release("1.1", LIMIT), *release("v1.1", (200, {"body": "never seen"})), *compare("v1.0...v1.1", (404, "")), *compare("v1.0...1.1", (200, ["Found\nmore", " "])),
    # 1.2: notes come before a failure
    *release("1.2", (404, None)), *release("v1.2", (200, {"body": " Posted ", "html_url": "http://h"})), *release("V1.2", LIMIT),
    # 1.3: both fail; 1.4: one fails, the other is empty; 1.5: nothing is there; 1.6: broken answers are no failures
    *release("1.3", (None, None), (None, None), (None, None)), *compare("v1.2...v1.3", LIMIT),
    *release("1.4", (200, {"body": None})), *release("v1.4", (None, None)), *compare("v1.3...v1.4", (200, [])),
    *release("1.5", (404, None)), *compare("v1.4...v1.5", (404, None)),
    *release("1.6", (200, "no json")), *compare("v1.5...v1.6", (200, "no json")),
]


def inputs(spark, now, cache=None):
    numbers = [f"1.{i}" for i in range(7)]
    versions = spark.createDataFrame([("pypi", "o/r", "p", b, a) for a, b in zip(numbers, numbers[1:])], VERSIONS)
    return upgrade.resolved_notes(versions, upgrade.Landed(responses=log(spark, LOG)), cache, now)


def test_failures_reach_the_notes(spark):
    got = {r.version: (r.kind, r.notes_text, r.url, r.had_error, r.unavailable) for r in inputs(spark, None).collect()}
    assert got == {
        "1.1": ("GitHub Commits", "- Found", "https://github.com/o/r/compare/v1.0...1.1", True, False), "1.2": ("GitHub Release Notes", "Posted", "http://h", False, False),
        "1.3": (None, None, None, True, True), "1.4": (None, None, None, True, True), "1.5": (None, None, None, False, False), "1.6": (None, None, None, False, False),
    }


def test_every_status_from_landed_rows(spark):
    requests = [("pypi", "p", "1.0", "1.2"), ("pypi", "p", "1.2", "1.4"), ("pypi", "p", "1.4", "1.6"), ("pypi", "p", "1.2", "1.5"), ("pypi", "p", "9", "1.2"), ("pypi", "p", "1.0", "9"), ("pypi", "p", "1.2", "1.1"), ("pypi", "p", "1.0", "1.0rc1"), ("pypi", "q", "1.0", "1.1"), ("pypi", " ", "1", "2"), ("pypi", "p", None, "2"), ("pypi", "r", "1.0", "1.1rc1")]
    releases = [("pypi", "p", f"1.{i}") for i in range(7)] + [("pypi", "q", "1.0"), ("pypi", "q", "1.1"), ("pypi", "r", "1.0"), ("pypi", "r", "1.1rc1")]
    i = upgrade.Inputs(
        spark.createDataFrame(requests, "ecosystem string, package string, current_version string, target_version string"), spark.createDataFrame(releases, "ecosystem string, package string, version string"), inputs(spark, None),
        packages=spark.createDataFrame([("pypi", "p", "o/r"), ("pypi", "q", None), ("pypi", "r", None)], "ecosystem string, package string, repo string"),
    )
    got = {(r.package, r.current_version, r.target_version): (r.status, r.report) for r in upgrade.upgrade_reports(i).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        ("p", "1.0", "1.2"): "ok", ("p", "1.2", "1.4"): "unavailable", ("p", "1.4", "1.6"): "nothing_found", ("p", "1.2", "1.5"): "nothing_found", ("p", "9", "1.2"): "current_not_found", ("p", "1.0", "9"): "target_not_found",
        ("p", "1.2", "1.1"): "not_newer", ("p", "1.0", "1.0rc1"): "target_not_found", ("q", "1.0", "1.1"): "no_repository", (" ", "1", "2"): "blank_input", ("p", None, "2"): "blank_input", ("r", "1.0", "1.1rc1"): "no_versions",
    }
    assert all(r for _, r in got.values())


NOW = dt.datetime(2024, 5, 1, 12)
CACHE = "ecosystem string, package string, version string, found boolean, notes string, origin string, url string, cached_at timestamp"


def test_cache_stands_before_the_sources(spark):
    day = dt.timedelta(days=1)
    cache = spark.createDataFrame([
        ("pypi", "p", "1.1", True, "known", "Its log", "http://c", NOW - 29 * day), ("pypi", "p", "1.2", True, "too old", "Its log", "http://c", NOW - 31 * day), ("pypi", "p", "1.3", False, None, None, None, NOW - day / 2),
        ("pypi", "p", "1.4", False, None, None, None, NOW - 2 * day), ("npm", "p", "1.5", True, "other registry", "x", "y", NOW),
    ], CACHE)
    out = inputs(spark, F.lit(NOW), cache)
    got = {r.version: (r.state, r.kind, r.notes_text, r.url, r.unavailable) for r in out.collect()}
    assert got == {
        "1.1": ("hit", "Its log", "known", "http://c", False), "1.2": ("miss", "GitHub Release Notes", "Posted", "http://h", False), "1.3": ("none", None, None, None, False),
        "1.4": ("miss", None, None, None, True), "1.5": ("miss", None, None, None, False), "1.6": ("miss", None, None, None, False),
    }
    back = {r.version: (r.found, r.notes, r.origin) for r in upgrade.cache_entries(out, F.lit(NOW)).collect()}
    assert back == {"1.2": (True, "Posted", "GitHub Release Notes"), "1.5": (False, None, None), "1.6": (False, None, None)}


def rows_read(df):
    """Rows that the scans of files gave, by the plan that ran."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("Scan parquet"):
            out += p.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_hits_never_read_their_files(spark, tmp_path):
    """Of 400 repositories three aren't known yet: only their folders are read."""
    texts = spark.range(400).select(F.concat(F.lit("o/r"), "id").alias("repo"), F.lit("main").alias("branch"), F.lit("CHANGELOG.md").alias("path"), F.concat(F.lit("## 1.1\n- Notes of "), "id").alias("text"))
    landing.land(texts, str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    versions = spark.range(400).select(F.lit("pypi").alias("ecosystem"), F.concat(F.lit("o/r"), "id").alias("repo"), F.concat(F.lit("p"), "id").alias("package"), F.lit("1.1").alias("version"), F.lit("1.0").alias("previous"))
    known = versions.where("repo not in ('o/r5', 'o/r77', 'o/r300')").select("ecosystem", "package", "version", F.lit(True).alias("found"), F.lit("cached").alias("notes"), F.lit("c").alias("origin"), F.lit("u").alias("url"), F.lit(NOW).alias("cached_at"))
    got = upgrade.resolved_notes(versions, upgrade.Landed(files=files), known, F.lit(NOW))
    assert sorted(r.notes_text for r in got.where("state = 'miss'").collect()) == ["- Notes of 300", "- Notes of 5", "- Notes of 77"]
    assert got.where("state = 'hit' and notes_text = 'cached'").count() == 397
    repos = spark.createDataFrame([("o/r5",), ("o/r77",), ("o/r300",), (None,)], "repo string")
    some = landing.of_repositories(files, repos)
    assert some.count() == 3 and rows_read(some) < 40 < rows_read(files.where("text is not null"))
    assert landing.of_repositories(files, repos.where("false")).count() == 0


def test_npm_notices_come_with_the_notes(spark):
    versions = spark.createDataFrame([("npm", "o/r", "p", "1.1", "1.0"), ("pypi", "o/r", "p", "1.1", "1.0"), ("npm", None, "q", "1.1", "1.0")], VERSIONS)
    notices = spark.createDataFrame([("p", "1.1", "use another", "http://n"), ("q", "1.1", "gone", "http://n")], "package string, version string, text string, url string")
    out = upgrade.resolved_notes(versions, upgrade.Landed(notices=notices))
    assert sorted((r.ecosystem, r.package, r.notice_text, r.has_repo) for r in out.collect()) == [("npm", "p", "use another", True), ("npm", "q", None, False), ("pypi", "p", None, True)]
    assert [(r.package, r.text) for r in upgrade.notices_of(out).collect()] == [("p", "use another")]


def test_an_advisory_without_severity_keeps_its_summary(spark):
    i = upgrade.Inputs(
        spark.createDataFrame([("pypi", "p", "1.0", "1.1")], "ecosystem string, package string, current_version string, target_version string"), spark.createDataFrame([("pypi", "p", "1.0"), ("pypi", "p", "1.1")], "ecosystem string, package string, version string"),
        spark.createDataFrame([], "ecosystem string, package string, version string, kind string, notes_text string, url string, unavailable boolean"),
        spark.createDataFrame([("G-1", "Paths are not checked", None, "http://a", [("pip", "p", "< 2")])], "ghsa_id string, summary string, severity string, html_url string, vulnerabilities array<struct<ecosystem:string,name:string,range:string>>"),
    )
    assert "Paths are not checked" in upgrade.upgrade_reports(i).first().report
