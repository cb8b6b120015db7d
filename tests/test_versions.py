import random

from pyspark.sql import functions as F

from releaselode.functions import versions as V
from releaselode.operators import advisories, upgrades

POOL = ["1.0", "1.0.0", "1.0.1", "1.10", "1.9", "1.0a1", "1.0b2", "1.0rc1", "1.0.dev3", "1.0a1.dev2", "1.0.post1", "1.0-2", "1!0.5", "2.0+local.1", "2.0+local.10", "2.0+abc", "2.0", "v3.1", "1.0c1", "1.0.post1.dev4", "0.0", "0", "1." + "8" * 25, "1." + "8" * 24 + "9", "20240101123456789012345678.1", "1.0.post" + "3" * 30, "1!" + "0" * 30 + "5", "2.0+" + "4" * 22]


def test_order_is_pep_440(spark):
    from packaging.version import parse

    df = spark.createDataFrame([(v,) for v in [*POOL, "nonsense", "1..2", ""]], "v string").withColumn("k", V.version_key(F.col("v")))
    assert {r.v for r in df.where("k is null").collect()} == {"nonsense", "1..2", ""}
    rows = [r.v for r in df.where("k is not null").orderBy("k", "v").collect()]
    assert [parse(v) for v in rows] == sorted(map(parse, POOL))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.k") == F.col("b.k")).select("a.v", F.col("b.v").alias("w")).where("v < w").collect()
    assert {(r.v, r.w) for r in pairs} == {(a, b) for a in POOL for b in POOL if a < b and parse(a) == parse(b)}
    got = {r.v: r.p for r in df.where("k is not null").select("v", V.is_prerelease(F.col("k")).alias("p")).collect()}
    assert got == {v: parse(v).is_prerelease for v in POOL}


def test_bumps(spark):
    rows = [("3.4", "3.4.9", "patch"), ("0.17.2", "0.18", "minor"), ("7.9", "8", "major"), ("0.17.2", "0.18.0.dev5", "prerelease"), ("6", "6.0.0", "patch"), ("1." + "9" * 30, "1.1" + "0" * 30, "minor")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    got = df.select(V.classify_bump(V.version_key(F.col("a")), V.version_key(F.col("b"))).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_ranges(spark):
    rows = [("3.5.1", ">= 3.2, < 4", True), ("4.0", ">= 3.2, < 4", False), ("0.9.3", "= 0.9.3", True), ("0.9.3", "every release there is", False), ("6.1", "", False), ("bad", "> 1", False), ("6.1", "== 6.1.0", True), ("6.1", "!= 6.1", True), ("6.1", "< x.y", False), ("6.1", None, False), ("2." + "7" * 25, "> 2." + "7" * 24, True)]
    df = spark.createDataFrame(rows, "v string, r string, want boolean")
    assert all(r.x == r.want for r in df.select(V.in_range(V.version_key(F.col("v")), F.col("r")).alias("x"), "want").collect())


def path(spark, current, target, pre=False, versions=("0.4", "0.5a2", "0.5rc1", "0.5", "0.6.3")):
    releases = spark.createDataFrame([("pypi", "p", v) for v in versions], "ecosystem string, package string, version string")
    requests = spark.createDataFrame([("pypi", "p", current, target)], "ecosystem string, package string, current_version string, target_version string")
    status = upgrades.request_status(requests, upgrades.releases(releases)).first().status
    return status, [r.version for r in upgrades.upgrade_path(requests, releases, pre).orderBy("step").collect()]


def test_paths(spark):
    assert path(spark, "0.4", "0.6.3") == ("ok", ["0.5", "0.6.3"])
    assert path(spark, "0.4", "0.6.3", True) == ("ok", ["0.5a2", "0.5rc1", "0.5", "0.6.3"])
    assert path(spark, "9.9", "0.6.3") == ("current_not_found", [])
    assert path(spark, "0.4", "9.9") == ("target_not_found", [])
    assert path(spark, "0.6.3", "0.4") == ("not_newer", [])
    versions = [f"1.{i}" for i in range(12)]
    random.Random(1).shuffle(versions)
    assert path(spark, "1.2", "1.11", versions=versions)[1] == [f"1.{i}" for i in range(3, 12)]


def test_advisories_match_once(spark):
    a = spark.createDataFrame([("G1", " s", "high", "u", [("pip", "PKG", "< 2"), ("pip", "pkg", "< 3")]), ("G2", "t", "low", "v", [("npm", "pkg", "< 2")]), ("G3", "t", "low", "v", None)], "ghsa_id string, summary string, severity string, html_url string, vulnerabilities array<struct<ecosystem:string,name:string,range:string>>")
    v = spark.createDataFrame([("pypi", "pkg", "1.0"), ("pypi", "pkg", "2.5"), ("pypi", "pkg", "3.0")], "ecosystem string, package string, version string")
    assert sorted((r.version, r.ghsa_id) for r in advisories.advisory_matches(v, a).collect()) == [("1.0", "G1"), ("2.5", "G1")]
