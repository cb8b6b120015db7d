"""Advisories by intervals of ranks, and versions as bytes that sort as they do."""

import random

import pytest
from packaging.version import Version
from pyspark.sql import functions as F

from releaselode.functions import versions as V
from releaselode.operators import advisories as A
from releaselode.operators import upgrades

from test_landed import rows_read


def number(rng):
    return str(rng.choice([0, 1, 2, 9, 10, 11, 99, 100, rng.randint(0, 10**6), rng.randint(0, 10**40), 10**rng.randint(0, 300)]))


def drawn(rng):
    out = ".".join(number(rng) if rng.random() < 0.3 else str(rng.randint(0, 3)) for _ in range(rng.randint(1, 4)))
    out = (f"{rng.randint(0, 2)}!" if rng.random() < 0.1 else "") + out
    for p, text in ((0.3, rng.choice(["a", "b", "rc"]) + number(rng)), (0.2, ".post" + number(rng)), (0.2, ".dev" + number(rng)), (0.2, "+" + rng.choice(["a", "ab", "1", "12", "a.1", "a.b", "1.a", "x0"]))):
        if rng.random() < p:
            out += text
    return out


def test_bytes_sort_as_versions_do(spark):
    rng = random.Random(1)
    some = list({drawn(rng) for _ in range(10_000)}) + ["1", "1.0", "1.0.0", "1.0.0.0"]
    df = spark.createDataFrame([(v,) for v in [*some, "no version", None]], "v string").select("v", V.version_bytes(V.version_key(F.col("v"))).alias("b"))
    got = {r.v: r.b for r in df.collect()}
    assert got.pop("no version") is None and got.pop(None) is None
    pairs = sorted(((bytes(b), v) for v, b in got.items()))
    for (a, v), (b, w) in zip(pairs, pairs[1:], strict=False):
        assert (a == b) == (Version(v) == Version(w)) and Version(v) <= Version(w), (v, w)


def test_nodes_cover_an_interval_once(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randint(0, 70), rng.randint(7, 9)) for a in (rng.randint(0, 57) for _ in range(300))] + [(0, 127, 7), (0, 0, 0), (5, 5, 3)]
    for r in spark.createDataFrame(rows, "low long, high long, levels int").select("low", "high", A.nodes(F.col("low"), F.col("high"), F.col("levels")).alias("n")).collect():
        covered = sorted(x for n in r.n for x in range(n.node << n.level, (n.node + 1) << n.level))
        assert covered == list(range(r.low, r.high + 1)) and len(r.n) <= 2 * 9


RANGES = ["< 2", "<= 2.0", "> 1", ">= 1.0.0", "= 1.5", "= 1.50", ">= 1, < 1.5", "> 1, <= 1.5rc1", "all", None, "< odd", ">= 1, < odd", ">= 2, < 1", "< 0.1", "> 9", "< 1.0.post1", ">= 1.0, < 2, < 1.7, > 1.2"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    versions = [(e, p, f"{rng.randint(0, 2)}.{rng.randint(0, 9)}{rng.choice(['', '', 'rc1', '.post1', '.0'])}") for e in ("pypi", "npm") for p in ("P", "q", "r") for _ in range(40)]
    versions += [("pypi", "P", "1.5"), ("pypi", "P", "1.50"), ("pypi", "P", "odd"), ("pypi", None, "1"), (None, "q", "1"), ("other", "q", "1")]
    listed = [(f"G{i}", f"s{i}", "high", "u", [(rng.choice(["pip", "npm"]), rng.choice(["p", "Q", "R", "none"]), rng.choice(RANGES)) for _ in range(rng.randint(0, 3))]) for i in range(150)]
    v = spark.createDataFrame(sorted(set(versions), key=repr), "ecosystem string, package string, version string")
    return v, spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "advisory long, ghsa_id string, summary string, severity string, html_url string, vulnerabilities array<struct<ecosystem:string,name:string,range:string>>")


def test_intervals_give_what_testing_every_pair_gives(tables):
    versions, listed = tables
    got = A.advisory_matches(versions, listed).select("ecosystem", "package", "version", "ghsa_id").collect()
    eco = F.create_map(F.lit("pip"), F.lit("pypi"), F.lit("npm"), F.lit("npm"))
    flat = listed.select("ghsa_id", F.explode("vulnerabilities").alias("v"))
    every = versions.crossJoin(flat).where((F.col("ecosystem") == eco[F.col("v.ecosystem")]) & (F.lower("package") == F.lower("v.name")) & V.in_range(V.version_key(F.col("version")), F.col("v.range")))
    true = every.select("ecosystem", "package", "version", "ghsa_id").distinct().collect()
    assert len(got) == len(true) > 500 and set(map(tuple, got)) == set(map(tuple, true))


def test_no_versions_or_advisories(tables):
    versions, listed = tables
    assert A.advisory_matches(versions.where("false"), listed).count() == A.advisory_matches(versions, listed.where("false")).count() == 0


def test_only_pairs_that_hold_meet(spark):
    """A package with 2,000 versions and 500 narrow advisories: a million pairs, of which 1,500 hold."""
    versions = spark.range(2000).select(F.lit("pypi").alias("ecosystem"), F.lit("p").alias("package"), F.concat(F.lit("1."), "id").alias("version"))
    at = F.col("id") * 4
    hole = F.concat(F.lit(">= 1."), at.cast("string"), F.lit(", < 1."), (at + 3).cast("string"))
    listed = spark.range(500).select(F.col("id").alias("advisory"), F.lit("g").alias("ghsa_id"), F.lit("s").alias("summary"), F.lit("low").alias("severity"), F.lit("u").alias("html_url"), F.array(F.struct(F.lit("pip").alias("ecosystem"), F.lit("p").alias("name"), hole.alias("range"))).alias("vulnerabilities"))
    df = A.advisory_matches(versions, listed)
    assert len(df.collect()) == 1500
    joined = joins(df)
    assert max(joined) <= 40_000, joined  # versions by levels, bounds and hits; never versions times advisories


def joins(df):
    """Rows that each join of the plan that ran gave."""
    plan, out, todo = df._jdf.queryExecution().executedPlan(), [], []
    todo.append(plan)
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_path_is_a_range_of_the_files(spark, tmp_path):
    releases = spark.range(60_000).select(F.lit("pypi").alias("ecosystem"), F.concat(F.lit("p"), F.col("id") % 3).alias("package"), F.concat(F.lit("1."), F.floor(F.col("id") / 3), F.when(F.col("id") % 5 == 0, "rc1").otherwise("")).alias("version"))
    upgrades.land_releases(releases, str(tmp_path / "r"))
    request = ("pypi", "p1", "1.0", "1.30")
    asked = spark.createDataFrame([request], "ecosystem string, package string, current_version string, target_version string")
    for prereleases in (False, True):
        landed = upgrades.landed_path(spark, str(tmp_path / "r"), *request, prereleases)
        true = upgrades.upgrade_path(asked, releases, prereleases).select("version", "step")
        assert sorted(map(tuple, landed.collect())) == sorted(map(tuple, true.collect())) and landed.count() > 20
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    landed = upgrades.landed_path(spark, str(tmp_path / "r"), *request)
    plan = landed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(order" in plan and "LessThanOrEqual(order" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert rows_read(landed) < 30_000
    for bad in (("pypi", "p1", "1.30", "1.0"), ("pypi", "p1", "9", "1.0"), ("npm", "p1", "1.0", "1.30")):
        assert upgrades.landed_path(spark, str(tmp_path / "r"), *bad).count() == 0
