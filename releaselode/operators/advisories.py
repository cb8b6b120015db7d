"""Which advisories hold for which releases.

The versions of a package and the bounds of its advisories are ranked together once, so a range (all of whose conditions must hold) is
an interval of ranks. An interval is the union of at most two nodes a level of the binary tree over the ranks; a version lies in one node of each
level. So versions and advisories meet by equality on package and node, and only where the advisory holds: no pair is tested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import GHSA_ECOSYSTEMS
from ..functions.versions import conditions, version_key

_PACKAGE = ["_eco", "_name"]


def nodes(low: Column, high: Column, levels: Column) -> Column:
    """array<struct<level, node>>: node n of level k stands for the numbers from n * 2^k on, 2^k of them; together low to high, each once."""

    def at(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k).cast("long")
        a, z = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        node = lambda n: F.struct(k.alias("level"), n.alias("node"))
        return F.filter(F.array(F.when((a < z) & (a % 2 == 1), node(a)), F.when((a < z) & (z % 2 == 1), node(z - 1))), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), levels), at))


def _ranked(keys: DataFrame) -> DataFrame:
    """_PACKAGE, _key, _rank from 0, _levels: once for each key of a package."""
    w = Window.partitionBy(*_PACKAGE)
    ranked = keys.where("_key is not null").distinct().withColumn("_rank", (F.row_number().over(w.orderBy("_key")) - 1).cast("long"))
    return ranked.withColumn("_levels", F.ceil(F.log2(F.count("*").over(w) + 1)).cast("int"))


def intervals(flat: DataFrame, ranked: DataFrame, key: list[str]) -> DataFrame:
    """key, _PACKAGE, _levels, low, high of flat (with `_conditions`): those whose conditions can all hold. A range without a condition, or
    with one whose bound is no version, holds for nothing."""
    each = flat.select(*key, *_PACKAGE, F.explode("_conditions").alias("c")).select(*key, *_PACKAGE, "c.op", F.col("c.bound").alias("_key"))
    met = each.join(ranked, [*_PACKAGE, "_key"], "left")
    op, r = F.col("op"), F.col("_rank")
    low = F.when(op == ">", r + 1).when(op.isin("<", "<="), F.lit(0)).otherwise(r)
    high = F.when(op == "<", r - 1).when(op.isin(">", ">="), F.lit(2**40)).otherwise(r)
    out = met.groupBy(*key, *_PACKAGE).agg(F.max(low).alias("low"), F.min(high).alias("high"), F.bool_and(r.isNotNull()).alias("known"), F.max("_levels").alias("_levels"))
    # the tree's last number closes an open interval
    return out.where("known").withColumn("high", F.least("high", F.pow(F.lit(2.0), F.col("_levels")).cast("long") - 1)).where("low <= high").drop("known")


def advisory_matches(versions: DataFrame, advisories: DataFrame) -> DataFrame:
    """versions' columns with advisory long, ghsa_id, summary, severity, advisory_url: once for each version and advisory.

    advisories: one row each, with vulnerabilities array<struct<ecosystem, name, range>> and maybe `advisory`, its place in the list;
    else the order of the rows counts. Ranges are parsed once each."""
    flat = advisories.withColumn("advisory", F.monotonically_increasing_id() if "advisory" not in advisories.columns else F.col("advisory"))
    flat = flat.select("advisory", "ghsa_id", "summary", "severity", F.col("html_url").alias("advisory_url"), F.posexplode("vulnerabilities").alias("_i", "v"))
    flat = flat.select("*", F.col("v.ecosystem").alias("_eco"), F.lower("v.name").alias("_name"), conditions(F.col("v.range")).alias("_conditions")).drop("v")
    eco = F.create_map(*(F.lit(x) for kv in GHSA_ECOSYSTEMS.items() for x in kv))
    keys = versions.columns
    left = versions.withColumns({"_eco": F.try_element_at(eco, F.col("ecosystem")), "_name": F.lower("package"), "_key": version_key(F.col("version"))})
    bounds = flat.select(*_PACKAGE, F.explode("_conditions.bound").alias("_key"))
    ranked = _ranked(left.select(*_PACKAGE, "_key").union(bounds))
    told = ["advisory", "ghsa_id", "summary", "severity", "advisory_url", "_i"]
    at = [*_PACKAGE, "_level", "_node"]
    right = intervals(flat, ranked, told).withColumn("n", F.explode(nodes(F.col("low"), F.col("high"), F.col("_levels"))))
    right = right.select(*told[:-1], *_PACKAGE, F.col("n.level").alias("_level"), F.col("n.node").alias("_node"))
    placed = left.join(ranked, [*_PACKAGE, "_key"]).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_levels"))))
    placed = placed.withColumn("_node", F.floor(F.col("_rank") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    hits = placed.select(*keys, *at).join(right, at)
    return hits.groupBy(*keys, "advisory").agg(*(F.first(c).alias(c) for c in ("ghsa_id", "summary", "severity", "advisory_url")))
