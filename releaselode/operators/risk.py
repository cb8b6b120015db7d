"""Changes with their subjects, usage and risk, and what they add up to for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..session import stored
from .usage import usage_status


def build_changes(merged: DataFrame, usage: DataFrame | None = None, line: str = "line") -> DataFrame:
    """Rows of the seven risk categories with all derived fields. A section at the end of the line isn't part of them.

    usage: name, is_attribute, rank (2 confirmed, 1 potential), n_hits, hits (the first three); None where no project was scanned."""
    df = merged.where(F.col("category").isin(X.RISK_CATEGORIES)).withColumn("cat_ord", F.array_position(F.lit(X.RISK_CATEGORIES), F.col("category")).cast("int"))
    df = df.withColumn("source_excerpt", T.strip_section(F.col(line))["text"]).withColumn("change_type", T.change_type(F.col("category"), F.col("source_excerpt")))
    df = df.withColumn("subject", T.change_subject(F.col("source_excerpt")))
    df = df.withColumns({"affected_api": F.col("subject.api"), "affected_operation": F.col("subject.operation"), "replacement_api": F.col("subject.replacement"), "extraction_confidence": F.col("subject.confidence"), "attribute": F.col("subject.attribute")}).drop("subject")
    if usage is None:
        df = df.withColumns({"rank": F.lit(None).cast("int"), "n_hits": F.lit(None).cast("long"), "hits": F.lit(None).cast("array<struct<path:string,line:int,code:string,kind:string,detection_method:string,is_test:boolean>>")})
    else:
        # changes without a name meet nothing, but nulls would all go to one task; no name begins with a space
        nameless = F.concat(F.lit(" "), F.pmod(F.xxhash64(line), F.lit(4096)).cast("string"))
        df = df.withColumns({"_name": F.coalesce("affected_api", "attribute", nameless), "_attr": F.col("affected_api").isNull()})
        u = usage.select(F.col("name").alias("_name"), F.col("is_attribute").alias("_attr"), "rank", "n_hits", "hits")
        df = df.join(u, ["_name", "_attr"], "left").drop("_name", "_attr")
    df = df.withColumn("usage_status", usage_status(F.col("rank"), F.lit(usage is not None)))
    df = df.withColumn("baseline_severity", T.severity(F.col("change_type")))
    c = F.col
    return df.withColumns({
        "risk": T.risk(c("baseline_severity"), c("usage_status")),
        "old_behavior": T.behaviour(c("source_excerpt"), c("change_type"), 1),
        "new_behavior": T.behaviour(c("source_excerpt"), c("change_type"), 2),
        "title": T.change_title(c("affected_api"), c("affected_operation"), c("change_type"), c("category")),
        "recommendation": T.recommendation(c("change_type"), c("affected_api"), c("affected_operation"), c("replacement_api")),
    })


def status_of(scanned: bool) -> Column:
    """Aggregate over a request's changes."""
    high = F.col("baseline_severity") == "HIGH"
    any_of = lambda s: F.coalesce(F.bool_or(high & (F.col("usage_status") == s)), F.lit(False))
    if not scanned:
        return F.when(F.coalesce(F.bool_or(high), F.lit(False)), "UNKNOWN").otherwise("LOW")
    return F.when(any_of("SCANNED_CONFIRMED"), "CRITICAL").when(any_of("SCANNED_POTENTIAL"), "MEDIUM").otherwise("LOW")


def overall_status(changes: DataFrame, key: list[str], scanned: bool) -> DataFrame:
    return changes.groupBy(*key).agg(status_of(scanned).alias("overall_status"))


def percent(part: Column, whole: Column) -> Column:
    """Rounded half to even; 100 of nothing."""
    return F.when(whole > 0, F.bround(100.0 * part / whole, 0)).otherwise(100).cast("int")


def level(score: Column) -> Column:
    return F.when(score >= 85, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")


def confidence(versions: DataFrame, changes: DataFrame, key: list[str], scanned: bool) -> DataFrame:
    """retrieval, identification, project_scan, overall int. versions: key, status (notes, unavailable, no_notes)."""
    a = versions.groupBy(*key).agg(percent(F.count_if(F.col("status") == "notes"), F.count("*")).alias("retrieval"))
    counted = F.col("baseline_severity") != "INFO"
    b = changes.groupBy(*key).agg(percent(F.count_if(counted & F.col("extraction_confidence").isin("HIGH", "MEDIUM")), F.count_if(counted)).alias("identification"))
    out = a.join(b, key, "left").withColumn("identification", F.coalesce("identification", F.lit(100))).withColumn("project_scan", F.lit(100 if scanned else 0))
    return out.withColumn("overall", F.bround((F.col("retrieval") + F.col("identification") + F.col("project_scan")) / 3.0, 0).cast("int"))


def affected_counts(changes: DataFrame, key: list[str], places: DataFrame | None = None) -> DataFrame:
    """confirmed_apis, potential_apis, production_files, test_files long: distinct names and files.

    places: name, is_attribute, path, is_test, once for each file that uses a name; None where no project was scanned."""
    # what changes say is made distinct and written once; both counts, and the files, come from these few rows
    seen = stored(changes.select(*key, F.coalesce("affected_api", "affected_operation").alias("called"), F.coalesce("affected_api", "attribute").alias("name"), F.col("affected_api").isNull().alias("is_attribute"), "usage_status").distinct(), "affected")
    called = seen.select(*key, "called", "usage_status").distinct()
    count = lambda s: F.count_if((F.col("usage_status") == s) & F.col("called").isNotNull())
    named = called.groupBy(*key).agg(count("SCANNED_CONFIRMED").alias("confirmed_apis"), count("SCANNED_POTENTIAL").alias("potential_apis"))
    if places is None:
        return named.withColumns({"production_files": F.lit(0).cast("long"), "test_files": F.lit(0).cast("long")})
    asked = seen.where("name is not null").select(*key, "name", "is_attribute").distinct()
    files = asked.join(places, ["name", "is_attribute"]).select(*key, "path", "is_test").distinct()
    counts = files.groupBy(*key).agg(F.count_if(~F.col("is_test")).alias("production_files"), F.count_if(F.col("is_test")).alias("test_files"))
    return named.join(counts, key, "left").fillna(0, ["production_files", "test_files"])


def python_support(texts: DataFrame, key: list[str], order: list[str], text: str = "text") -> DataFrame:
    """key, dropped array<string>, supported string: versions in the order of their first mention; the first span named."""
    ord_ = F.struct(*order)
    drops = texts.select(*key, ord_.alias("o"), F.posexplode(F.regexp_extract_all(text, F.lit(f"(?i){X.PYTHON_DROPPED}"), F.lit(1))).alias("i", "v"))
    drops = drops.groupBy(*key, "v").agg(F.min(F.struct("o", "i")).alias("at")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("dropped"))
    span = F.regexp_replace(F.regexp_extract(text, f"(?i){X.PYTHON_SUPPORTED}", 1), r"[. ]+$", "")
    named = texts.where(F.col(text).rlike(f"(?i){X.PYTHON_SUPPORTED}")).groupBy(*key).agg(F.min_by(span, ord_).alias("supported"))
    out = texts.select(*key).distinct().join(drops, key, "left").join(named, key, "left")
    return out.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))


_VERDICTS = {
    "UNKNOWN": ["⚠ CONDITIONAL — PROJECT SCAN REQUIRED", "", "The release contains potentially breaking changes, but", "project-level exposure could not be determined.", "Set PROJECT_SCAN_ROOT to your project's path and re-run."],
    "CRITICAL": ["✗ UPGRADE BLOCKED / MIGRATION REQUIRED", "", "Confirmed usage of APIs or behaviors affected by the target", "release was detected:"],
    "MEDIUM": ["⚠ UPGRADE WITH CAUTION", "", "Potential affected usage was detected. Review the listed", "files before upgrading:"],
}


def verdict_head(status: Column, scanned: bool) -> Column:
    """The closing text before the titles of severe changes, which follow where the status is CRITICAL (confirmed) or MEDIUM (potential)."""
    found = "No confirmed usage of the identified breaking APIs was found." if scanned else "No breaking, removed, or security-relevant changes were identified."
    low = F.lit("\n".join(["✓ LOW RISK — NO DIRECT IMPACT DETECTED", "", found, "Environment and build requirements should still be verified."]))
    return F.when(status == "UNKNOWN", "\n".join(_VERDICTS["UNKNOWN"])).when(status == "CRITICAL", "\n".join(_VERDICTS["CRITICAL"])).when(status == "MEDIUM", "\n".join(_VERDICTS["MEDIUM"])).otherwise(low)


def verdict_note(dropped: Column) -> Column:
    return F.concat(F.lit("Note: this release drops support for Python "), F.array_join(dropped, ", "), F.lit(". Verify your runtime."))


def verdict(status: Column, confirmed: Column, potential: Column, scanned: bool, dropped: Column) -> Column:
    """The closing text. confirmed, potential: titles of severe changes; dropped: Python versions."""
    listed = lambda titles: F.array_join(F.transform(titles, lambda t: F.concat(F.lit("\n  - "), t)), "")
    titles = F.when(status == "CRITICAL", listed(confirmed)).when(status == "MEDIUM", listed(potential)).otherwise("")
    return F.concat(verdict_head(status, scanned), titles, F.when(F.size(dropped) > 0, F.concat(F.lit("\n\n"), verdict_note(dropped))).otherwise(""))
