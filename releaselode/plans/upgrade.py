"""From upgrade requests to reports, for all requests of a table in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import notes as N
from ..operators import report, risk, usage
from ..operators.advisories import advisory_matches
from ..operators.sources import PRIORITY, cache_get, cross_check, note_status
from ..operators.upgrades import releases, request_status, upgrade_path
from ..session import stored
from ..sources import attempts, landing
from ..sources import notes as sources

KEY = ["ecosystem", "package", "current_version", "target_version"]


@dataclass
class Inputs:
    """requests: KEY. releases: ecosystem, package, version. notes: ecosystem, package, version, kind, notes_text, url, unavailable and,
    where two sources were compared, cross_text, cross_url, discrepancy. advisories and notices (package, version, text, url)
    and files (path, content) of a project may be None. packages: ecosystem, package, repo; where it is given, requests of packages
    without a repository are told so."""

    requests: DataFrame
    releases: DataFrame
    notes: DataFrame
    advisories: DataFrame | None = None
    notices: DataFrame | None = None
    files: DataFrame | None = None
    answers: DataFrame | None = None
    scan_root: str = "project"
    prereleases: bool = False
    packages: DataFrame | None = None


def merged_lines(steps: DataFrame, i: Inputs, fold: str = "New Deprecations") -> DataFrame:
    """KEY, category, version_ord, entry_ord, version, line, url: notes, then notices, then advisories, merged. Notices go to `fold`.

    A version whose model answer is an array takes its categories from it, all others from keywords."""
    at = [*KEY, "version", F.col("step").alias("version_ord")]
    texts = steps.join(i.notes.where("notes_text is not null"), ["ecosystem", "package", "version"]).select(*at, "notes_text", "url")
    pv = ["ecosystem", "package", "version"]
    distinct = texts.select(*pv, "notes_text").dropDuplicates(pv)
    if i.answers is not None:
        answers = i.answers.where(N.has_answer(F.col("answer")))
        answered = N.from_model(answers, pv).select(*pv, "ord", "category", F.col("entry").alias("line"))
        distinct = distinct.join(answers.select(*pv), pv, "left_anti")
    found = N.categorized(N.entries(N.exploded_lines(distinct, pv, "notes_text"), pv)).select(*pv, "ord", "category", F.col("labelled").alias("line"))
    if i.answers is not None:
        found = found.unionByName(answered)
    rows = texts.drop("notes_text").join(found, pv).select(*KEY, "category", F.lit(0).alias("src_ord"), "version_ord", F.col("ord").alias("entry_ord"), "version", "line", "url")
    if i.notices is not None:
        more = steps.join(i.notices, ["package", "version"]).where("ecosystem = 'npm'")
        rows = rows.unionByName(more.select(*KEY, F.lit(fold).alias("category"), F.lit(1).alias("src_ord"), F.col("step").alias("version_ord"), F.lit(1).cast("long").alias("entry_ord"), "version", F.col("text").alias("line"), "url"))
    if i.advisories is not None:
        # advisories keep the order of their list
        hits = advisory_matches(steps.select(*KEY, "version", "step"), i.advisories)
        line = F.concat(F.lit("["), F.upper(F.coalesce("severity", F.lit("unknown"))), F.lit("] "), F.coalesce("summary", F.lit("")))
        rows = rows.unionByName(hits.select(*KEY, F.lit("Security Updates").alias("category"), F.lit(2).alias("src_ord"), F.col("step").alias("version_ord"), F.col("advisory").cast("long").alias("entry_ord"), "version", F.trim(line).alias("line"), F.col("advisory_url").alias("url")))
    out = N.merged(rows, KEY, ["src_ord", "version_ord", "entry_ord"], "line")
    # later sources come after all notes of a category
    return out.withColumn("version_ord", F.col("src_ord") * 1_000_000 + F.col("version_ord")).drop("src_ord", "dedup_key")


def usage_of(merged: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all names in the lines: (name, is_attribute, rank, n_hits, hits) with the first three hits, and (name, is_attribute, path, is_test) once for each file.

    Each file is parsed once. However many hits a name has, a row holds three."""
    facts = stored(usage.usage_facts(files), "usage-facts")
    clean = merged.select(T.strip_section(F.col("line"))["text"].alias("line"))
    names = clean.select(F.explode(T.api_names(F.col("line"))).alias("api")).distinct()
    attributes = clean.select(T.attribute_name(F.col("line")).alias("attribute")).where("attribute is not null").distinct()
    columns = ["name", "is_attribute", "path", "line", "code", "kind", "detection_method", "is_test"]
    a = usage.api_usage(names, facts).withColumns({"name": F.col("api"), "is_attribute": F.lit(False)}).select(*columns)
    b = usage.attribute_usage(attributes, facts).withColumns({"name": F.col("attribute"), "is_attribute": F.lit(True)}).select(*columns)
    hits = stored(a.union(b), "usage-hits")
    at = ["name", "is_attribute"]
    counts = hits.groupBy(*at).agg(F.max(F.when(F.col("kind") == "confirmed", 2).otherwise(1)).alias("rank"), F.count("*").alias("n_hits"))
    rest = [c for c in columns if c not in at]
    top = hits.withColumn("rn", F.row_number().over(Window.partitionBy(*at).orderBy(*rest))).where("rn <= 3")
    three = top.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("hits"))
    return counts.join(three, at), hits.select(*at, "path", "is_test").distinct()


def statuses(steps: DataFrame, i: Inputs) -> DataFrame:
    """KEY, version_ord, version, status of every step."""
    got = steps.join(i.notes, ["ecosystem", "package", "version"], "left")
    return got.select(*KEY, F.col("step").alias("version_ord"), "version", F.when(F.coalesce("unavailable", F.lit(False)) | F.col("notes_text").isNotNull(), note_status()).otherwise("no_notes").alias("status"))


def discrepancies(steps: DataFrame, i: Inputs) -> DataFrame:
    if "discrepancy" not in i.notes.columns:
        return steps.limit(0).select(*KEY, F.col("step").alias("version_ord"), "version", *(F.lit("").alias(c) for c in ("first_source", "first_text", "first_url", "second_source", "second_text", "second_url")))
    got = steps.join(i.notes.where("discrepancy and cross_text is not null"), ["ecosystem", "package", "version"])
    second_url = F.col("cross_url") if "cross_url" in i.notes.columns else F.lit("")
    return got.select(*KEY, F.col("step").alias("version_ord"), "version", F.col("kind").alias("first_source"), F.col("notes_text").alias("first_text"), F.col("url").alias("first_url"), F.lit("GitHub Release Notes").alias("second_source"), F.col("cross_text").alias("second_text"), second_url.alias("second_url"))


#: What a request without a report is told.
MESSAGES = {
    "blank_input": "The package, the current version and the target version are all needed.",
    "no_repository": "No repository is known for this package, so there is no place to look for release notes or a changelog.",
    "current_not_found": "The current version is not among the releases of this package.",
    "target_not_found": "The target version is not among the releases of this package.",
    "not_newer": "The target version is not newer than the current version.",
    "no_versions": "No release lies between the two versions; prereleases may have been left out.",
    "unavailable": "The sources of every version in between were unavailable; try again later.",
    "nothing_found": "No release notes, changelog or commits were found for any version in between.",
}


def _asked_notes(steps: DataFrame, i: Inputs) -> Inputs:
    """Only the notes of versions that are asked for, written once: lines, statuses, discrepancies and Python support all read them."""
    pv = ["ecosystem", "package", "version"]
    texts = i.notes.withColumns({c: F.col(c).cast("string") for c, kind in i.notes.dtypes if kind == "void"})
    return replace(i, notes=stored(texts.join(steps.select(*pv).distinct(), pv, "left_semi"), "notes"))


def upgrade_reports(i: Inputs, legacy: bool = False) -> DataFrame:
    """KEY, status, part, report: one row for each request. status: ok, or why there is no report; then report is a message.

    A report of more than report.PART bytes is cut between lines into rows with part 0, 1 and so on."""
    steps = stored(upgrade_path(i.requests, i.releases, i.prereleases), "steps")
    i = _asked_notes(steps, i)
    lines = stored(merged_lines(steps, i, "Deprecations" if legacy else "New Deprecations"), "lines")
    status = stored(statuses(steps, i), "statuses")
    seen = status.groupBy(*KEY).agg(F.bool_or(F.col("status") == "notes").alias("notes"), F.bool_and(F.col("status") == "unavailable").alias("all_unavailable"))
    signals = lines.where("version_ord >= 1000000").select(*KEY).distinct().withColumn("signal", F.lit(True))
    asked = request_status(i.requests.select(*KEY).distinct(), releases(i.releases)).select(*KEY, "status").join(seen, KEY, "left").join(signals, KEY, "left")
    told = F.coalesce("notes", F.lit(False)) | F.coalesce("signal", F.lit(False))
    blank = reduce(lambda a, b: a | b, (F.trim(F.coalesce(c, F.lit(""))) == "" for c in KEY[1:]))
    homeless = F.lit(False)
    if i.packages is not None:
        homes = i.packages.groupBy("ecosystem", "package").agg(F.max("repo").alias("repo"))
        asked, homeless = asked.join(homes, ["ecosystem", "package"], "left"), F.col("repo").isNull()
    why = F.when(blank, "blank_input").when(F.col("status") != "ok", F.col("status")).when(F.col("notes").isNull(), "no_versions").when(homeless, "no_repository").when(~told & F.col("all_unavailable"), "unavailable").when(~told, "nothing_found").otherwise("ok")
    asked = stored(asked.select(*KEY, why.alias("status")), "request-status")
    return finished(asked, _report_lines(i, asked.where("status = 'ok'").select(*KEY), steps, lines, status, legacy))


def finished(asked: DataFrame, lines: DataFrame) -> DataFrame:
    """KEY, status, part, report of asked (KEY, status): the lines (section, ord, text) of requests that are ok, a message for all others.

    Status and message go with the lines, so whole reports are not joined."""
    message = F.try_element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), F.col("status"))
    first = asked.select(*KEY, "status", F.lit(-1).alias("section"), F.lit(0).cast("long").alias("ord"), message.alias("text"))
    return report.put_together(first.unionByName(lines.withColumn("status", F.lit("ok")), allowMissingColumns=True), [*KEY, "status"])


def _report_lines(i: Inputs, requests: DataFrame, steps: DataFrame, lines: DataFrame, status: DataFrame, legacy: bool) -> DataFrame:
    """KEY, section, ord, text of requests that are ok."""
    steps, lines, status = (x.join(requests, KEY, "left_semi") for x in (steps, lines, status))
    used, places = usage_of(lines, i.files) if i.files is not None else (None, None)
    differ = discrepancies(steps, i)
    if legacy:
        signals = lines.where("version_ord >= 1000000").select(*KEY, "version").distinct().withColumn("other_signal", F.lit(True))
        status = status.join(signals, [*KEY, "version"], "left").fillna(False, ["other_signal"])
        return report.legacy_report(requests, KEY, lines, steps, differ, status, used)
    changes = stored(risk.build_changes(lines, used), "changes")
    scanned = i.files is not None
    texts = steps.join(i.notes.where("notes_text is not null"), ["ecosystem", "package", "version"]).select(*KEY, "step", F.col("notes_text").alias("text"))
    overall = risk.overall_status(changes, KEY, scanned)
    counts = risk.affected_counts(changes, KEY, places)
    sure = risk.confidence(status, changes, KEY, scanned)
    python = risk.python_support(texts, KEY, ["step"])
    facts = requests.join(overall, KEY, "left").join(counts, KEY, "left").join(sure, KEY, "left").join(python, KEY, "left").fillna("LOW", ["overall_status"]).fillna(0, ["confirmed_apis", "potential_apis", "production_files", "test_files"])
    facts = facts.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))
    bumps = steps.groupBy(*KEY).agg(F.max(F.array_position(F.lit(X.BUMPS), F.col("bump"))).alias("r")).select(*KEY, F.element_at(F.lit(X.BUMPS), F.col("r").cast("int")).alias("bump"))
    scan = {"root": i.scan_root, "files": usage.source_files(i.files).count()} if scanned else None
    facts = stored(facts, "facts")
    return report.summary_report(requests.join(bumps, KEY), KEY, lines, changes, facts, differ, status, scan)


@dataclass
class Landed:
    """What a loader has landed. adapters, files: repo, branch, path, text. posts: repo, tag, body. compares: repo, old_tag, new_tag, messages.
    responses: the log of attempts (see sources.attempts), which stands for posts and compares and knows of failures. notices: package,
    version, text, url of npm. Each may be None, and laid out by landing.land."""

    adapters: DataFrame | None = None
    posts: DataFrame | None = None
    files: DataFrame | None = None
    compares: DataFrame | None = None
    responses: DataFrame | None = None
    notices: DataFrame | None = None


AT = ["ecosystem", "package", "version"]
PLACE = ["repo", "package", "version"]


def _candidates(versions: DataFrame, landed: Landed) -> DataFrame | None:
    """AT, prio, kind, notes_text, source, url, had_error: what each source has. A source is asked by repository, so that two
    packages of one name in two registries never meet."""
    plain = versions.where("repo is not null").select(*PLACE).distinct()
    chained = versions.where("repo is not null").select(*PLACE, "previous").distinct()
    of = lambda df: landing.of_repositories(df, plain)
    found = []

    def add(kind: str, got: DataFrame, key: list[str]) -> None:
        got = got if "had_error" in got.columns else got.withColumn("had_error", F.lit(False))
        rows = versions.join(got, key)
        found.append(rows.select(*AT, F.lit(PRIORITY.index(kind) + 1).alias("prio"), F.lit(kind).alias("kind"), F.col("text").alias("notes_text"), "source", "url", "had_error"))

    if landed.adapters is not None:
        add("known_adapter", sources.adapter_notes(plain, of(landed.adapters)), PLACE)
    if landed.posts is not None:
        add("github_release", sources.release_notes(plain, of(landed.posts)), PLACE)
    elif landed.responses is not None:
        add("github_release", attempts.release_candidates(plain, of(landed.responses)), PLACE)
    if landed.files is not None:
        add("changelog", sources.changelog_notes(plain, of(landed.files)), PLACE)
    by = [*PLACE, "previous"]
    if landed.compares is not None:
        add("commits", sources.commit_notes(chained, of(landed.compares), tuple(by)), by)
    elif landed.responses is not None:
        add("commits", attempts.commit_candidates(chained, of(landed.responses), by), by)
    return reduce(DataFrame.unionByName, found) if found else None


def resolved_notes(versions: DataFrame, landed: Landed, cache: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Inputs.notes of versions (ecosystem, repo, package, version, previous) from landed sources, in their order of priority.

    One row for each ecosystem, package and version; of rows that repeat one the smallest repository and previous version count. A version
    without notes is there with null text; `unavailable` says that a source failed. Further columns: state (hit, none or miss), has_repo, and
    notice_text and notice_url of npm versions.

    cache: AT, found, notes, origin, url, cached_at. Versions with a live entry are answered from it, without a second source or notice, and
    the sources of their repositories are not read unless others need them; see cache_entries for what goes back."""
    base = versions.groupBy(*AT).agg(F.min(F.struct("repo", "previous")).alias("v")).select(*AT, "v.*")
    if cache is not None:
        known = cache_get(base, cache, AT, F.current_timestamp() if now is None else now, ("origin", "url"))
        known = stored(known.select(*base.columns, "state", F.col("notes").alias("known_text"), F.col("origin").alias("known_source"), F.col("url").alias("known_url")), "known-notes")
        base = known.where("state = 'miss'").select(*base.columns)
    none = F.lit(None).cast("string")
    found = _candidates(base, landed)
    if found is None:
        out = base.withColumns({c: none for c in ("source", "notes_text", "url", "cross_text", "cross_url")} | {c: F.lit(False) for c in ("had_error", "unavailable", "discrepancy")})
    else:
        checked = cross_check(found, AT, ("source", "url")).drop("prio", "kind", "cross_source")
        out = base.join(checked, AT, "left").fillna(False, ["had_error", "unavailable", "discrepancy"])
    if landed.notices is not None:
        notices = landed.notices.select(F.lit("npm").alias("ecosystem"), "package", "version", F.col("text").alias("notice_text"), F.col("url").alias("notice_url"))
        out = out.join(notices.dropDuplicates(AT), AT, "left")
        out = out.withColumns({c: F.when(F.col("repo").isNotNull(), F.col(c)) for c in ("notice_text", "notice_url")})
    else:
        out = out.withColumns({"notice_text": none, "notice_url": none})
    out = out.withColumn("state", F.lit("miss"))
    columns = [*AT, F.col("source").alias("kind"), "notes_text", "url", "cross_text", "cross_url", "had_error", "unavailable", "discrepancy", "state", F.col("repo").isNotNull().alias("has_repo"), "notice_text", "notice_url"]
    if cache is not None:
        # what the cache knows goes beside it
        hits = known.where("state != 'miss'").withColumns({"source": F.col("known_source"), "notes_text": F.col("known_text"), "url": F.col("known_url")} | {c: none for c in ("cross_text", "cross_url", "notice_text", "notice_url")} | {c: F.lit(False) for c in ("had_error", "unavailable", "discrepancy")})
        return out.select(*columns).unionByName(hits.select(*columns))
    return out.select(*columns)


def cache_entries(resolved: DataFrame, now: Column) -> DataFrame:
    """What resolved_notes found out for certain: AT, found, notes, origin, url, cached_at. Where a source failed, or there is no repository, nothing is."""
    sure = resolved.where("state = 'miss' and has_repo and not unavailable")
    return sure.select(*AT, F.col("notes_text").isNotNull().alias("found"), F.col("notes_text").alias("notes"), F.col("kind").alias("origin"), "url", now.alias("cached_at"))


def notices_of(resolved: DataFrame) -> DataFrame:
    """Inputs.notices of resolved notes."""
    return resolved.where("ecosystem = 'npm' and notice_text is not null").select("package", "version", F.col("notice_text").alias("text"), F.col("notice_url").alias("url"))
