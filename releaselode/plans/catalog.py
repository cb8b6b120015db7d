"""All queries over the driver's tables, each with its equivalent in DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import paths as P
from ..functions import text as T
from ..functions import versions as V
from ..operators import advisories, notes, risk, sources, upgrades, usage
from ..sources import notes as landed
from ..session import scratch
from ..sources import attempts, registry, sinks
from . import oracle as O
from . import upgrade
from .derive import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str, extra: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *views, extra=extra) if views or extra else sql
        return f

    return add


# ---- versions and paths


_BOTH = O.RELEASES.replace("d_release", "d_release_both")


@query(f"with {_BOTH} z as (select 1) select ecosystem, package, version, row_number() over (partition by ecosystem, package order by k, version) as ord from rel", "d_release_both")
def version_sort(spark, d):
    return upgrades.version_order(view(spark, d, "d_release_both"))


@query(f"with {O.PATH} z as (select 1) select package, version, step from steps", "d_request")
def upgrade_path(spark, d):
    return upgrades.upgrade_path(view(spark, d, "d_request"), view(spark, d, "d_release")).select("package", "version", "step")


@query(f"with {O.PATH} z as (select 1), b as (select *, coalesce(lag(k) over (partition by package order by step), ck) as bk, coalesce(lag(version) over (partition by package order by step), current_version) as previous from steps) select package, version, previous, {O.bump('bk', 'k')} as bump from b", "d_request")
def bump_sequence(spark, d):
    return upgrades.upgrade_path(view(spark, d, "d_request"), view(spark, d, "d_release")).select("package", "version", "previous", "bump")


@query(f"with {_BOTH} b as (select *, lag(k) over (partition by ecosystem, package order by k, version) as bk from rel) select ecosystem, package, version, {O.bump('bk', 'k')} as bump from b where bk is not null", "d_release_both")
def classify_bump(spark, d):
    w = Window.partitionBy("ecosystem", "package").orderBy("key", "version")
    df = upgrades.releases(view(spark, d, "d_release_both")).withColumn("before", F.lag("key").over(w)).where("before is not null")
    return df.select("ecosystem", "package", "version", V.classify_bump(F.col("before"), F.col("key")).alias("bump"))


@query(f"with {O.PATH} b as (select *, coalesce(lag(k) over (partition by package order by step), ck) as bk from steps), r as (select package, max(list_position(['patch', 'minor', 'major', 'prerelease'], {O.bump('bk', 'k')})) as m from b group by 1) select q.package, (['patch', 'minor', 'major', 'prerelease'])[coalesce(r.m, 1)] as bump from d_request q left join r on r.package = q.package", "d_request")
def overall_bump(spark, d):
    requests = view(spark, d, "d_request")
    return upgrades.overall_bump(requests, upgrades.upgrade_path(requests, view(spark, d, "d_release")))


@query(f"with {O.RELEASES} z as (select 1) select distinct version, {O.prerelease('k')} as prerelease from rel", "d_release")
def is_prerelease(spark, d):
    return upgrades.releases(view(spark, d, "d_release")).select("version", V.is_prerelease(F.col("key")).alias("prerelease")).distinct()


#: Ranges with their conditions, each bound parsed once.
_RANGES = f"""rng as (select vulnerable_range, [{{'op': regexp_extract(x, {O.q(X.RANGE_CONDITION)}, 1), 'b': {O.key(f"regexp_extract(x, {O.q(X.RANGE_CONDITION)}, 2)")}}} for x in regexp_extract_all(vulnerable_range, {O.q(X.RANGE_CONDITION)})] as conds from (select distinct vulnerable_range from d_advisory)), """
_IN_RANGE = """case when len(conds) = 0 then false else
 list_bool_and([coalesce(case c.op when '>=' then k >= c.b when '<=' then k <= c.b when '>' then k > c.b when '<' then k < c.b else k = c.b end, false) for c in conds]) end"""


# versions with a part of up to thirty digits
_LONG = "version || '.' || repeat('9', cast(12 + o_orderkey % 18 as integer)) || o_orderkey % 7"


@query(f"with r as (select distinct ecosystem, package, {_LONG} as version from d_release_both), v as (select *, {O.key('version')} as k from r) select ecosystem, package, version, row_number() over (partition by ecosystem, package order by k, version) as ord from v where k is not null", "d_release_both")
def version_order_bytes(spark, d):
    """The order of versions by their bytes alone."""
    df = view(spark, d, "d_release_both").selectExpr("ecosystem", "package", f"{_LONG} as version").distinct()
    df = df.withColumn("order", V.version_bytes(V.version_key(F.col("version")))).where("order is not null")
    return df.select("ecosystem", "package", "version", F.row_number().over(Window.partitionBy("ecosystem", "package").orderBy("order", "version")).cast("long").alias("ord"))


@query(f"with r as (select distinct package, {_LONG} as version from d_release), v as (select *, {O.key('version')} as k from r) select package, version, row_number() over (partition by package order by k, version) as ord, coalesce({O.bump('lag(k) over (partition by package order by k, version)', 'k')}, 'patch') as bump from v where k is not null", "d_release")
def version_sort_long(spark, d):
    df = view(spark, d, "d_release").selectExpr("package", f"{_LONG} as version").distinct().withColumn("key", V.version_key(F.col("version"))).where("key is not null")
    w = Window.partitionBy("package").orderBy("key", "version")
    return df.select("package", "version", F.row_number().over(w).cast("long").alias("ord"), V.classify_bump(F.lag("key").over(w), F.col("key")).alias("bump"))


@query(f"with {O.RELEASES} {_RANGES} j as (select rel.package, rel.version, rel.k, a.ghsa_id, rng.conds from rel join d_advisory a on lower(a.name) = rel.package join rng on rng.vulnerable_range = a.vulnerable_range) select package, version, ghsa_id, {_IN_RANGE} as matched from j", "d_release", "d_advisory")
def version_range_match(spark, d):
    a = view(spark, d, "d_advisory").select(F.lower("name").alias("package"), "ghsa_id", V.conditions(F.col("vulnerable_range")).alias("conditions"))
    df = upgrades.releases(view(spark, d, "d_release")).join(a, "package")
    return df.select("package", "version", "ghsa_id", V.holds(F.col("key"), F.col("conditions")).alias("matched"))


def _advisories(spark, d):
    v = F.array(F.struct("ecosystem", "name", F.col("vulnerable_range").alias("range")))
    return view(spark, d, "d_advisory").select("ghsa_id", F.concat(F.lit("Advisory "), "ghsa_id").alias("summary"), "severity", F.concat(F.lit("https://example.org/"), "ghsa_id").alias("html_url"), v.alias("vulnerabilities"))


@query(f"with {O.RELEASES} {_RANGES} j as (select rel.package, rel.version, rel.k, a.ghsa_id, rng.conds, a.severity from rel join d_advisory a on lower(a.name) = rel.package join rng on rng.vulnerable_range = a.vulnerable_range and a.ecosystem = case rel.ecosystem when 'pypi' then 'pip' else 'npm' end) select package, version, ghsa_id, severity from j where {_IN_RANGE}", "d_release", "d_advisory")
def advisory_join(spark, d):
    versions = upgrades.releases(view(spark, d, "d_release")).select("ecosystem", "package", "version")
    return advisories.advisory_matches(versions, _advisories(spark, d)).select("package", "version", "ghsa_id", "severity")


# ---- registry documents


def _pypi_meta(spark, d):
    r = view(spark, d, "d_release").where("ecosystem = 'pypi'").groupBy("package", "version").agg(F.max("n_files").alias("n"))
    files = F.when(F.col("n") > 0, F.array(F.struct(F.lit("f.whl").alias("filename")))).otherwise(F.array().cast("array<struct<filename:string>>"))
    rel = F.map_from_entries(F.collect_list(F.struct("version", files)))
    made = r.groupBy("package").agg(F.to_json(F.struct(F.struct(F.first("package").alias("name")).alias("info"), rel.alias("releases"))).alias("j"))
    return made.select(F.from_json("j", registry.PYPI).alias("m")).select("m.*")


def _npm_meta(spark, d):
    r = view(spark, d, "d_release").where("ecosystem = 'npm'").groupBy("package", "version").agg(F.min("o_orderkey").alias("n"))
    one = F.struct("version", F.when(F.col("n") % 7 == 0, F.concat(F.lit("use "), "package", F.lit(" later"))).alias("deprecated"))
    made = r.groupBy("package").agg(F.to_json(F.struct(F.first("package").alias("name"), F.map_from_entries(F.collect_list(F.struct("version", one))).alias("versions"), F.struct(F.concat(F.lit("git+https://github.com/org/"), F.first("package"), F.lit(".git")).alias("url")).alias("repository"))).alias("j"))
    return made.select(F.from_json("j", registry.NPM).alias("m")).select("m.*")


_PYPI_SQL = f"select 'pypi' as ecosystem, package, version from (select package, version, max(n_files) as n from d_release where ecosystem = 'pypi' group by 1, 2) where n > 0 and {O.key('version')} is not null"
_NPM_SQL = f"select distinct 'npm' as ecosystem, package, version from d_release where ecosystem = 'npm' and {O.key('version')} is not null"


@query(_PYPI_SQL, "d_release")
def src_pypi(spark, d):
    return registry.pypi_releases(_pypi_meta(spark, d)).drop("n_files")


@query(_NPM_SQL, "d_release")
def src_npm(spark, d):
    return registry.npm_releases(_npm_meta(spark, d)).drop("n_files")


@query(f"{_PYPI_SQL} union all {_NPM_SQL}", "d_release")
def src_registry(spark, d):
    return registry.registry(_pypi_meta(spark, d), _npm_meta(spark, d)).drop("n_files")


@query("select package, version, 'npm Registry Deprecation Notice' as source, 'This version is marked deprecated by the maintainer: use ' || package || ' later' as text, 'https://www.npmjs.com/package/' || package || '/v/' || version as url from (select package, version, min(o_orderkey) as n from d_release where ecosystem = 'npm' group by 1, 2) where n % 7 = 0", "d_release")
def src_npm_deprec(spark, d):
    return registry.npm_deprecations(_npm_meta(spark, d))


@query("select ghsa_id, lower(name) as package, ecosystem, severity, vulnerable_range from d_advisory", "d_advisory")
def src_advisory(spark, d):
    v = F.array(F.struct(F.struct("ecosystem", "name").alias("package"), F.col("vulnerable_range").alias("vulnerable_version_range")))
    made = view(spark, d, "d_advisory").select(F.to_json(F.struct("ghsa_id", "severity", v.alias("vulnerabilities"))).alias("j"))
    rows = made.select(F.from_json("j", registry.ADVISORY).alias("a")).select("a.ghsa_id", "a.severity", F.explode("a.vulnerabilities").alias("v"))
    return rows.select("ghsa_id", F.lower("v.package.name").alias("package"), "v.package.ecosystem", "severity", F.col("v.vulnerable_version_range").alias("vulnerable_range"))


_ADDRESS = "case page_id % 6 when 0 then 'git+https://github.com/o' || page_id || '/r' || page_id % 9 || '.git' when 1 then '  https://github.com/o' || page_id || '/r/ ' when 2 then 'https://www.github.com/o' || page_id || '/r' when 3 then 'git@github.com:o/r' || page_id || '.git' when 4 then url else 'https://github.com/o' || page_id || '//' end"


def _repo_sql(u: str) -> str:
    clean = f"replace(replace({O.sub(O.strip(u), '/+$')}, 'git+', ''), '.git', '')"
    parts = f"string_split(string_split({clean}, 'github.com/')[-1], '/')"
    return f"(select case when coalesce(p[1], '') <> '' and coalesce(p[2], '') <> '' then p[1] || '/' || p[2] end from (select {parts} as p))"


@query(f"with a as (select page_id, {_ADDRESS} as u from pages) select page_id, {_repo_sql('u')} as repo from a")
def repo_normalize(spark, d):
    return table(spark, d, "pages").selectExpr("page_id", f"{_ADDRESS} as u").select("page_id", P.repository(F.col("u")).alias("repo"))


@query("""select page_id, case when page_id % 5 = 0 then case when page_id % 2 = 0 then 'home/h' || page_id end when page_id % 3 = 0 then 'code/c' || page_id when page_id % 2 = 0 then 'home/h' || page_id else 'docs/d' || page_id end as repo from pages""")
def repo_pick(spark, d):
    rows = table(spark, d, "pages").selectExpr(
        "page_id as package", "if(page_id % 2 = 0, 'https://github.com/home/h' || page_id, null) as home_page",
        "if(page_id % 5 = 0, cast(null as array<struct<key:string,url:string>>), array(struct('Docs' as key, 'https://github.com/docs/d' || page_id as url), struct(if(page_id % 3 = 0, 'my source code', 'x') as key, 'https://github.com/code/c' || page_id || '.git' as url))) as urls",
    )
    return registry.pypi_repository(rows).withColumnRenamed("package", "page_id")



# ---- landed notes

_VERSIONS = "select 'org/' || package as repo, package, version, min(o_orderkey) as n from d_release group by 1, 2, 3"


def _versions(spark, d):
    return view(spark, d, "d_release").groupBy(F.concat(F.lit("org/"), "package").alias("repo"), "package", "version").agg(F.min("o_orderkey").alias("n"))


@query(f"""with v as ({_VERSIONS}), c as (select repo, package, version, unnest([version, 'v' || version, 'V' || version, 'release-' || version, package || '-' || version, package || '==' || version]) as tag, unnest([1, 2, 3, 4, 5, 6]) as i, n from v),
h as (select *, 'Notes of ' || tag as body from c where (n + i) % 4 = 1) select repo, package, version, 'GitHub Release Notes' as source, arg_min(body, i) as text, 'https://github.com/' || repo || '/releases/tag/' || arg_min(tag, i) as url from h group by repo, package, version""", "d_release")
def src_release(spark, d):
    v = _versions(spark, d)
    tags = F.expr("array(version, 'v' || version, 'V' || version, 'release-' || version, package || '-' || version, package || '==' || version)")
    posts = v.select("repo", "n", F.posexplode(tags).alias("i", "tag")).select("repo", "tag", F.when((F.col("n") + F.col("i") + 1) % 4 == 1, F.concat(F.lit(" Notes of "), "tag")).otherwise("  ").alias("body"))
    return landed.release_notes(v, posts)


@query("""with v as (select distinct 'org/' || package as repo, package, version from d_release where n_files > 0), f as (select distinct 'org/' || package as repo, package, cast(substr(package, 4) as integer) % 3 as b from d_release)
select v.repo, v.package, v.version, 'CHANGELOG (' || case b when 0 then 'CHANGELOG.md' when 1 then 'HISTORY.rst' else 'CHANGES.md' end || ')' as source, '- changes of ' || v.version as text,
 'https://github.com/' || v.repo || '/blob/' || case b when 0 then 'main/CHANGELOG.md' when 1 then 'master/HISTORY.rst' else 'main/CHANGES.md' end as url from v join f on f.package = v.package
 where not exists (select 1 from d_release o where o.package = v.package and o.n_files > 0 and o.version < v.version and regexp_matches(o.version, '(^|[^0-9])' || replace(v.version, '.', '[.]') || '([^0-9]|$)'))""", "d_release")
def src_changelog(spark, d):
    v = _versions(spark, d).join(upgrades.releases(view(spark, d, "d_release")).select("package", "version"), ["package", "version"])
    b = F.substring("package", 4, 2).cast("int") % 3
    name = F.when(b == 0, "CHANGELOG.md").when(b == 1, "HISTORY.rst").otherwise("CHANGES.md")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("version")), lambda x: F.concat(F.lit("## "), x, F.lit("\n- changes of "), x)), "\n\n")
    files = v.groupBy("repo", name.alias("path"), F.when(b == 1, "master").otherwise("main").alias("branch")).agg(body.alias("text"))
    return landed.changelog_notes(v, files)


@query(f"with {O.RELEASES} s as (select *, lag(version) over (partition by package order by k, version) as previous from rel) select 'org/' || package as repo, package, version, 'GitHub Commits' as source, '- first of ' || version || chr(10) || '- second' as text, 'https://github.com/org/' || package || '/compare/v' || previous || '...' || version as url from s where previous is not null", "d_release")
def src_commits(spark, d):
    w = Window.partitionBy("package").orderBy("key", "version")
    v = upgrades.releases(view(spark, d, "d_release")).withColumn("previous", F.lag("version").over(w)).withColumn("repo", F.concat(F.lit("org/"), "package"))
    made = F.array(F.concat(F.lit("first of "), "version", F.lit("\nmore")), F.lit("  "), F.lit("second"))
    compares = v.where("previous is not null").select("repo", F.concat(F.lit("v"), "previous").alias("old_tag"), F.col("version").alias("new_tag"), made.alias("messages"))
    return landed.commit_notes(v.select("repo", "package", "version", "previous"), compares)


_ADAPTER_ROWS = "d_adapter(adapter, template, mode) as (values " + ", ".join(f"({O.q(p)}, {O.q(t)}, {O.q(m)})" for p, _, t, m, _ in X.ADAPTERS) + ")"


def _landed(spark, d):
    return view(spark, d, "d_landed_file", extra=_ADAPTER_ROWS)


@query("select repo, branch, path, version, text from d_landed_file where regexp_matches(text, '[^\\s]')", "d_landed_file", extra=_ADAPTER_ROWS)
def src_raw_file(spark, d):
    return landed.raw_files(_landed(spark, d)).select("repo", "branch", "path", "version", "text")


def _adapter(names: list[str], spark, d):
    """Notes of every version of every package by these adapters. A path without the version holds the sections or blocks of all its versions."""
    v = view(spark, d, "d_release").select(F.col("package").alias("owner"), "version").distinct()
    asked = v.select("version", "owner", F.explode(F.lit(names)).alias("name")).select(F.concat("owner", F.lit("/"), "name").alias("repo"), F.upper("name").alias("package"), "version")
    parts = F.array_sort(F.collect_list(F.struct("version", "text")))
    files = landed.raw_files(_landed(spark, d).where(F.substring_index("repo", "/", -1).isin(names)))
    files = files.groupBy("repo", "branch", "path").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))
    return landed.adapter_notes(asked, files)


def _adapter_sql(name: str, branches: list[str], mode: str, label: str) -> str:
    """Files are texts by version; of the texts of one path the first one, by version, that has the version's section or block counts."""
    wanted = "replace(replace(replace(t.template, '{v}', v.version), '{maj}', split_part(v.version, '.', 1)), '{min}', split_part(v.version, '.', 2))"
    anchor = "|| '#' || replace(version, '.', '')" if name == "fastapi" else ""
    found, text = {
        "file": ("true", "string_agg(f.text, chr(10) || chr(10) order by f.version)"),
        "section": ("regexp_matches(f.version, '(^|[^0-9])' || replace(v.version, '.', '[.]') || '([^0-9]|$)')", "'- Added ' || min(f.version)"),
        # what follows the digits of a block's version is read as the start of its prose
        "directive": ("regexp_extract(f.version, '^[0-9.]+') = v.version", "case when min(f.version) = v.version then '' else substr(min(f.version), len(v.version) + 1) || chr(10) || chr(10) || '    ' end || 'Fixed ' || min(f.version)"),
    }[mode]
    return f"""with v as (select distinct package as owner, version from d_release), t as (select * from d_adapter where adapter = {O.q(name)}),
f as (select * from d_landed_file where split_part(repo, '/', 2) = {O.q(name)} and regexp_matches(text, '[^\\s]')),
h as (select f.repo, v.version, f.branch, f.path, list_position({branches}, f.branch) as i, {text} as text from v, t, f where f.repo = v.owner || '/' || {O.q(name)} and f.path = {wanted} and {found} group by f.repo, v.version, f.branch, f.path)
select repo, {O.q(name.upper())} as package, version, {O.q(label)} as source, arg_min(text, i) as text, 'https://github.com/' || repo || '/blob/' || arg_min(branch, i) || '/' || arg_min(path, i) {anchor} as url from h where i is not null group by repo, version"""


for _name, _branches, _template, _mode, _label in X.ADAPTERS:
    _key = "adapter_" + {"scikit-learn": "sklearn_long"}.get(_name, _name)
    QUERIES[_key] = lambda spark, d, n=_name: _adapter([n], spark, d)
    ORACLES[_key] = with_views(_adapter_sql(_name, _branches, _mode, _label), "d_landed_file", extra=_ADAPTER_ROWS)


# all adapters at once, as a user asks
@query()
def adapter_whole(spark, d):
    return _adapter([n for n, *_ in X.ADAPTERS], spark, d)


# ---- resolution

_NOTE_KEY = ["ecosystem", "package", "version"]
_RESOLVED = """with r as (select ecosystem, package, version, arg_min(kind, prio) filter (where notes_text is not null) as kind, arg_min(notes_text, prio) filter (where notes_text is not null) as notes_text,
 bool_or(had_error and kind in ('github_release', 'commits')) as had_error, max(notes_text) filter (where kind = 'github_release') as second from d_candidate group by 1, 2, 3),
x as (select *, case when kind in ('known_adapter', 'changelog') then second end as cross_text, kind is null and had_error as unavailable from r) """


@query(_RESOLVED + "select ecosystem, package, version, kind, notes_text from x", "d_candidate")
def resolve_source(spark, d):
    return sources.resolve_source(view(spark, d, "d_candidate"), _NOTE_KEY).select(*_NOTE_KEY, "kind", "notes_text")


@query(_RESOLVED + "select ecosystem, package, version, had_error, unavailable from x", "d_candidate")
def unavailable_flag(spark, d):
    return sources.resolve_source(view(spark, d, "d_candidate"), _NOTE_KEY).select(*_NOTE_KEY, "had_error", "unavailable")


def _overlap_sql(a: str, b: str) -> str:
    x, y = O.word_set(a), O.word_set(b)
    return f"coalesce(len({x}) > 0 and len({y}) > 0 and len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) < 0.15, false)"


@query(_RESOLVED + f"select ecosystem, package, version, kind, cross_text, {_overlap_sql('notes_text', 'cross_text')} as discrepancy from x", "d_candidate")
def cross_check(spark, d):
    return sources.cross_check(view(spark, d, "d_candidate"), _NOTE_KEY).select(*_NOTE_KEY, "kind", "cross_text", "discrepancy")


@query(_RESOLVED + f"select ecosystem, package, version from x where {_overlap_sql('notes_text', 'cross_text')} and cross_text is not null", "d_candidate")
def discrepancy_keep(spark, d):
    return sources.cross_check(view(spark, d, "d_candidate"), _NOTE_KEY).where("discrepancy and cross_text is not null").select(*_NOTE_KEY)


@query(_RESOLVED + "select ecosystem, package, version, case when notes_text is not null then 'notes' when unavailable then 'unavailable' else 'no_notes' end as status from x", "d_candidate")
def version_partition(spark, d):
    return sources.resolve_source(view(spark, d, "d_candidate"), _NOTE_KEY).select(*_NOTE_KEY, sources.note_status().alias("status"))


_OUTCOME = """with o as (select source, repo, request, arg_min(status, attempt) filter (where status is not null and attempt <= 3) as status, arg_min(body, attempt) filter (where status is not null and attempt <= 3) as body,
 cast(coalesce(min(attempt) filter (where status is not null and attempt <= 3), 3) as integer) as attempts from d_attempt group by 1, 2, 3),
s as (select *, case when status is null then 'network' when status = 403 and contains(lower(body), 'rate limit') then 'rate_limit' when status = 200 then 'ok' else 'missing' end as state from o) """


@query(_OUTCOME + "select source, repo, request, state, attempts, case when state = 'ok' then body end as body from s", "d_attempt")
def attempt_outcome(spark, d):
    return attempts.outcomes(view(spark, d, "d_attempt"), ["source", "repo", "request"])


_TEXTS = """, t as (select *, state in ('network', 'rate_limit') as bad, case when state = 'ok' then nullif(trim(regexp_extract(body, '"(body|message)": "([^"]*)"', 2)), '') end as said from s),
v as (select distinct ecosystem, repo, package, version from d_release_both),
r as (select v.ecosystem, v.package, v.version, arg_min(t.bad, i) as bad, arg_min(coalesce(t.said, ''), i) as said, arg_min(t.request, i) as tag from v cross join (select unnest([1, 2]) as i) k
 join t on t.source = 'release' and t.repo = v.repo and t.request = case i when 1 then v.version else 'v' || v.version end where t.bad or t.said is not null group by 1, 2, 3),
c as (select v.ecosystem, v.package, v.version, t.bad, '- ' || t.said as said, t.request from v join t on t.source = 'compare' and t.repo = v.repo and t.request = 'v0...v' || v.version where t.bad or t.said is not null),
x as (select v.*, coalesce(r.bad, false) or coalesce(c.bad, false) as had_error, case when not r.bad then r.said end as posted, case when not c.bad then c.said end as listed, r.tag, c.request
 from v left join r using (ecosystem, package, version) left join c using (ecosystem, package, version)) """


@query(_OUTCOME + _TEXTS + """select ecosystem, package, version, case when posted is not null then 'GitHub Release Notes' when listed is not null then 'GitHub Commits' end as kind, coalesce(posted, listed) as notes_text,
 case when posted is not null then 'https://github.com/' || repo || '/releases/tag/' || tag when listed is not null then 'https://github.com/' || repo || '/compare/' || request end as url, had_error,
 case when coalesce(posted, listed) is not null then 'notes' when had_error then 'unavailable' else 'no_notes' end as status from x""", "d_attempt")  # fmt: skip
def resolved_notes(spark, d):
    versions = view(spark, d, "d_release_both", "select distinct ecosystem, repo, package, version, '0' as previous from d_release_both")
    out = upgrade.resolved_notes(versions, upgrade.Landed(responses=view(spark, d, "d_attempt")))
    return out.select(*_NOTE_KEY, "kind", "notes_text", "url", "had_error", sources.note_status().alias("status"))


@query(f"select doc_id, cast(len({O.word_set('text')}) as bigint) as n_words from documents")
def word_set(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.word_set(F.col("text"))).cast("long").alias("n_words"))


@query(f"select a.doc_id, {_overlap_sql('a.text', 'b.text')} as disagree from documents a join documents b on b.doc_id = a.doc_id + 1")
def discrepancy(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", T.disagree(F.col("text"), F.col("next")).alias("disagree"))


_CACHE = "select 'pypi' as ecosystem, 'u' || cast(user_id % 50 as string) as package, event_type as version, 'resolved' as source, value > 10 as found, 'n' || cast(event_id as string) as notes, ts as cached_at from events"
_CACHE_KEY = ["ecosystem", "package", "version", "source"]


def _cache(spark, d):
    return spark.sql(f"with events as (select * from parquet.`{d}/events.parquet`) {_CACHE}")


_LATEST = f"with c as ({_CACHE}), l as (select *, row_number() over (partition by ecosystem, package, version, source order by cached_at desc, found desc, notes desc) as rn from c) "


@query(_LATEST + "select ecosystem, package, version, source, found, notes from l where rn = 1")
def cache_set(spark, d):
    return sources.cache_set(_cache(spark, d), _CACHE_KEY).select(*_CACHE_KEY, "found", "notes")




@query(_LATEST + f", m as (select cast(max(cached_at) as timestamp) + interval '12 hours' as now from c), j as (select l.*, cast(epoch(m.now) as bigint) - cast(floor(epoch(l.cached_at)) as bigint) as age from l, m where rn = 1 and package <> 'u7') "
       "select ecosystem, package, version, source, case when age <= case when found then 2592000 else 86400 end then case when found then 'hit' else 'none' end else 'miss' end as state, case when found and age <= 2592000 then notes end as notes from j "
       "union all select ecosystem, package, version, source, 'miss', null from l where rn = 1 and package = 'u7'")  # fmt: skip
def cache_get(spark, d):
    raw = _cache(spark, d).withColumn("cached_at", F.col("cached_at").cast("timestamp"))
    cache = sources.cache_set(raw, _CACHE_KEY)
    now = raw.agg((F.max("cached_at") + F.expr("interval 12 hours")).alias("now"))
    asked = cache.select(*_CACHE_KEY).crossJoin(F.broadcast(now))
    return sources.cache_get(asked, cache.where("package != 'u7'"), _CACHE_KEY, F.col("now")).select(*_CACHE_KEY, "state", "notes")


_EVENTS = """select 'pypi' as ecosystem, 'u' || cast(user_id % 50 as string) as package, event_type as version, cast(ts as timestamp) as at, case when event_id % 3 = 0 then event_id end as ask,
 case when event_id % 3 > 0 then cast(1 + event_id % 4 as int) end as prio, case when event_id % 3 > 0 then value > 12 end as found, case when event_id % 3 > 0 and value > 12 then 'n' || cast(event_id as string) end as notes from events"""


@query(f"""with e as ({_EVENTS}), g as (select * from e where ask is not null), p as (select * from e where ask is null),
l as (select g.ecosystem, g.package, g.version, g."at", g.ask, p.prio, max({{'t': p."at", 'found': p.found, 'notes': coalesce(p.notes, '')}}) as x from g left join p on p.package = g.package and p.version = g.version and p."at" <= g."at" group by all),
m as (select *, coalesce(floor(epoch("at")) - floor(epoch(x.t)) <= case when x.found then 2592000 else 86400 end, false) as live from l)
select ecosystem, package, version, "at", ask, case when bool_or(live and x.found) then 'hit' when bool_or(live) then 'none' else 'miss' end as state, arg_min(x.notes, prio) filter (where live and x.found) as notes from m group by all""")
def cache_lookups(spark, d):
    events = spark.sql(f"with events as (select * from parquet.`{d}/events.parquet`) {_EVENTS}")
    return sources.cache_lookups(events, _NOTE_KEY).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select distinct ecosystem, package, version, substr(sha256(ecosystem || ':' || package || ':' || version || ':resolved'), 1, 24) || '.json' as file from d_release", "d_release")
def cache_key(spark, d):
    c = F.col
    return view(spark, d, "d_release").select("ecosystem", "package", "version", sources.cache_key(c("ecosystem"), c("package"), c("version"), F.lit("resolved")).alias("file")).distinct()


# ---- lines, sections, entries

_DOC_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text <> ''), "
_HEADINGS = f"h as (select *, {O.has(O.strip('line'), X.VERSION_LIKE)} and (starts_with({O.strip('line')}, '#') or coalesce({O.has(O.strip('nxt'), X.UNDERLINE)}, false)) as heading from (select *, lead(line) over (partition by %s order by pos) as nxt from %s)) "


def _doc_lines(spark, d):
    return notes.exploded_lines(table(spark, d, "documents"), ["doc_id"])


@query("with " + _HEADINGS % ("package", "d_changelog") + "select package, cast(pos as bigint) as pos, line from h where heading", "d_changelog")
def heading_lines(spark, d):
    lines = view(spark, d, "d_changelog").withColumn("pos", F.col("pos").cast("long"))
    return notes.heading_lines(lines, ["package"]).where("heading").select("package", "pos", "line")


@query("with " + _HEADINGS % ("package", "d_changelog") + f""", s as (select *, sum(heading::int) over (partition by package order by pos) as sec from h),
b as (select package, sec, min(pos) as pos, arg_min(line, pos) as head, nullif({O.strip("string_agg(case when not heading then line end, chr(10) order by pos)")}, '') as body from s where sec > 0 group by 1, 2),
v as (select distinct package, version from d_release where n_files > 0),
m as (select v.package, v.version, b.body, row_number() over (partition by v.package, v.version order by b.pos) as rn from v join b on b.package = v.package and contains(b.head, v.version) and regexp_matches(b.head, '(^|[^0-9])' || replace(v.version, '.', '[.]') || '([^0-9]|$)'))
select package, version, body from m where rn = 1 and body is not null""", "d_changelog")
def version_section(spark, d):
    cut = notes.version_sections(view(spark, d, "d_changelog"), ["package"])
    versions = upgrades.releases(view(spark, d, "d_release")).select("package", "version")
    return notes.sections_of(versions, cut, ["package"])


_PARAGRAPHS = f"""with {_DOC_LINES} a as (select *, {O.strip('line')} as s from l),
b as (select *, starts_with(s, '#') as hash, not starts_with(s, '#') and s <> '' and coalesce({O.has("lead(s) over w", X.UNDERLINE)}, false) as cand from a window w as (partition by doc_id order by pos)),
c as (select *, sum((not cand)::int) over (partition by doc_id order by pos) as run from b),
e as (select *, cand and sum(cand::int) over (partition by doc_id, run order by pos) % 2 = 1 as setext from c),
f as (select *, hash or setext as head, coalesce(lag(setext) over (partition by doc_id order by pos), false) as taken from e),
g as (select *, case when not head and not taken and lower(s) in ({", ".join(map(O.q, X.SECTION_NAMES))}) then s end as name from f),
i as (select *, head or taken or s = '' or name is not null as stop from g),
j as (select *, sum((head or name is not null)::int) over w as block, sum(stop::int) over w as para, last_value(name ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as upto from i window w as (partition by doc_id order by pos)),
k as (select *, coalesce(lead(upto) over (partition by doc_id order by pos), upto) as section from j),
m as (select *, row_number() over (partition by doc_id, para order by pos) as n from k where not stop),
p as (select doc_id, para, arg_max(section, pos) as section, max(block) as block, bool_or(n > 1 and not {O.noise(O.sub('line', r'\s+$'))} and {O.has('lower(line)', X.PARAGRAPH_VERBS)}) as is_change, list(s order by pos) as lines from m group by doc_id, para),
pp as (select * from p where not (len(lines) = 1 and {O.has('lines[1]', X.SUBHEADER)})) """


@query(_PARAGRAPHS + "select doc_id, cast(para as bigint) as para, section, cast(block as bigint) as block, is_change, cast(len(lines) as bigint) as n_lines, md5(array_to_string(lines, chr(10))) as digest from pp")
def paragraphs(spark, d):
    df = notes.paragraphs(_doc_lines(spark, d), ["doc_id"])
    return df.select("doc_id", "para", "section", "block", "is_change", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


_ENTRIES = _PARAGRAPHS + f""", q1 as (select *, is_change or row_number() over w = 1 or section is distinct from lag(section) over w or block <> lag(block) over w as fresh from pp window w as (partition by doc_id order by para)),
q2 as (select *, sum(fresh::int) over (partition by doc_id order by para) as grp from q1),
q3 as (select doc_id, grp, arg_min(section, para) as section, flatten(list(lines order by para)) as ls from q2 group by 1, 2),
q4 as (select doc_id, grp, section, unnest(ls) as line, unnest(range(len(ls))) as i0 from q3),
q5 as (select *, row_number() over (partition by doc_id, grp order by i0) as i, {O.has('line', X.BULLET)} or {O.has('line', X.NUMBERED)} as bullet from q4 where not {O.has('line', X.SUBHEADER)} and not {O.noise('line')}),
q6 as (select *, bool_or(bullet) over (partition by doc_id, grp) as listed, sum((bullet or i = 1)::int) over (partition by doc_id, grp order by i) as item from q5),
q7 as (select doc_id, grp, case when listed then item else 1 end as item, arg_min(section, i) as section, string_agg(case when listed then regexp_replace({O.sub('line', X.BULLET)}, '^[0-9]+[.]\\s+([A-Za-z])', '\\1') else line end, ' ' order by i) as entry from q6 group by 1, 2, 3),
q8 as (select doc_id, row_number() over (partition by doc_id order by grp, item) as ord, section, {O.markup('entry')} as entry from q7) """


@query(_ENTRIES + "select doc_id, ord, section, md5(entry) as digest from q8")
def entries(spark, d):
    return notes.entries(_doc_lines(spark, d), ["doc_id"]).select("doc_id", "ord", "section", F.md5("entry").alias("digest"))


# all notes as one text, which no single task can hold at scale: places have gaps, headings are plain or underlined
_ONE_TEXT = """select 'all' as doc_id, cast(l_orderkey * 32 + 2 * l_linenumber + 8 as bigint) as pos, case when l_linenumber % 3 = 2 then '  and ' || line else '- ' || line end as line from d_note_line
 union all select 'all', cast(o_orderkey * 32 as bigint), case when o_orderkey % 4 = 1 then version else '## ' || version end from d_release
 union all select 'all', cast(o_orderkey * 32 + 1 as bigint), case when o_orderkey % 4 = 1 then '-----' when o_orderkey % 4 = 2 then '' else 'Bug Fixes' end from d_release
 union all select 'all', cast(o_orderkey * 32 + 2 as bigint), '=====' from d_release where o_orderkey % 8 < 2"""


def _one_text(spark, d):
    return view(spark, d, "d_note_line", _ONE_TEXT)


@query(f"with t as ({_ONE_TEXT}), " + _HEADINGS % ("doc_id", "t") + f""", s as (select *, sum(heading::int) over (order by pos) as section, coalesce(lag(heading) over (order by pos), false) as headed from h)
select cast(section as bigint) as section, min(pos) as pos, arg_min(line, pos) as heading, md5(nullif({O.strip(f"string_agg(case when not heading and not (headed and {O.has(O.strip('line'), X.UNDERLINE)}) then line end, chr(10) order by pos)")}, '')) as digest from s where section > 0 group by 1""", "d_note_line")
def section_one_text(spark, d):
    return notes.version_sections(_one_text(spark, d), ["doc_id"]).select("section", "pos", "heading", F.md5("body").alias("digest"))


@query(_ENTRIES.replace(_DOC_LINES, f"l as ({_ONE_TEXT}), ") + "select ord, section, md5(entry) as digest from q8", "d_note_line")
def entry_one_text(spark, d):
    return notes.entries(_one_text(spark, d), ["doc_id"]).select("ord", "section", F.md5("entry").alias("digest"))


_MARKED = "case l_linenumber % 4 when 0 then ':func:`' || line || '` x' when 1 then 'see `' || package || ' <http://x>`_ and ``' || version || '``' when 2 then '``a`` ' || line else line end"


@query(f"with m as (select *, {_MARKED} as t from d_note_line) select l_orderkey, l_linenumber, t, {O.markup('t')} as clean from m", "d_note_line")
def clean_markup(spark, d):
    return view(spark, d, "d_note_line").selectExpr("l_orderkey", "l_linenumber", f"{_MARKED} as t").withColumn("clean", T.clean_markup(F.col("t")))


# ---- predicates and classes

_ALL_LINES = f"with {_DOC_LINES} t as (select 'd' || doc_id || '.' || pos as id, line from l union all select 'n' || l_orderkey || '.' || l_linenumber, line from d_note_line) "


def _all_lines(spark, d):
    a = _doc_lines(spark, d).select(F.concat(F.lit("d"), "doc_id", F.lit("."), "pos").alias("id"), "line")
    return a.union(view(spark, d, "d_note_line").select(F.concat(F.lit("n"), "l_orderkey", F.lit("."), "l_linenumber"), "line"))


@query(_ALL_LINES + f"select id, {O.noise('line')} as noise from t", "d_note_line")
def is_noise(spark, d):
    return _all_lines(spark, d).select("id", T.is_noise(F.col("line")).alias("noise"))


@query(_ALL_LINES + f"select id, {O.continuation('line')} as continues from t", "d_note_line")
def continuation(spark, d):
    return _all_lines(spark, d).select("id", T.is_continuation(F.col("line")).alias("continues"))


@query(_ALL_LINES + f"select id, {O.noise_fragment('line')} as fragment from t", "d_note_line")
def noise_fragment(spark, d):
    return _all_lines(spark, d).select("id", T.is_noise_fragment(F.col("line")).alias("fragment"))


@query(_ALL_LINES + f"select id, {O.meaningful('line')} as meaningful from t", "d_note_line")
def is_meaningful(spark, d):
    return _all_lines(spark, d).select("id", T.is_meaningful(F.col("line")).alias("meaningful"))


_SECTION = "case l_orderkey % 5 when 0 then 'New Deprecations' when 1 then 'Breaking Changes' when 2 then 'Expired Deprecations' end"


@query(f"with s as (select *, {_SECTION} as section from d_note_line) select l_orderkey, l_linenumber, {O.category('line', 'section')} as category from s", "d_note_line")
def classify_category(spark, d):
    df = view(spark, d, "d_note_line").selectExpr("*", f"{_SECTION} as section")
    return df.select("l_orderkey", "l_linenumber", T.category(F.col("line"), F.col("section")).alias("category"))


@query(f"with s as (select *, {_SECTION} as section from d_note_line where {O.meaningful('line')}) select l_orderkey, l_linenumber, {O.category('line', 'section')} as category, line || coalesce(' [Section: ' || section || ']', '') as labelled from s", "d_note_line")
def categorize(spark, d):
    df = view(spark, d, "d_note_line").selectExpr("l_orderkey", "l_linenumber", "line as entry", f"{_SECTION} as section")
    return notes.categorized(df).select("l_orderkey", "l_linenumber", "category", "labelled")


_ANSWER = """case event_id % 5 when 0 then '```json' || chr(10) || '[{"category": "Bug Fixes", "summary": " fixed ' || event_type || ' "}, {"category": "Nonsense", "summary": "odd"}, {"category": "API Changes", "summary": " "}]' || chr(10) || '```'
 when 1 then '[{"category": "Security Updates", "summary": "patched ' || event_type || '"}]' when 2 then '{"no": "array"}' when 3 then 'not json' else '[]' end"""


@query("""select event_id, cast(1 as bigint) as ord, 'Bug Fixes' as category, 'fixed ' || event_type as entry from events where event_id % 5 = 0
union all select event_id, 2, 'Other User-Impacting Changes', 'odd' from events where event_id % 5 = 0 union all select event_id, 1, 'Security Updates', 'patched ' || event_type from events where event_id % 5 = 1""")
def llm_parse(spark, d):
    return notes.from_model(table(spark, d, "events").selectExpr("event_id", f"{_ANSWER} as answer"), ["event_id"])


@query(f"""select event_id, 'Bug Fixes' as category, 'fixed ' || event_type as line from events where event_id % 5 = 0 union all select event_id, 'Other User-Impacting Changes', 'odd' from events where event_id % 5 = 0
union all select event_id, 'Security Updates', 'patched ' || event_type from events where event_id % 5 = 1 union all select event_id, {O.category("'Fixed a crash in ' || event_type", 'null')}, 'Fixed a crash in ' || event_type from events where event_id % 5 in (2, 3)""")
def categorize_smart(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", f"{_ANSWER} as answer", "'Fixed a crash in ' || event_type as entry", "cast(null as string) as section")
    by_model = notes.from_model(df, ["event_id"]).select("event_id", "category", F.col("entry").alias("line"))
    return by_model.union(notes.categorized(df.where(~notes.has_answer(F.col("answer")))).select("event_id", "category", F.col("labelled").alias("line")))


@query(f"""with s as (select package, version, l_orderkey, l_linenumber, line, {O.category('line', 'null')} as category from d_note_line where {O.meaningful('line')}), k as (select *, {O.dedup_key('line')} as dedup_key from s),
r as (select *, row_number() over (partition by package, category, dedup_key order by version, l_orderkey, l_linenumber) as rn from k) select package, category, version, l_orderkey, l_linenumber, line from r where rn = 1""", "d_note_line")
def merge_dedup(spark, d):
    df = view(spark, d, "d_note_line").select("package", "version", "l_orderkey", "l_linenumber", F.col("line").alias("entry"), F.lit(None).cast("string").alias("section"))
    df = notes.categorized(df).select("package", "category", "version", "l_orderkey", "l_linenumber", F.col("labelled").alias("line"))
    return notes.merged(df, ["package"], ["version", "l_orderkey", "l_linenumber"], "line").select("package", "category", "version", "l_orderkey", "l_linenumber", "line")


# ---- fields

_SRC = "src as (select l_orderkey, l_linenumber, line from d_note_line), "
_ID = ["l_orderkey", "l_linenumber"]


def _src(spark, d):
    return view(spark, d, "d_note_line").select(*_ID, "line")


@query(f"with {_SRC} z as (select 1) select l_orderkey, l_linenumber, array_to_string({O.api_names('line')}, ',') as names from src", "d_note_line")
def api_candidates(spark, d):
    return _src(spark, d).select(*_ID, F.array_join(T.api_names(F.col("line")), ",").alias("names"))


_NAMES = "case l_orderkey % 6 when 0 then '`np.' || l_linenumber || '(x)`.' when 1 then 'numpy.a[0];' when 2 then 'e.g.' when 3 then 'a/b' when 4 then 'setup.py' else line end"


@query(f"with s as (select l_orderkey, l_linenumber, {_NAMES} as raw from d_note_line) select l_orderkey, l_linenumber, {O.api_name('raw')} as name from s", "d_note_line")
def api_normalize(spark, d):
    return view(spark, d, "d_note_line").selectExpr(*_ID, f"{_NAMES} as raw").select(*_ID, T.api_name(F.col("raw")).alias("name"))


@query(f"with {_SRC} z as (select 1) select l_orderkey, l_linenumber, {O.subject('line')} as subject, {O.alternative('line')} as alternative from src", "d_note_line")
def split_subject(spark, d):
    return _src(spark, d).select(*_ID, T.subject_clause(F.col("line")).alias("subject"), T.alternative_clause(F.col("line")).alias("alternative"))


@query(f"with {_SRC} z as (select 1) select l_orderkey, l_linenumber, {O.citations('line')} as text from src", "d_note_line")
def strip_citations(spark, d):
    return _src(spark, d).select(*_ID, T.strip_citations(F.col("line")).alias("text"))


_LABELLED = f"line || coalesce(' [Section: ' || {_SECTION} || ']  ', '')"


@query(f"select l_orderkey, l_linenumber, line as text, {_SECTION} as section from d_note_line", "d_note_line")
def strip_section(spark, d):
    df = view(spark, d, "d_note_line").selectExpr(*_ID, f"{_LABELLED} as t")
    return df.select(*_ID, T.strip_section(F.col("t")).alias("s")).select(*_ID, "s.*")


@query(f"with {_SRC} {O.SUBJECTS} z as (select 1) select l_orderkey, l_linenumber, {O.operation('sc')} as operation, attr as attribute from subj", "d_note_line")
def operation_phrase(spark, d):
    return _src(spark, d).select(*_ID, T.operation_and_attribute(T.subject_clause(F.col("line"))).alias("s")).select(*_ID, "s.*")


@query(f"with {_SRC} {O.SUBJECTS} z as (select 1) select l_orderkey, l_linenumber, api, operation, replacement, confidence, attribute from subj", "d_note_line")
def change_subject(spark, d):
    return _src(spark, d).select(*_ID, T.change_subject(F.col("line")).alias("s")).select(*_ID, "s.*")


_TYPED = f"{O.SUBJECTS} ty as (select *, {O.category('line', 'null')} as category from subj), kd as (select *, {O.change_type('category', 'line')} as kind from ty), "


def _typed(spark, d):
    # a step by itself makes the lower case, so that the rules are generated code over its column
    df = _src(spark, d).withColumn("low", F.lower("line"))
    df = df.withColumn("category", T.category_of_lower(F.col("low"), F.lit("")))
    return df.withColumn("kind", T.change_type_of_lower(F.col("category"), F.col("low"))).withColumn("s", T.change_subject(F.col("line")))


@query(f"with {_SRC} {_TYPED} z as (select 1) select l_orderkey, l_linenumber, kind from kd", "d_note_line")
def refine_type(spark, d):
    return _typed(spark, d).select(*_ID, "kind")


@query(f"with {_SRC} {_TYPED} z as (select 1) select l_orderkey, l_linenumber, {O.pick('kind', X.SEVERITIES, 'LOW')} as severity from kd", "d_note_line")
def baseline_severity(spark, d):
    return _typed(spark, d).select(*_ID, T.severity(F.col("kind")).alias("severity"))


@query(f"with {_SRC} {_TYPED} z as (select 1) select l_orderkey, l_linenumber, {O.title('api', 'operation', 'kind', 'category')} as title from kd", "d_note_line")
def change_title(spark, d):
    c = F.col
    return _typed(spark, d).select(*_ID, T.change_title(c("s.api"), c("s.operation"), c("kind"), c("category")).alias("title"))


@query(f"with {_SRC} {_TYPED} z as (select 1) select l_orderkey, l_linenumber, {O.advice('kind', 'api', 'operation', 'replacement')} as recommendation from kd", "d_note_line")
def recommendation(spark, d):
    c = F.col
    # a line whose advice quotes nothing is not searched for its subject
    df = _typed(spark, d).withColumn("s", F.when(T.is_quoted(c("kind")), T.change_subject(c("line"))))
    return df.select(*_ID, T.recommendation(c("kind"), c("s.api"), c("s.operation"), c("s.replacement")).alias("recommendation"))


_BEHAVIOUR = "case l_orderkey % 3 when 0 then 'Previously, ' || line || '. Now, it raises ' || version || ' errors. More.' when 1 then 'previously it did ' || repeat('x', cast(l_linenumber * 40 as integer)) || '. now it does y. z' else line end"
_KIND = "case l_linenumber % 3 when 0 then 'REMOVAL' when 1 then 'BEHAVIOR_CHANGE' else 'COMPATIBILITY_CHANGE' end"


@query(f"with s as (select l_orderkey, l_linenumber, {_BEHAVIOUR} as t, {_KIND} as kind from d_note_line) select l_orderkey, l_linenumber, " + ", ".join(f"case when kind <> 'REMOVAL' and {O.has('t', '(?is)' + X.PREVIOUSLY_NOW)} then {O.short(O.strip(O.got('t', '(?is)' + X.PREVIOUSLY_NOW, i)), 150)} end as {n}" for i, n in ((1, "old_behavior"), (2, "new_behavior"))) + " from s", "d_note_line")
def old_new(spark, d):
    df = view(spark, d, "d_note_line").selectExpr(*_ID, f"{_BEHAVIOUR} as t", f"{_KIND} as kind")
    return df.select(*_ID, *(T.behaviour(F.col("t"), F.col("kind"), i).alias(n) for i, n in ((1, "old_behavior"), (2, "new_behavior"))))


_PYTHON = "case o_orderkey % 4 when 0 then 'Drops support for Python 3.' || cast(o_orderkey % 6 as string) || '. Removes support for Python 2.7' when 1 then 'Supports Python versions 3.' || cast(o_orderkey % 5 as string) || ' - 3.12. ok' else 'nothing' end"


@query(f"""with t as (select package, o_orderkey, {_PYTHON} as text from d_release), d as (select package, o_orderkey, unnest(regexp_extract_all(text, {O.q('(?i)' + X.PYTHON_DROPPED)}, 1)) as v, unnest(range(len(regexp_extract_all(text, {O.q('(?i)' + X.PYTHON_DROPPED)}, 1)))) as i from t),
f as (select package, v, min(o_orderkey * 10 + i) as seat from d group by 1, 2), g as (select package, string_agg(v, ',' order by seat) as dropped from f group by 1),
s as (select package, arg_min({O.sub(O.got('text', '(?i)' + X.PYTHON_SUPPORTED), '[. ]+$')}, o_orderkey) as supported from t where {O.has('text', '(?i)' + X.PYTHON_SUPPORTED)} group by 1)
select p.package, coalesce(g.dropped, '') as dropped, s.supported from (select distinct package from t) p left join g on g.package = p.package left join s on s.package = p.package""", "d_release")
def python_compat(spark, d):
    texts = view(spark, d, "d_release").selectExpr("package", "o_orderkey", f"{_PYTHON} as text")
    return risk.python_support(texts, ["package"], ["o_orderkey"]).select("package", F.array_join("dropped", ",").alias("dropped"), "supported")


# ---- project files

_SKIPPED = "list_has_any(string_split(path, '/'), [" + ", ".join(map(O.q, X.SKIPPED_FOLDERS)) + "])"
_IS_TEST = "(list_has_any(string_split(lower(path), '/'), ['tests', 'test']) or regexp_matches(lower(path), '(^|/)test_[^/]*$') or regexp_matches(lower(path), '_test[.]pyi?$'))"
_IS_SOURCE = "regexp_matches(lower(path), '[^/.][^/]*[.](py|pyi|js|ts|tsx|jsx)$')"


@query(f"select path, {_SKIPPED} as skipped from d_code_file", "d_code_file")
def skip_path(spark, d):
    return view(spark, d, "d_code_file").select("path", P.is_skipped(F.col("path")).alias("skipped"))


@query(f"select path, {_IS_TEST} as is_test from d_code_file", "d_code_file")
def is_test_path(spark, d):
    return view(spark, d, "d_code_file").select("path", P.is_test(F.col("path")).alias("is_test"))


@query(f"select path, {_IS_TEST} as is_test from d_code_file where {_IS_SOURCE} and not {_SKIPPED}", "d_code_file")
def src_code_files(spark, d):
    return usage.source_files(view(spark, d, "d_code_file")).select("path", "is_test")


@query(f"select count(*) as files_scanned, cast(0 as bigint) as files_skipped from d_code_file where {_IS_SOURCE} and not {_SKIPPED}", "d_code_file")
def scan_summary(spark, d):
    return usage.scan_summary(view(spark, d, "d_code_file")).select("files_scanned", "files_skipped")


def _apis(spark, d):
    return table(spark, d, "part").selectExpr("'numpy.' || replace(p_name, ' ', '_') as api").distinct()


_FILES = f"files as (select *, {_IS_TEST} as is_test, case when content like 'import numpy as np%' then 'call' when content like 'from numpy import *%' then 'star' when content like 'arr.%' then 'attr' end as fact, 'numpy.' || regexp_extract(content, chr(10) || '(?:np[.])?(.*)[(]x[)]', 1) as api from d_code_file where {_IS_SOURCE} and not {_SKIPPED} and regexp_matches(content, '^(import|from|#|arr)')), "
#: These few forms of content are simple enough for SQL; the parser itself is tested on real code.
_USAGE = f"with {_FILES} sure as (select api, path, 2 as line, 'confirmed' as kind, is_test from files where fact = 'call' and regexp_matches(api, '^numpy[.][A-Za-z_][A-Za-z0-9_]*$')), maybe as (select api, min(path) as path, 2 as line, 'potential' as kind, arg_min(is_test, path) as is_test from files where fact = 'star' and api not in (select api from sure) and regexp_matches(api, '^numpy[.][A-Za-z_][A-Za-z0-9_]*$') group by api), hits as (select * from sure union all select * from maybe) "


@query(_USAGE + "select api, path, line, kind, is_test from hits", "d_code_file")
def usage_scan(spark, d):
    facts = usage.usage_facts(view(spark, d, "d_code_file"))
    return usage.api_usage(_apis(spark, d), facts).select("api", "path", "line", "kind", "is_test")


@query(f"with {_FILES} z as (select 1) select 'shape' as attribute, path, 1 as line, 'potential' as kind, is_test from files where fact = 'attr'", "d_code_file")
def attr_scan(spark, d):
    asked = spark.createDataFrame([("shape",), ("dtype",)], "attribute string")
    return usage.attribute_usage(asked, usage.usage_facts(view(spark, d, "d_code_file"))).select("attribute", "path", "line", "kind", "is_test")


@query(_USAGE + ", a as (select distinct 'numpy.' || replace(p_name, ' ', '_') as api from part), r as (select api, max(case kind when 'confirmed' then 2 else 1 end) as rank from hits group by api) select a.api, case coalesce(r.rank, 0) when 2 then 'SCANNED_CONFIRMED' when 1 then 'SCANNED_POTENTIAL' else 'SCANNED_NOT_FOUND' end as status from a left join r on r.api = a.api", "d_code_file")
def usage_status(spark, d):
    apis = _apis(spark, d)
    hits = usage.api_usage(apis, usage.usage_facts(view(spark, d, "d_code_file"))).groupBy("api").agg(F.max(F.when(F.col("kind") == "confirmed", 2).otherwise(1)).alias("rank"))
    return apis.join(hits, "api", "left").select("api", usage.usage_status(F.col("rank"), F.lit(True)).alias("status"))


# ---- changes and what they add up to

_CHANGES = f"""src as (select package, version, l_orderkey, l_linenumber, line from d_note_line), {_TYPED}
u as (select api as uapi, case status_rank when 2 then 'SCANNED_CONFIRMED' when 1 then 'SCANNED_POTENTIAL' else 'SCANNED_NOT_FOUND' end as ustatus from d_usage),
ch as (select kd.*, coalesce(u.ustatus, 'SCANNED_NOT_FOUND') as status, {O.pick('kind', X.SEVERITIES, 'LOW')} as severity from kd left join u on u.uapi = kd.api where category in ({", ".join(map(O.q, X.RISK_CATEGORIES))})), """


def _changes(spark, d, scanned: bool = True):
    rows = view(spark, d, "d_note_line").withColumn("category", T.once(T.category(F.col("line"), F.lit(None).cast("string"))))
    if not scanned:
        return risk.build_changes(rows)
    p = _places(spark, d)
    hit = F.struct("path", F.lit(1).alias("line"), F.lit("x").alias("code"), F.lit("k").alias("kind"), F.lit("m").alias("detection_method"), "is_test")
    used = p.select("name", "is_attribute", "rank", F.lit(1).cast("long").alias("n_hits"), F.array(hit).alias("hits"))
    none = view(spark, d, "d_usage").where("status_rank = 0").select(F.col("api").alias("name"), F.lit(False).alias("is_attribute"), F.col("status_rank").alias("rank"), F.lit(0).cast("long").alias("n_hits"), F.lit(None).cast(used.schema["hits"].dataType).alias("hits"))
    return risk.build_changes(rows, used.union(none))


def _places(spark, d):
    path = F.concat(F.lit("src/"), F.substring_index("api", ".", -1), F.lit(".py"))
    return view(spark, d, "d_usage").where("status_rank > 0").select(F.col("api").alias("name"), F.lit(False).alias("is_attribute"), F.col("status_rank").alias("rank"), path.alias("path"), (F.col("n_files") % 2 == 0).alias("is_test"))


@query(f"with {_CHANGES} z as (select 1) select severity as baseline_severity, status as usage_status, {O.risk('severity', 'status')} as risk, count(*) as n from ch group by 1, 2, 3", "d_note_line", "d_usage")
def risk_matrix(spark, d):
    """The cells of the matrix that changes fall into, scanned."""
    rows = _changes(spark, d).select("baseline_severity", "usage_status")
    return rows.withColumn("risk", T.risk(F.col("baseline_severity"), F.col("usage_status"))).groupBy("baseline_severity", "usage_status", "risk").agg(F.count("*").alias("n"))


@query(f"with {_CHANGES} z as (select 1) select l_orderkey, l_linenumber, category, kind as change_type, api as affected_api, operation as affected_operation, replacement as replacement_api, confidence as extraction_confidence, severity as baseline_severity, status as usage_status, {O.risk('severity', 'status')} as risk, {O.title('api', 'operation', 'kind', 'category')} as title, {O.advice('kind', 'api', 'operation', 'replacement')} as recommendation from ch", "d_note_line", "d_usage")
def build_changes(spark, d):
    return _changes(spark, d).select(*_ID, "category", "change_type", "affected_api", "affected_operation", "replacement_api", "extraction_confidence", "baseline_severity", "usage_status", "risk", "title", "recommendation")


_STATUS = "case when bool_or(severity = 'HIGH' and status = 'SCANNED_CONFIRMED') then 'CRITICAL' when bool_or(severity = 'HIGH' and status = 'SCANNED_POTENTIAL') then 'MEDIUM' else 'LOW' end"


@query(f"with {_CHANGES} z as (select 1) select package, {_STATUS} as overall_status from ch group by package", "d_note_line", "d_usage")
def overall_status(spark, d):
    return risk.overall_status(_changes(spark, d), ["package"], True)


@query(f"with {_CHANGES} z as (select 1) select package, case when bool_or(severity = 'HIGH') then 'UNKNOWN' else 'LOW' end as overall_status from ch group by package", "d_note_line", "d_usage")
def overall_status_unscanned(spark, d):
    return risk.overall_status(_changes(spark, d, False), ["package"], False)


@query(f"with {_CHANGES} st as ({_RESOLVED[_RESOLVED.index('(') + 1 : _RESOLVED.rindex('),') ]}), a as (select package, cast(round_even(100.0 * count(notes_text) / count(*), 0) as integer) as retrieval from st group by 1), b as (select package, cast(round_even(100.0 * count(*) filter (where severity <> 'INFO' and confidence <> 'LOW') / count(*) filter (where severity <> 'INFO'), 0) as integer) as identification from ch group by 1) select a.package, retrieval, coalesce(identification, 100) as identification, 100 as project_scan, cast(round_even((retrieval + coalesce(identification, 100) + 100) / 3.0, 0) as integer) as overall from a left join b on b.package = a.package", "d_note_line", "d_usage", "d_candidate")
def confidence(spark, d):
    status = sources.resolve_source(view(spark, d, "d_candidate"), _NOTE_KEY).select("package", sources.note_status().alias("status"))
    return risk.confidence(status, _changes(spark, d), ["package"], True)


@query(f"with {_CHANGES} st as ({_RESOLVED[_RESOLVED.index('(') + 1 : _RESOLVED.rindex('),') ]}), a as (select package, cast(round_even(100.0 * count(notes_text) / count(*), 0) as integer) as retrieval from st group by 1), b as (select package, cast(round_even(100.0 * count(*) filter (where severity <> 'INFO' and confidence <> 'LOW') / count(*) filter (where severity <> 'INFO'), 0) as integer) as identification from ch group by 1) select a.package, retrieval, coalesce(identification, 100) as identification, 0 as project_scan, cast(round_even((retrieval + coalesce(identification, 100) + 0) / 3.0, 0) as integer) as overall from a left join b on b.package = a.package", "d_note_line", "d_usage", "d_candidate")
def confidence_unscanned(spark, d):
    status = sources.resolve_source(view(spark, d, "d_candidate"), _NOTE_KEY).select("package", sources.note_status().alias("status"))
    return risk.confidence(status, _changes(spark, d, False), ["package"], False)


@query(f"with {_CHANGES} fx as (select api as fapi, 'src/' || split_part(api, '.', 2) || '.py' as path, n_files % 2 = 0 as is_test from d_usage where status_rank > 0) select package, count(distinct case when status = 'SCANNED_CONFIRMED' then coalesce(api, operation) end) as confirmed_apis, count(distinct case when status = 'SCANNED_POTENTIAL' then coalesce(api, operation) end) as potential_apis, count(distinct case when not is_test then path end) as production_files, count(distinct case when is_test then path end) as test_files from ch left join fx on fx.fapi = ch.api group by package", "d_note_line", "d_usage")
def affected_counts(spark, d):
    return risk.affected_counts(_changes(spark, d), ["package"], _places(spark, d).drop("rank"))


@query(f"""with {_CHANGES} o as (select package, {_STATUS} as st, list({O.title('api', 'operation', 'kind', 'category')} order by l_orderkey, l_linenumber) filter (where severity = 'HIGH' and status = 'SCANNED_CONFIRMED') as c, list({O.title('api', 'operation', 'kind', 'category')} order by l_orderkey, l_linenumber) filter (where severity = 'HIGH' and status = 'SCANNED_POTENTIAL') as p from ch group by package)
select package, md5(case st when 'CRITICAL' then {O.q(chr(10).join(risk._VERDICTS["CRITICAL"]))} || list_reduce(list_prepend('', c), lambda a, t: a || chr(10) || '  - ' || t) when 'MEDIUM' then {O.q(chr(10).join(risk._VERDICTS["MEDIUM"]))} || list_reduce(list_prepend('', p), lambda a, t: a || chr(10) || '  - ' || t)
 else {O.q(chr(10).join(["✓ LOW RISK — NO DIRECT IMPACT DETECTED", "", "No confirmed usage of the identified breaking APIs was found.", "Environment and build requirements should still be verified."]))} end || chr(10) || chr(10) || 'Note: this release drops support for Python 3.7, 3.8. Verify your runtime.') as digest from o""", "d_note_line", "d_usage")
def verdict(spark, d):
    titles = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("baseline_severity") == "HIGH") & (F.col("usage_status") == s), F.struct(*_ID, "title")))), lambda x: x["title"])
    rows = _changes(spark, d).groupBy("package").agg(risk.status_of(True).alias("st"), titles("SCANNED_CONFIRMED").alias("c"), titles("SCANNED_POTENTIAL").alias("p"))
    return rows.select("package", F.md5(risk.verdict(F.col("st"), F.col("c"), F.col("p"), True, F.lit(["3.7", "3.8"]))).alias("digest"))


@query(f"""with {_CHANGES} o as (select package, bool_or(severity = 'HIGH' and l_orderkey % 3 = 0) as high from ch group by package)
select package, md5(case when high then {O.q(chr(10).join(risk._VERDICTS["UNKNOWN"]))} else {O.q(chr(10).join(["✓ LOW RISK — NO DIRECT IMPACT DETECTED", "", "No breaking, removed, or security-relevant changes were identified.", "Environment and build requirements should still be verified."]))} end) as digest from o""", "d_note_line", "d_usage")
def verdict_unscanned(spark, d):
    none = F.array().cast("array<string>")
    rows = _changes(spark, d, False).withColumn("baseline_severity", F.when(F.col("l_orderkey") % 3 == 0, F.col("baseline_severity")).otherwise("LOW")).groupBy("package").agg(risk.status_of(False).alias("st"))
    return rows.select("package", F.md5(risk.verdict(F.col("st"), none, none, False, none)).alias("digest"))


# ---- whole reports


def _inputs(spark, d, scanned: bool) -> upgrade.Inputs:
    lines = view(spark, d, "d_note_line").groupBy("ecosystem", "package", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("notes_text"))
    found = lines.withColumns({"kind": F.lit("CHANGELOG"), "url": F.concat(F.lit("https://example.org/"), "version"), "unavailable": F.lit(False), "cross_text": F.when(F.length("version") % 2 == 0, F.lit("Something else entirely")), "discrepancy": F.length("version") % 2 == 0})
    return upgrade.Inputs(view(spark, d, "d_request"), view(spark, d, "d_release"), found, _advisories(spark, d), registry.npm_deprecations(_npm_meta(spark, d)), view(spark, d, "d_code_file") if scanned else None)


@query()
def report_summary(spark, d):
    return upgrade.upgrade_reports(_inputs(spark, d, True)).select("package", "status", "report", "part")


@query()
def report_legacy(spark, d):
    return upgrade.upgrade_reports(_inputs(spark, d, False), legacy=True).select("package", "status", "report", "part")


# a text for every release, with the lines of its notes
_REPORTS = """select r.o_orderkey as request_id, 'Package: ' || r.package || ' (' || r.ecosystem || ')' || chr(10) || 'Version: ' || r.version || chr(10) || chr(10) || coalesce(n.lines, 'Nothing is known.') as report
 from d_release r left join (select l_orderkey, %s as lines from d_note_line group by l_orderkey) n on n.l_orderkey = r.o_orderkey"""
_REPORTS_SQL = _REPORTS % "string_agg('- ' || line, chr(10) order by l_linenumber)"


def _written(spark, d) -> str:
    """Reports of all releases, then those of every fifth one again."""
    path = scratch(spark, "reports")
    made = view(spark, d, "d_note_line", _REPORTS % "array_join(transform(array_sort(collect_list(struct(l_linenumber, line))), x -> '- ' || x.line), chr(10))")
    sinks.write_reports(made, path)
    sinks.write_reports(made.where("request_id % 5 = 0").withColumn("report", F.concat("report", F.lit("\nWritten again."))), path)
    return path


_LAST = f"select request_id, report || case when request_id % 5 = 0 then chr(10) || 'Written again.' else '' end as report from ({_REPORTS_SQL})"


@query(_LAST, "d_note_line")
def sink_report(spark, d):
    return sinks.read_reports(spark, _written(spark, d))


@query(f"select * from ({_LAST}) where request_id = 10", "d_note_line")
def sink_download(spark, d):
    return sinks.read_report(spark, _written(spark, d), 10)


def entry(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["bump_sequence"](spark, d)



