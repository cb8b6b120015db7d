"""Domain tables derived from the driver's tables; the same text runs in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"]

VIEWS = {
    "d_release": """
select o_orderkey, case when o_custkey % 2 = 0 then 'pypi' else 'npm' end as ecosystem,
 'pkg' || lpad(cast(o_custkey % 40 as string), 2, '0') as package,
 cast(year(o_orderdate) - 1990 as string) || '.' || cast(month(o_orderdate) as string) || '.' || cast(o_orderkey % 10 as string)
 || case o_orderpriority when '1-URGENT' then 'rc1' when '2-HIGH' then 'b2' else '' end as version,
 case when o_orderstatus = 'P' and o_orderkey % 7 = 0 then 0 else 1 end as n_files, o_orderdate from orders""",
    "d_request": """
select package, min(ecosystem) as ecosystem,
 min_by(version, o_orderkey) filter (where year(o_orderdate) = 1995 and version not like '%rc1' and version not like '%b2') as current_version,
 min_by(version, o_orderkey) filter (where year(o_orderdate) = 2000 and version not like '%rc1' and version not like '%b2') as target_version
 from d_release group by package""",
    "d_note_line": """
select r.ecosystem, r.package, r.version, x.l_orderkey, x.l_linenumber, case x.k
 when 0 then 'Fixed a crash in ' || nm when 1 then 'numpy.' || nm || ' has been removed in favor of numpy.' || lower(p_type) || '. (deprecated since 2.0) (gh-' || cast(x.l_orderkey as string) || ')'
 when 2 then 'Breaking change: removed ' || nm when 3 then 'Fixed a security vulnerability in ' || nm when 4 then 'Added support for ' || nm
 when 5 then 'Updated the README for ' || nm when 6 then 'Improved performance of ' || nm when 7 then 'numpy.' || nm || ' is deprecated; use numpy.' || lower(p_type) || ' instead.'
 when 8 then 'Thanks to @dev for ' || nm when 9 then 'Fixed incorrect handling in ' || nm when 10 then 'Requires Python 3.12 for ' || nm
 else 'Setting the ' || nm || ' attribute is deprecated. As an alternative, you can use np.' || lower(p_type) || '.' end as line
 from (select l.l_orderkey, l.l_linenumber, (l.l_orderkey * 7 + l.l_linenumber) % 12 as k, p.p_type, replace(p.p_name, ' ', '_') as nm
  from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey from lineitem group by l_orderkey, l_linenumber) l
  join part p on l.l_partkey = p.p_partkey) x join d_release r on r.o_orderkey = x.l_orderkey""",
    "d_changelog": """
select package, row_number() over (partition by package order by version, ord, l_orderkey, l_linenumber) as pos, line from (
 select distinct package, version, 0 as ord, cast(0 as bigint) as l_orderkey, 0 as l_linenumber, '## ' || version as line from d_release
 union all select package, version, 1, l_orderkey, l_linenumber, '- ' || line from d_note_line)""",
    "d_advisory": """
select 'GHSA-' || lpad(cast(s_suppkey as string), 4, '0') as ghsa_id, case when s_suppkey % 2 = 0 then 'pip' else 'npm' end as ecosystem,
 'PKG' || lpad(cast(s_suppkey % 40 as string), 2, '0') as name,
 case s_suppkey % 5 when 4 then 'all versions' when 3 then '= 7.' || cast(s_nationkey % 12 + 1 as string) || '.3'
  else '>= 6.' || cast(s_nationkey % 12 + 1 as string) || '.0, < 8.1.0' end as vulnerable_range,
 case s_nationkey % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end as severity from supplier""",
    "d_candidate": """
select r.ecosystem, r.package, r.version, k.prio, k.kind, case when (r.o_orderkey * 3 + k.prio * 5) % 4 = 0 then null when k.prio = 2 and r.o_orderkey % 3 = 0 then 'wholly unlike words here' else k.kind || ' text for ' || r.version end as notes_text,
 k.prio in (2, 4) and (r.o_orderkey * 3 + k.prio * 5) % 4 = 0 and r.o_orderkey % 11 = 0 as had_error
 from (select ecosystem, package, version, min(o_orderkey) as o_orderkey from d_release group by ecosystem, package, version) r
 cross join (select 1 as prio, 'known_adapter' as kind union all select 2, 'github_release' union all select 3, 'changelog' union all select 4, 'commits') k""",
    "d_code_file": """
select case p_size % 5 when 0 then '.venv/lib/' when 1 then 'tests/' when 2 then 'node_modules/' else 'src/' end || 'm' || cast(p_partkey as string) || case when p_size % 7 = 0 then '.rst' else '.py' end as path,
 case p_partkey % 4 when 0 then 'import numpy as np' || chr(10) || 'np.' || replace(p_name, ' ', '_') || '(x)' when 1 then 'from numpy import *' || chr(10) || replace(p_name, ' ', '_') || '(x)'
  when 2 then '# np.' || replace(p_name, ' ', '_') else 'arr.shape = (1, 2)' end as content from part""",
    "d_usage": """
select 'numpy.' || replace(p_name, ' ', '_') as api, max(case p_partkey % 4 when 0 then 2 when 1 then 1 else 0 end) as status_rank, count(*) as n_files from part where p_size % 3 = 0 group by 1""",
    # a landed text for every adapter, package and version, prereleases too: some blank, some under the second branch;
    # each package has a repository of its own for every adapter
    "d_landed_file": """
select v.package || '/' || a.adapter as repo, case when v.n % 3 = 0 then 'master' else 'main' end as branch,
 replace(replace(replace(a.template, '{v}', v.version), '{maj}', split_part(v.version, '.', 1)), '{min}', split_part(v.version, '.', 2)) as path, v.version,
 case when v.n % 5 = 0 then '   ' when a.mode = 'directive' then '.. changelog::' || chr(10) || '    :version: ' || v.version || chr(10) || '    :released: x' || chr(10) || '    .. change::' || chr(10) || '        :tags: bug' || chr(10) || '        Fixed ' || v.version
  when a.mode = 'section' then '# Notes' || chr(10) || '## ' || v.version || ' (x)' || chr(10) || '- Added ' || v.version || chr(10) || '## 0.0.1' || chr(10) || '- old'
  else 'Notes of ' || v.version end as text
 from d_adapter a cross join (select package, version, min(o_orderkey) as n from d_release group by package, version) v""",
    # one name in both registries; some of them are kept in one repository
    "d_release_both": """
select o_orderkey, case when o_orderkey % 3 = 0 then case ecosystem when 'pypi' then 'npm' else 'pypi' end else ecosystem end as ecosystem, package, version, n_files,
 case when package like 'pkg0%' then 'org' else case when o_orderkey % 3 = 0 then case ecosystem when 'pypi' then 'npm' else 'pypi' end else ecosystem end end || '/' || package as repo from d_release""",
    # four attempts at two tags and a comparison of every version: no network, a rate limit, late answers, answers without text, answers that came too late
    "d_attempt": """
select source, repo, request, attempt, case when c in (2, 5) and attempt < case c when 2 then 2 else 4 end then null when c = 0 then null when c = 1 or c = 7 then 403 when c = 3 then 404 when c = 6 then 500 else 200 end as status,
 case when c = 1 then 'API rate limit exceeded' when c = 7 then 'forbidden' when c in (3, 6) then '' when source = 'release' then '{"body": "' || case c when 4 then '  ' else 'Notes of ' || request end || '"}'
  when c = 4 then '{"commits": []}' else '{"commits": [{"commit": {"message": "first of ' || request || '"}}]}' end as body
 from (select k.source, v.repo, case k.i when 1 then v.version when 2 then 'v' || v.version else 'v0...v' || v.version end as request, k.attempt, (v.n + 3 * k.i) % 8 as c
  from (select repo, version, min(o_orderkey) as n from d_release_both group by repo, version) v
  cross join (select i.i, a.attempt, case when i.i = 3 then 'compare' else 'release' end as source from (select 1 as i union all select 2 union all select 3) i cross join (select 1 as attempt union all select 2 union all select 3 union all select 4) a) k) x""",
}
#: Which views a view reads.
NEEDS = {"d_release_both": ["d_release"], "d_attempt": ["d_release_both"], "d_request": ["d_release"], "d_note_line": ["d_release"], "d_changelog": ["d_release", "d_note_line"], "d_candidate": ["d_release"], "d_landed_file": ["d_release"]}


def needed(*names: str) -> list[str]:
    """The views and those that they read, in order of use."""
    out: list[str] = []
    for n in names:
        for m in [*needed(*NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def view(spark: SparkSession, sf_dir: str, name: str, select: str | None = None, extra: str = "") -> DataFrame:
    """One derived table, or a query over it; only its own inputs are read, and only their needed columns.

    extra: further common table expressions that the views read. No view is registered in the session."""
    tables = [t for t in TABLES if any(f" {t}" in VIEWS[n] for n in needed(name))]
    parts = [extra] if extra else []
    parts += [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in tables]
    parts += [f"{n} as ({VIEWS[n]})" for n in needed(name)]
    return spark.sql(f"with {', '.join(parts)} {select or f'select * from {name}'}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str, extra: str = "") -> str:
    """DuckDB text: the views as common table expressions, then sql, which may begin with further ones."""
    ctes = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed(*names))
    parts = ", ".join(x for x in (extra, ctes) if x)
    sql = sql.strip()
    return f"with {parts}, {sql[5:]}" if sql.lower().startswith("with ") else f"with {parts} {sql}"
