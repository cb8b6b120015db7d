"""Expressions in DuckDB's SQL, written beside the DataFrame operators and not from them; only fixed values are shared."""

from __future__ import annotations

from ..functions import fixed as X


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {q(pattern)})"


def sub(s: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({s}, {q(pattern)}, {q(to)}, {q(flags)})"


def got(s: str, pattern: str, i: int = 1) -> str:
    return f"regexp_extract({s}, {q(pattern)}, {i})"


def any_of(s: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({s}, {q(w)})" for w in words) + ")"


def strip(s: str) -> str:
    return sub(s, r"^\s+|\s+$")


#: Numbers are padded to a fixed width, so that they sort as strings.
_WIDE = 60
_ZERO = f"lpad('', {_WIDE}, '0')"


def key(v: str) -> str:
    # the local part has a pattern of its own, as RE2 functions count nine groups at most
    pattern = X.VERSION.replace(r"(?:\+([a-z0-9]+", r"(?:\+(?:[a-z0-9]+")
    g = lambda i: got(f"lower({v})", pattern, i)
    num = lambda s: f"lpad(ltrim({s}, '0'), {_WIDE}, '0')"
    rel = f"[{num('x')} for x in string_split({sub(g(2), r'([.]0+)+$')}, '.')]"
    dev = f"({g(8)} <> '')"
    post = f"case when {g(5)} <> '' then {num(g(5))} when {g(6)} <> '' then {num(g(7))} else '' end"
    pre = f"case when {g(3)} in ('a', 'alpha') then 0 when {g(3)} in ('b', 'beta') then 1 when {g(3)} <> '' then 2 when {dev} and {g(5)} = '' and {g(6)} = '' then -1 else 3 end"
    return f"case when {has(f'lower({v})', X.VERSION)} then {{'e': {num(g(1))}, 'r': {rel}, 'p': {pre}, 'pn': {num(g(4))}, 'post': {post}, 'd': case when {dev} then {num(g(9))} else 'none' end, 'l': {got(f"lower({v})", r"[+]([a-z0-9]+(?:[-_.][a-z0-9]+)*)\s*$")}}} end"


def prerelease(k: str) -> str:
    return f"({k}.p between 0 and 2 or {k}.d <> 'none')"


def bump(before: str, now: str) -> str:
    at = lambda k, i: f"coalesce({k}.r[{i}], {_ZERO})"
    return f"case when {prerelease(now)} then 'prerelease' when {at(now, 1)} <> {at(before, 1)} then 'major' when {at(now, 2)} <> {at(before, 2)} then 'minor' else 'patch' end"


#: Releases once each with their key, and requests with their path.
RELEASES = f"rel as (select *, {key('version')} as k from (select distinct ecosystem, package, version from d_release where n_files > 0)), "
PATH = (
    RELEASES
    + """pairs as (select q.*, a.k as ck, b.k as tk from d_request q join rel a on a.package = q.package and a.ecosystem = q.ecosystem and a.version = q.current_version
  join rel b on b.package = q.package and b.ecosystem = q.ecosystem and b.version = q.target_version where a.k < b.k),
steps as (select p.package, p.ecosystem, p.current_version, p.ck, r.version, r.k, row_number() over (partition by p.package order by r.k, r.version) as step
  from pairs p join rel r on r.package = p.package and r.ecosystem = p.ecosystem where r.k > p.ck and r.k <= p.tk and not """
    + prerelease("r.k")
    + "), "
)


def noise(s: str) -> str:
    low = f"lower({s})"
    tests = [any_of(low, X.IGNORED), *(has(s, p) for p in (X.NOISE_CODE, X.NOISE_IMPORT, X.NOISE_DIRECTIVE, X.ANY_DIRECTIVE, X.PURE_REFERENCE, X.PURE_LINK, X.ONLY_SIGNS)), has(low, X.GH_REFERENCE), f"length({s}) < 3", f"{low} in ('ok', 'ok.', 'yes', 'no')", continuation(s), f"length({strip(sub(s, X.REFERENCES))}) < 8"]
    return "(" + " or ".join(tests) + ")"


def continuation(s: str) -> str:
    return any_of(f"lower({s})", X.CONTINUATIONS)


def noise_fragment(s: str) -> str:
    return f"({continuation(s)} or {has(s, X.ERROR_PLACE)} or {has(strip(s), X.DANGLING)})"


def meaningful(s: str) -> str:
    low = f"lower({s})"
    return f"(not {noise(s)} and ({has(low, X.MEANINGFUL_VERBS)} or {has(low, X.API_TOKEN)} or {has(low, X.DOTTED_TOKEN)}))"


def category(s: str, section: str) -> str:
    low, sec = f"lower({s})", f"lower(coalesce({section}, ''))"
    dep = f"case when {has(low, X.EXPIRED_WORDS)} then 'Expired Deprecations' else 'New Deprecations' end"
    rules = [
        (has(low, r"\bbreaking change\b"), "'Breaking Changes'"), (any_of(sec, ["expired deprecation"]), "'Expired Deprecations'"), (any_of(sec, ["breaking changes"]), "'Breaking Changes'"), (any_of(sec, ["deprecations"]), dep),
        (has(low, r"\bexpired deprecations?\b"), "'Expired Deprecations'"), (has(low, X.REMOVAL_WORDS), "'Expired Deprecations'"), (has(low, r"\bdeprecat"), dep),
        (has(low, X.COMPATIBILITY_WORDS), f"case when {has(low, X.BUILD_WORDS)} then 'Build / Toolchain Changes' else 'Compatibility Changes' end"),
        (has(low, X.DESCENDING_WORDS), "'New Features'"), (has(low, X.SPEED_WORDS), "'Performance Improvements'"), *((any_of(low, w), q(c)) for c, w in X.CATEGORIES),
    ]
    return "case " + " ".join(f"when {a} then {b}" for a, b in rules) + f" else {q(X.OTHER)} end"


def word_set(s: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({s}), '[\\p{{L}}\\p{{N}}_]+'))"


def dedup_key(s: str) -> str:
    return f"substr({sub(f'lower({s})', '[^\\p{L}\\p{N}_]+')}, 1, 100)"


def api_name(s: str) -> str:
    n = sub(sub(sub(strip(s), "^[`\"']+|[`\"']+$"), r"[(\[].*$"), "[.,:;]+$")
    return f"(select case when n = '' or lower(n) in ('e.g', 'i.e', 'etc') or contains(n, '/') or contains(n, ' ') or {has('lower(n)', X.API_FILE_ENDINGS)} then null else n end from (select case when starts_with(m, 'np.') then 'numpy' || substr(m, 3) else m end as n from (select {n} as m)))"


def api_names(s: str) -> str:
    """All candidates, in order; names in notes need no more than the prefix made long and trailing dots cut."""
    raw = f"regexp_extract_all({s}, {q(X.API_NAME)}, 1)"
    n = f"[regexp_replace(x, '^np[.]', 'numpy.') for x in {raw}]"
    return f"list_filter({n}, lambda x, i: list_position([lower(y) for y in {n}], lower(x)) = i)"


def before(s: str, pattern: str) -> str:
    return f"case when {has(s, '(?i)' + pattern)} then {got(s, '(?is)^(.*?)' + pattern)} else {s} end"


def subject(s: str) -> str:
    return strip(before(s, X.ALTERNATIVE))


def alternative(s: str) -> str:
    return f"case when {has(s, '(?i)' + X.ALTERNATIVE)} then {strip(f'substr({s}, length({before(s, X.ALTERNATIVE)}) + 1)')} else '' end"


def citations(s: str) -> str:
    return sub(sub(s, "(?i)" + X.CITATIONS), r"\s+$")


def markup(s: str) -> str:
    for p in (X.ROLE, X.HYPERLINK, X.BACKTICKS):
        s = sub(s, p, r"\1")
    return s


def short(s: str, n: int) -> str:
    return f"(select case when length(z) > {n} then {sub(f'substr(z, 1, {n - 3})', r'\s+$')} || '...' else z end from (select {s} as z))"


def operation(sub_: str) -> str:
    attr = got(sub_, "(?i)" + X.ATTRIBUTE)
    phrase = citations(sub(markup(strip(before(sub_, X.VERB_BOUNDARY))), "[,:;]+$"))
    return f"case when {attr} <> '' then {attr} || ' attribute assignment' else nullif({short(phrase, 90)}, '') end"


#: subj(api, operation, replacement, confidence, attribute) of rows src(line).
SUBJECTS = f"""s1 as (select *, {subject('line')} as sc, {alternative('line')} as ac from src),
s2 as (select *, {api_names('sc')}[1] as api, {api_names('ac')}[1] as rep1, {sub(got('line', '(?i)' + X.REPLACEMENT), '[.,;:]+$')} as rep2, nullif({got('sc', '(?i)' + X.ATTRIBUTE)}, '') as attr from s1),
s3 as (select *, case when api is null then {operation('sc')} end as operation from s2),
subj as (select *, coalesce(rep1, case when rep2 <> '' and lower(rep2) not in ('a', 'an', 'the', 'it', 'this') then rep2 end) as replacement,
  case when api is not null then 'HIGH' when operation is not null then 'MEDIUM' else 'LOW' end as confidence, case when api is null then attr end as attribute from s3), """


def pick(s: str, table: dict[str, str], otherwise: str) -> str:
    return f"case {s} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {q(otherwise)} end"


def change_type(cat: str, s: str) -> str:
    base = pick(cat, X.CHANGE_TYPES, "OTHER")
    return f"case when {base} = 'REMOVAL' and not {has(f'lower({s})', r'\bremov')} and {has(f'lower({s})', r'\bdeprecat')} then 'DEPRECATION' else {base} end"


def risk(sev: str, usage: str) -> str:
    cells = " ".join(f"when {sev} = {q(s)} and {usage} = {q(u)} then {q(r)}" for s, row in X.RISKS.items() for u, r in zip(X.USAGE, row, strict=True))
    return f"case {cells} else {sev} end"


def title(api: str, op: str, kind: str, cat: str) -> str:
    s = f"coalesce({api}, {op}, 'Unspecified change')"
    label = f"case when {cat} = 'Expired Deprecations' then 'deprecation expired' else 'deprecated' end"
    return f"case when {kind} = 'DEPRECATION' then case when {api} is not null then {s} || ' ' || {label} else {s} || ' (' || {label} || ')' end when {api} is null then {s} when {kind} = 'REMOVAL' then {s} || ' removed' when {kind} in ('BEHAVIOR_CHANGE', 'COMPATIBILITY_CHANGE') then {s} || ' behavior changed' else {s} end"


def advice(kind: str, api: str, op: str, rep: str) -> str:
    s = f"coalesce({api}, {op})"
    return f"""case when {kind} = 'REMOVAL' then coalesce('Replace with ' || {rep} || '.', 'Remove or update any usage of ' || {s} || ' before upgrading.', 'Review and update this change before upgrading.')
 when {kind} = 'DEPRECATION' then coalesce('Migrate to ' || {rep} || ' before this is removed in a future release.', 'Plan to migrate away from ' || {s} || '; it will be removed in a future release.', 'Review this deprecation and plan a migration path.')
 when {kind} in ('BEHAVIOR_CHANGE', 'COMPATIBILITY_CHANGE') then 'Review any code relying on the previous behavior, and test after upgrading.' when {kind} = 'SECURITY' then 'Upgrade promptly; this addresses a security issue.' else 'Review this change before upgrading.' end"""
