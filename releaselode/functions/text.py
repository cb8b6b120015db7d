"""Columns over lines of release notes: white space, noise, classes, names and phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def let(value: Column, body) -> Column:
    """body(value) with the value standing, and computed, once.

    Not an item of a transformed array: taking an item derives the array's type for every row, through all bodies within it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def once(value: Column) -> Column:
    """A column whose value is computed once for a row: filters on a column are pushed below it and would compute it again, but not below a generated one."""
    return F.explode(F.array(value))


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(s, F.lit(X.WHITE_SPACE))


def rstrip(s: Column) -> Column:
    return F.rtrim(s, F.lit(X.WHITE_SPACE))


def _stripped(x: Column) -> Column:
    """strip() of a bound text. Between visible ASCII characters there is nothing to strip, and to see that costs less than trimming, which looks up characters in a list."""
    visible = lambda c: (c >= "!") & (c <= "~")
    return F.when((x >= "!") & (x < "\x7f") & let(F.substring(x, -1, 1), visible), x).otherwise(strip(x))


def text_lines(text: Column) -> Column:
    """array<string>; a line ends with any of the Unicode line boundaries, and the last one opens no empty line."""
    parts = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def contains_any(s: Column, words: list[str]) -> Column:
    """One expression however many words, so that generated code stays small."""
    return let(s, lambda x: _holds_any(x, words))


#: Parts that several words share, in order of preference; each search reads the whole text, so one that fails for a part stands for all its words.
_PARTS = [
    "breaking", "incompatible", "no longer", "remov", "support", "test", "this ", "yp", "ow", "performance", "reduce", "vulnerab", "ython", "compatib", "feature", "config", "orm", "co", "thank", "ac", "se ",
    "me", "lin", "ul", "mp", "ch", "al", "for", "e ",
]


def shared_parts(words: list[str]) -> dict[str, list[str]]:
    """What to look for, with the words that can only stand where it does: [] for a word by itself. A word that holds another one of them decides nothing."""
    least = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    out: dict[str, list[str]] = {}
    for part in _PARTS:
        of = [w for w in least if part in w]
        if len(of) > 1:
            out[part] = of
            least = [w for w in least if w not in of]
    return out | {w: [] for w in least}


def _holds_any(x: Column, words: list[str]) -> Column:
    """The same where x is bound already."""

    def one(part: str, of: list[str]) -> Column:
        there = F.contains(x, F.lit(part))
        return there & F.exists(F.lit(of), lambda w: F.contains(x, w)) if of else there

    return reduce(Column.__or__, (one(part, of) for part, of in shared_parts(words).items()))


def _matches(x: Column, pattern: str, *parts: str) -> Column:
    """x.rlike(pattern), which is only tried where x holds one of parts; every match must hold one."""
    return _has(x, parts) & x.rlike(pattern)


def _has(x: Column, parts) -> Column:
    return reduce(Column.__or__, (F.contains(x, F.lit(p)) for p in parts))


def clean_markup(s: Column) -> Column:
    def of(x: Column) -> Column:
        out = x
        for pattern in (X.ROLE, X.HYPERLINK, X.BACKTICKS):
            out = F.regexp_replace(out, pattern, "$1")
        return F.when(F.contains(x, F.lit("`")), out).otherwise(x)

    return let(s, of)


def is_continuation(line: Column) -> Column:
    return contains_any(F.lower(line), X.CONTINUATIONS)


#: One pattern for all that hold at a line's start, so that it is tried at one place only.
_NOISE_START = "^(?:" + "|".join(p.removeprefix("^") for p in (X.NOISE_CODE, X.NOISE_IMPORT, X.NOISE_DIRECTIVE, X.ANY_DIRECTIVE, X.PURE_REFERENCE, X.PURE_LINK, X.ONLY_SIGNS)) + ")"


#: Eight characters at least, without white space at the ends; of these nothing has to be stripped.
_EIGHT = f"^[^{X.WHITE_SPACE}](?s:.{{6,}})[^{X.WHITE_SPACE}]\\z"


def _noise(x: Column, low: Column) -> Column:
    """x and low are bound."""
    out = (F.length(x) < 3) | x.rlike(_NOISE_START) | low.isin("ok", "ok.", "yes", "no") | _holds_any(low, [*X.IGNORED, *X.CONTINUATIONS])
    out = out | ((low.startswith("gh-") | low.startswith("(gh-")) & low.rlike(X.GH_REFERENCE))
    referring = F.contains(x, F.lit("#")) | F.contains(x, F.lit("://"))
    rest = F.when(referring, F.regexp_replace(x, X.REFERENCES, "")).otherwise(x)
    return out | let(rest, lambda r: ~r.rlike(_EIGHT) & (F.length(strip(r)) < 8))


def _with_lower(line: Column, body) -> Column:
    return let(line, lambda x: let(F.lower(x), lambda low: body(x, low)))


def is_noise(line: Column) -> Column:
    return _with_lower(line, _noise)


def is_noise_fragment(line: Column) -> Column:
    return is_continuation(line) | line.rlike(X.ERROR_PLACE) | strip(line).rlike(X.DANGLING)


def is_meaningful(line: Column) -> Column:
    def of(x: Column, low: Column) -> Column:
        named = F.contains(low, F.lit(".")) & (low.rlike(X.API_TOKEN) | low.rlike(X.DOTTED_TOKEN))
        return (low.rlike(X.MEANINGFUL_VERBS) | named) & ~_noise(x, low)

    return _with_lower(line, of)


def category_of_lower(low: Column, sec: Column) -> Column:
    """First rule that holds for a line and its section, both in lower case; the section outranks the words. Both are bound, or columns of the input."""
    by_deprecation = F.when(_matches(low, X.EXPIRED_WORDS, "deprecated"), "Expired Deprecations").otherwise("New Deprecations")
    out = (
        F.when(_matches(low, r"\bbreaking change\b", "breaking change"), "Breaking Changes")
        .when(F.contains(sec, F.lit("expired deprecation")), "Expired Deprecations")
        .when(F.contains(sec, F.lit("breaking changes")), "Breaking Changes")
        .when(F.contains(sec, F.lit("deprecations")), by_deprecation)
        .when(_matches(low, r"\bexpired deprecations?\b", "expired deprecation"), "Expired Deprecations")
        .when(_matches(low, X.REMOVAL_WORDS, "remov", "no longer support", "expired deprecation"), "Expired Deprecations")
        .when(_matches(low, r"\bdeprecat", "deprecat"), by_deprecation)
        .when(_matches(low, X.COMPATIBILITY_WORDS, "overflowerror", "behavior", "compatib", "support dropped", "ython", "toolchain", "msvc"), F.when(low.rlike(X.BUILD_WORDS), "Build / Toolchain Changes").otherwise("Compatibility Changes"))
        .when(_matches(low, X.DESCENDING_WORDS, "descending"), "New Features")
        .when(_matches(low, X.SPEED_WORDS, "search", "cache locality", "faster", "speedup", "performance", "optimiz"), "Performance Improvements")
    )
    for name, words in X.CATEGORIES:
        out = out.when(_holds_any(low, words), name)
    return out.otherwise(X.OTHER)


def category(line: Column, section: Column) -> Column:
    # both texts stand once, and the chain is one call in the generated code
    return let(F.struct(F.lower(line).alias("low"), F.lower(F.coalesce(section, F.lit(""))).alias("sec")), lambda x: category_of_lower(x["low"], x["sec"]))


def strip_section(text: Column) -> Column:
    """struct<text, section>: a trailing ' [Section: ...]' apart from the line; null where there is none."""
    pattern = r"^(.*?)\s*\[Section:\s*(.+?)\]\s*$"

    def of(x: Column) -> Column:
        def parts(found: Column) -> Column:
            return F.struct(strip(F.when(found, F.regexp_extract(x, pattern, 1)).otherwise(x)).alias("text"), F.when(found, strip(F.regexp_extract(x, pattern, 2))).alias("section"))

        return let(_matches(x, pattern, "[Section:"), parts)

    return let(text, of)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def disagree(a: Column, b: Column) -> Column:
    """Whether two texts share less than 15 % of their words; false where one has none."""
    x, y = word_set(a), word_set(b)
    return F.coalesce((F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) < 0.15), F.lit(False))


def dedup_key(line: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_]+", ""), 1, 100)


# ---- names of interfaces


def api_name(name: Column) -> Column:
    def checked(n: Column) -> Column:
        low = F.lower(n)
        bad = (n == "") | low.isin("e.g", "i.e", "etc") | F.contains(n, F.lit("/")) | F.contains(n, F.lit(" ")) | low.rlike(X.API_FILE_ENDINGS)
        return F.when(~bad, n)

    n = F.regexp_replace(strip(name), r"^[`\"']+|[`\"']+$", "")
    n = F.regexp_replace(F.regexp_replace(n, r"[(\[].*$", ""), r"[.,:;]+$", "")
    return let(F.regexp_replace(n, r"^np\.", "numpy."), checked)


#: X.API_NAME, but what stands before a name is looked at only where the name begins.
_API_NAME = r"((?<![A-Za-z0-9_])(?:np|numpy)(?:\.[A-Za-z_][A-Za-z0-9_]*)+)"


def _matched_name(n: Column) -> Column:
    """api_name() of what _API_NAME matches, but for endings of files: there is nothing else in it to cut or to refuse."""
    return F.when(n.startswith("np."), F.concat(F.lit("numpy."), F.substring(n, F.lit(4), F.length(n)))).otherwise(n)


def _found_names(x: Column) -> Column:
    """Names in a text, with repetitions."""
    return F.filter(F.transform(F.regexp_extract_all(x, F.lit(_API_NAME), F.lit(1)), _matched_name), lambda n: ~F.lower(n).rlike(X.API_FILE_ENDINGS))


def _may_name(x: Column) -> Column:
    """Most lines name nothing."""
    return _has(x, ("np.", "numpy."))


def _first_name(x: Column) -> Column:
    return F.when(_may_name(x), F.get(_found_names(x), F.lit(0)))


def api_names(text: Column) -> Column:
    """Names in order; of those that differ by case only, the first spelling."""
    first = lambda lows: lambda x, i: F.array_position(lows, F.lower(x)) == i + 1

    def of(x: Column) -> Column:
        names = let(_found_names(x), lambda f: F.when(F.size(f) < 2, f).otherwise(let(F.transform(f, F.lower), lambda lows: F.filter(f, first(lows)))))
        # null stays null
        return F.when(~_may_name(x), F.array().cast("array<string>")).otherwise(names)

    return let(text, of)


#: Of these, in lower case, every match of the pattern holds one.
_REPLACING = ("use", "in favor of", "replaced by", "migrate to")
_ALTERNATING = (*_REPLACING, "as an alternative", "you can ")
_VERBS = ("deprecated", "removed", "no longer support")


#: The characters that matches begin with are looked at before whether a word begins there.
_ALTERNATIVE = f"(?i)(?=[aiurmsy]){X.ALTERNATIVE}"
_VERB_BOUNDARY = f"(?i)(?=[ihawn]){X.VERB_BOUNDARY}"


def _cut_at(x: Column, low: Column, pattern: str, parts: tuple[str, ...], cut, whole: Column) -> Column:
    """cut(at) with the place of the first match; whole where there is none. x and low are bound."""
    return F.when(_has(low, parts), let(F.regexp_instr(x, F.lit(pattern)), lambda at: F.when(at > 0, cut(at)).otherwise(whole))).otherwise(whole)


def _before(x: Column, at: Column) -> Column:
    return let(F.substring(x, F.lit(1), at - 1), _stripped)


def _after(x: Column, at: Column) -> Column:
    return let(F.substring(x, at, F.length(x)), _stripped)


def subject_clause(text: Column) -> Column:
    return _with_lower(text, lambda x, low: _cut_at(x, low, _ALTERNATIVE, _ALTERNATING, lambda at: _before(x, at), _stripped(x)))


def alternative_clause(text: Column) -> Column:
    return _with_lower(text, lambda x, low: _cut_at(x, low, _ALTERNATIVE, _ALTERNATING, lambda at: _after(x, at), F.lit("")))


def strip_citations(text: Column) -> Column:
    return let(text, lambda x: rstrip(F.when(F.contains(x, F.lit("(")), F.regexp_replace(x, f"(?i){X.CITATIONS}", "")).otherwise(x)))


def _attribute(s: Column, low: Column) -> Column:
    """s and low are bound."""
    name = F.regexp_extract(s, f"(?i){X.ATTRIBUTE}", 1)
    return F.when(F.contains(low, F.lit("setting the")), let(name, lambda a: F.when(a != "", a)))


def attribute_name(subject: Column) -> Column:
    return _with_lower(subject, _attribute)


def shortened(s: Column, most: int) -> Column:
    return F.when(F.length(s) > most, F.concat(rstrip(F.substring(s, 1, most - 3)), F.lit("..."))).otherwise(s)


def _operation(s: Column, low: Column, attr: Column) -> Column:
    """s, low and attr are bound; s is stripped."""

    def phrase(x: Column) -> Column:
        marked = _has(x, ("`", "(")) | x.endswith(",") | x.endswith(":") | x.endswith(";")
        clean = F.when(marked, strip_citations(F.regexp_replace(clean_markup(x), r"[,:;]+$", ""))).otherwise(x)
        return let(clean, lambda p: F.when(p != "", shortened(p, 90)))

    before = _cut_at(s, low, _VERB_BOUNDARY, _VERBS, lambda at: _before(s, at), s)
    return F.when(attr.isNotNull(), F.concat(attr, F.lit(" attribute assignment"))).otherwise(let(before, phrase))


def operation_and_attribute(subject: Column) -> Column:
    """struct<operation, attribute> of a stripped subject clause."""
    of = lambda s, low, attr: F.struct(_operation(s, low, attr).alias("operation"), attr.alias("attribute"))
    return _with_lower(subject, lambda s, low: let(_attribute(s, low), lambda attr: of(s, low, attr)))


def operation_phrase(subject: Column) -> Column:
    return _with_lower(let(subject, _stripped), lambda s, low: let(_attribute(s, low), lambda attr: _operation(s, low, attr)))


def change_subject(text: Column) -> Column:
    """struct<api, operation, replacement, confidence, attribute>. An interface is only taken from the subject clause."""

    def of_text(x: Column, low: Column) -> Column:
        words = F.regexp_replace(F.regexp_extract(x, f"(?i){X.REPLACEMENT}", 1), r"[.,;:]+$", "")
        named = lambda w: F.when((w != "") & ~F.lower(w).isin("a", "an", "the", "it", "this"), w)
        other = F.when(_has(low, _REPLACING), let(words, named))

        def of_clauses(subject: Column, replacement: Column) -> Column:
            def whole(api: Column, phrase: Column) -> Column:
                operation = phrase["operation"]
                sure = F.when(api.isNotNull(), "HIGH").when(operation.isNotNull(), "MEDIUM").otherwise("LOW")
                return F.struct(api.alias("api"), operation.alias("operation"), replacement.alias("replacement"), sure.alias("confidence"), phrase["attribute"].alias("attribute"))

            return let(_first_name(subject), lambda api: let(F.when(api.isNull(), operation_and_attribute(subject)), lambda phrase: whole(api, phrase)))

        clauses = lambda subject, replacement: F.struct(subject.alias("subject"), replacement.alias("replacement"))
        cut = lambda at: clauses(_before(x, at), F.coalesce(let(_after(x, at), _first_name), other))
        # without a word of an alternative there is no replacement either
        split = F.when(_has(low, _ALTERNATING), let(F.regexp_instr(x, F.lit(_ALTERNATIVE)), lambda at: F.when(at > 0, cut(at)).otherwise(clauses(_stripped(x), other)))).otherwise(clauses(_stripped(x), F.lit(None).cast("string")))
        return let(split, lambda c: let(c["subject"], lambda subject: of_clauses(subject, c["replacement"])))

    return _with_lower(text, of_text)


# ---- kinds, behaviour, advice


def _lookup(key: Column, table: dict[str, str], otherwise: str) -> Column:
    """A constant map; the key stands in the expression once."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(otherwise))


def change_type(cat: Column, text: Column) -> Column:
    return change_type_of_lower(cat, F.lower(text))


def change_type_of_lower(cat: Column, low: Column) -> Column:
    base = _lookup(cat, X.CHANGE_TYPES, "OTHER")
    return F.when((base == "REMOVAL") & ~_matches(low, r"\bremov", "remov") & _matches(low, r"\bdeprecat", "deprecat"), "DEPRECATION").otherwise(base)


def severity(kind: Column) -> Column:
    return _lookup(kind, X.SEVERITIES, "LOW")


def risk(sev: Column, usage: Column) -> Column:
    cells = {f"{s}/{u}": r for s, row in X.RISKS.items() for u, r in zip(X.USAGE, row, strict=True)}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in cells.items() for x in kv)), F.concat(sev, F.lit("/"), usage)), sev)


def behaviour(text: Column, kind: Column, which: int) -> Column:
    """Old (1) or new (2) behaviour, from 'Previously, X. Now, Y.'"""
    found = strip(F.regexp_extract(text, f"(?is){X.PREVIOUSLY_NOW}", which))
    return F.when(kind.isin("BEHAVIOR_CHANGE", "COMPATIBILITY_CHANGE") & text.rlike(f"(?is){X.PREVIOUSLY_NOW}"), shortened(found, 150))


def change_title(api: Column, operation: Column, kind: Column, cat: Column) -> Column:
    subject = F.coalesce(api, operation, F.lit("Unspecified change"))
    label = F.when(cat == "Expired Deprecations", "deprecation expired").otherwise("deprecated")
    named = F.when(kind == "REMOVAL", F.concat(subject, F.lit(" removed"))).when(kind == "DEPRECATION", F.concat_ws(" ", subject, label)).when(kind.isin("BEHAVIOR_CHANGE", "COMPATIBILITY_CHANGE"), F.concat(subject, F.lit(" behavior changed"))).otherwise(subject)
    return F.when(api.isNotNull(), named).when(kind == "DEPRECATION", F.concat(subject, F.lit(" ("), label, F.lit(")"))).otherwise(subject)


def is_quoted(kind: Column) -> Column:
    """Whether a recommendation quotes the subject of the change."""
    return kind.isin("REMOVAL", "DEPRECATION")


def recommendation(kind: Column, api: Column, operation: Column, replacement: Column) -> Column:
    subject = F.coalesce(api, operation)
    removal = F.when(replacement.isNotNull(), F.concat(F.lit("Replace with "), replacement, F.lit("."))).when(subject.isNotNull(), F.concat(F.lit("Remove or update any usage of "), subject, F.lit(" before upgrading."))).otherwise("Review and update this change before upgrading.")
    deprecation = F.when(replacement.isNotNull(), F.concat(F.lit("Migrate to "), replacement, F.lit(" before this is removed in a future release."))).when(subject.isNotNull(), F.concat(F.lit("Plan to migrate away from "), subject, F.lit("; it will be removed in a future release."))).otherwise("Review this deprecation and plan a migration path.")
    return (
        F.when(kind == "REMOVAL", removal)
        .when(kind == "DEPRECATION", deprecation)
        .when(kind.isin("BEHAVIOR_CHANGE", "COMPATIBILITY_CHANGE"), "Review any code relying on the previous behavior, and test after upgrading.")
        .when(kind == "SECURITY", "Upgrade promptly; this addresses a security issue.")
        .otherwise("Review this change before upgrading.")
    )
