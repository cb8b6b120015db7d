"""What is costly for a row is computed once, and rows that meet nothing don't meet in one task."""

import re

from pyspark.sql import functions as F
from releaselode.functions import fixed as X
from releaselode.functions import text as T
from releaselode.operators import risk

CHANGES = "package string, category string, line string"
USAGE = "name string, is_attribute boolean, rank int, n_hits long, hits array<struct<path:string,line:int,code:string,kind:string,detection_method:string,is_test:boolean>>"


def _changes(spark, rows, usage=()):
    return risk.build_changes(spark.createDataFrame(rows, CHANGES), spark.createDataFrame(list(usage), USAGE))


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_affected_counts_from_few_rows(spark):
    rows = [("p", "Breaking Changes", f"np.f{i % 7} was removed (gh-{i})") for i in range(70)] + [("q", "Security Updates", "Fixed a hole")]
    usage = [(f"numpy.f{i}", False, 2 - i % 2, 1, None) for i in range(5)]
    places = spark.createDataFrame([(f"numpy.f{i}", False, f"{i % 2}.py", i % 2 == 0) for i in range(5)], "name string, is_attribute boolean, path string, is_test boolean")
    got = risk.affected_counts(_changes(spark, rows, usage), ["package"], places)
    assert {tuple(r) for r in got.collect()} == {("p", 3, 2, 1, 1), ("q", 0, 0, 0, 0)}
    assert "Expand" not in plan(got) and "RLIKE" not in plan(got)


def test_changes_without_a_name_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = _changes(spark, [("p", "Security Updates", f"Fixed hole {i}") for i in range(200)] + [("p", "Security Updates", "Fixed np.f")], [("numpy.f", False, 2, 1, None)])
        per = df.groupBy(F.spark_partition_id().alias("task"), "usage_status").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    without = [r["count"] for r in per if r["usage_status"] == "SCANNED_NOT_FOUND"]
    assert sum(without) == 200 and len(without) == 4
    assert [r["count"] for r in per if r["usage_status"] == "SCANNED_CONFIRMED"] == [1]


def test_a_filter_computes_no_column_again(spark):
    df = spark.createDataFrame([("a.b is new",)], "line string").withColumn("category", T.once(T.category(F.col("line"), F.lit(None).cast("string"))))
    assert len(re.findall("searchsorted", plan(df.where("category != 'Bug Fixes'")))) == len(re.findall("searchsorted", plan(df)))


LINES = [
    "", " ", "ok", "Ok.", "gh-12a", "(GH-7)", "#12.", "[#1](https://x.y/z)", "...", "Fixed #123 in parser", "see #12 http://a.b", "np.a = 3", "x = np.a", "  import numpy as np", ".. note:: a", "..x::", "Typos", "K see", "no\nyes and\nimport numpy",
    "np.f(x) and np.F, xnp.g, (numpy.h.i) np.np.", "énp.a np.b;np.c", "np.a np.a.np.b 1np.z _np.q", "np..a a..b", "you can use np.z instead", "np.a is removed in favor of numpy.b. (gh-1) (deprecated since 2.0).", "Setting the ``x`` attribute is deprecated. Use `y` instead",
    "  a b　\x85", "\x1ca\x1f", "​a", "a\n", "\r\na [Section: B] \n", "a [Section: b] [Section: c]", "[Section: ]", ":func:`a` ``b`` `c <d>`_", "a(b", "it [section: B]", None,
]


def test_shortcuts_change_nothing(spark):
    """Against the plain patterns."""
    c = F.col("line")
    low = F.lower(c)
    plain_strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    any_of = lambda words: reduce_or([F.contains(low, F.lit(w)) for w in words])
    noise = any_of([*X.IGNORED, *X.CONTINUATIONS]) | low.rlike(X.GH_REFERENCE) | (F.length(c) < 3) | low.isin("ok", "ok.", "yes", "no") | (F.length(plain_strip(F.regexp_replace(c, X.REFERENCES, ""))) < 8)
    for p in (X.NOISE_CODE, X.NOISE_IMPORT, X.NOISE_DIRECTIVE, X.ANY_DIRECTIVE, X.PURE_REFERENCE, X.PURE_LINK, X.ONLY_SIGNS):
        noise = noise | c.rlike(p)
    markup = c
    for p in (X.ROLE, X.HYPERLINK, X.BACKTICKS):
        markup = F.regexp_replace(markup, p, "$1")
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(X.API_NAME), F.lit(1)), T.api_name), lambda n: n.isNotNull())
    section = r"^(.*?)\s*\[Section:\s*(.+?)\]\s*$"
    at = F.regexp_instr(c, F.lit(f"(?i){X.ALTERNATIVE}"))
    pairs = {
        "strip": (T.strip(c), plain_strip(c)), "rstrip": (T.rstrip(c), F.regexp_replace(c, r"(?U)\s+$", "")), "noise": (T.is_noise(c), noise), "markup": (T.clean_markup(c), markup),
        "meaningful": (T.is_meaningful(c), ~noise & (low.rlike(X.MEANINGFUL_VERBS) | low.rlike(X.API_TOKEN) | low.rlike(X.DOTTED_TOKEN))),
        "names": (T.api_names(c), F.filter(found, lambda x, i: F.array_position(F.transform(found, F.lower), F.lower(x)) == i + 1)),
        "citations": (T.strip_citations(c), T.rstrip(F.regexp_replace(c, f"(?i){X.CITATIONS}", ""))),
        "text": (T.strip_section(c)["text"], plain_strip(F.when(c.rlike(section), F.regexp_extract(c, section, 1)).otherwise(c))), "section": (T.strip_section(c)["section"], F.when(c.rlike(section), plain_strip(F.regexp_extract(c, section, 2)))),
        "before": (T.subject_clause(c), plain_strip(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c))), "from": (T.alternative_clause(c), plain_strip(F.when(at > 0, F.substring(c, at, F.length(c))).otherwise(""))),
    }
    rows = spark.createDataFrame([(x,) for x in LINES], "line string").select("line", *(F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items())).collect()
    assert [(r["line"], n, r[n]) for r in rows for n in pairs if r[n]["a"] != r[n]["b"]] == []


def reduce_or(columns):
    out = columns[0]
    for x in columns[1:]:
        out = out | x
    return out


def test_entries_read_written_steps(spark):
    """No step of the scan over blocks is made again by a later one."""
    from releaselode.operators import notes

    lines = spark.createDataFrame([("a", 0, "# 1.0"), ("a", 1, "- Fixed a crash in parsing"), ("a", 2, "- Added support for files")], "doc string, pos int, line string")
    df = notes.entries(lines, ["doc"])
    assert [r["entry"] for r in df.orderBy("ord").collect()] == ["Fixed a crash in parsing", "Added support for files"]
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString() and "rlike" not in plan(df).lower()


def test_words_are_looked_for_by_parts(spark):
    """Words that share a part are searched for only where it stands, and found all the same."""
    for words in ([*X.IGNORED, *X.CONTINUATIONS], *(w for _, w in X.CATEGORIES)):
        parts = T.shared_parts(words)
        assert all(part in w for part, of in parts.items() for w in of)
        assert all(any(w in of or w == part for part, of in parts.items()) or any(v != w and v in w for v in words) for w in words)
        texts = [*words, *(f"a {w} b" for w in words), *(w[1:] for w in words), *parts, "", "nothing here", None]
        got = spark.createDataFrame([(x,) for x in texts], "line string").select("line", T.contains_any(F.col("line"), words).alias("holds")).collect()
        assert [r for r in got if r["holds"] != (None if r["line"] is None else any(w in r["line"] for w in words))] == []
    assert len(T.shared_parts([*X.IGNORED, *X.CONTINUATIONS])) <= 26


PHRASES = [
    "As An Alternative x", "IN FAVOR OF y.z", "instead, use a", "INSTEAD   use the b", "use a.b rather instead", "replaced BY `c`", "Migrate to d()", "should USE it", "you can create e", "You Can Use f", "causes because", "reuse it instead",
    "x Is Deprecated", "x HAS BEEN deprecated", "a are deprecated", "b is removed", "c has been REMOVED", "d was removed", "e are removed", "f is No Longer Supported", "g are no longer supported", "h no longer support", "undeprecated", "Setting the X attribute IS deprecated", "İ use ﬁ instead",
]


def test_clauses_are_cut_only_where_they_may_be(spark):
    c = F.col("line")
    cut = lambda s, p: F.when(F.regexp_instr(s, F.lit(f"(?i){p}")) > 0, F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(f"(?i){p}")) - 1)).otherwise(s)
    words = F.regexp_replace(F.regexp_extract(c, f"(?i){X.REPLACEMENT}", 1), r"[.,;:]+$", "")
    phrase = T.strip_citations(F.regexp_replace(T.clean_markup(T.strip(cut(c, X.VERB_BOUNDARY))), r"[,:;]+$", ""))
    attribute = T.attribute_name(c)
    pairs = {
        "subject": (T.subject_clause(c), T.strip(cut(c, X.ALTERNATIVE))),
        "operation": (T.operation_phrase(c), F.when(attribute.isNotNull(), F.concat(attribute, F.lit(" attribute assignment"))).otherwise(F.when(phrase != "", T.shortened(phrase, 90)))),
        "replacement": (T.change_subject(c)["replacement"], F.when((words != "") & ~F.lower(words).isin("a", "an", "the", "it", "this"), words)),
    }
    texts = [x for p in PHRASES for x in (p, f"np_f {p} q", f"Long text, {p}; (gh-1).")] + ["", None]
    df = spark.createDataFrame([(x,) for x in texts], "line string")
    rows = df.select("line", *(F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items())).collect()
    assert [(r["line"], n, r[n]) for r in rows for n in pairs if r[n]["a"] != r[n]["b"]] == []
    # the pattern is not tried on a line without any of its words
    assert "Contains" in plan(df.select(T.subject_clause(c)))


def test_an_operation_is_found_in_one_cut(spark):
    """Over one lower case and one clause a line, with the same values at ends that have to be stripped or cut."""
    from releaselode.plans import catalog

    df = catalog.operation_phrase(spark, "/root/testdata/sf0.001")
    assert plan(df).count("should use") == plan(df).count("setting the\\s+") == 1
    c = F.col("line")
    whole = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    cut = lambda s, p: F.when(F.regexp_instr(s, F.lit(f"(?i){p}")) > 0, F.substring(s, F.lit(1), F.regexp_instr(s, F.lit(f"(?i){p}")) - 1)).otherwise(s)
    subject = whole(cut(c, X.ALTERNATIVE))
    markup = whole(cut(subject, X.VERB_BOUNDARY))
    for p in (X.ROLE, X.HYPERLINK, X.BACKTICKS):
        markup = F.regexp_replace(markup, p, "$1")
    phrase = F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, "[,:;]+$", ""), f"(?i){X.CITATIONS}", ""), r"(?U)\s+$", "")
    attribute = F.regexp_extract(subject, f"(?i){X.ATTRIBUTE}", 1)
    want = F.struct(F.when(attribute != "", F.concat(attribute, F.lit(" attribute assignment"))).otherwise(F.when(phrase != "", T.shortened(phrase, 90))).alias("operation"), F.when(attribute != "", attribute).alias("attribute"))
    ends = ["　a b ", "\x7fa\x7f", "é", "aé ", "a,:;", "a, ;", "``a,\n``", "``a, ``", "(gh-1)", "b (gh-1):", " ~ ", "!", "x" * 90, "x" * 91, "SETTING the  `y` attribute is removed", "setting the z", "ſetting the `y` attribute", " Use a instead", "a\x85is deprecated\x85"]
    texts = [*LINES, *ends, *PHRASES, *(f"{e} was removed {p}" for e in ends for p in PHRASES)]
    rows = spark.createDataFrame([(x,) for x in texts], "line string").select("line", T.operation_and_attribute(T.subject_clause(c)).alias("got"), T.operation_phrase(subject).alias("of_subject"), want.alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"] or r["of_subject"] != r["want"]["operation"]] == []


def test_advice_searches_subjects_only_where_it_quotes_them(spark):
    from releaselode.plans import catalog

    d = "/root/testdata/sf0.001"
    df = catalog.recommendation(spark, d)
    # one search for a subject, under the kinds that quote it, and one lower case for the rules, which are no call by themselves
    assert plan(df).count("should use|you can") == 1 and re.search(r"CASE WHEN kind#\d+ IN \(REMOVAL,DEPRECATION\) THEN aggregate\(", plan(df))
    assert len(re.findall(r"lower\(line#\d+\) AS low", plan(df))) == 1 and re.search(r"RLIKE\(low#\d+, \S*searchsorted", plan(df))
    c = F.col
    kind = T.change_type(c("category"), c("line"))
    eager = catalog._src(spark, d).withColumn("category", T.category(c("line"), F.lit(None).cast("string"))).withColumn("s", T.change_subject(c("line")))
    eager = eager.select("l_orderkey", "l_linenumber", T.recommendation(kind, c("s.api"), c("s.operation"), c("s.replacement")).alias("recommendation"))
    assert df.exceptAll(eager).isEmpty() and eager.exceptAll(df).isEmpty() and df.count() > 4000
