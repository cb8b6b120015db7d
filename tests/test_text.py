"""Lines, names, phrases and classes, on sentences as release notes have them."""

import pytest
from pyspark.sql import functions as F

from releaselode.functions import paths as P
from releaselode.functions import text as T

AXIS = "Calls with an axis below zero are deprecated (gh-31); migrate to np.moveaxis for these."
ITEMSIZE = "From 3.0 on setting the ``itemsize`` attribute fails. Code that did so should use np.frombuffer or numpy.asarray."
REMOVED = "numpy.polydiv_old was removed in favor of numpy.polynomial.polydiv. (gh-812)"
CITED = "tile with a negative count now stops with an error. (gh-77) (deprecated since 1.4)"


def column(spark, values, make, names="t string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    width = names.count(",") + 1
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {names}")
    args = [F.col(n.split()[0]) for n in names.split(", ")][:width]
    return [r[0] for r in df.orderBy("i").select(make(*args).alias("x")).collect()]


def test_subjects(spark):
    axis, itemsize, removed, cited = column(spark, [AXIS, ITEMSIZE, REMOVED, CITED], T.change_subject)
    assert (axis.api, axis.operation, axis.replacement, axis.confidence) == (None, "Calls with an axis below zero", "numpy.moveaxis", "MEDIUM")
    assert (itemsize.api, itemsize.operation, itemsize.replacement, itemsize.attribute) == (None, "itemsize attribute assignment", "numpy.frombuffer", "itemsize")
    assert (removed.api, removed.operation, removed.replacement, removed.confidence) == ("numpy.polydiv_old", None, "numpy.polynomial.polydiv", "HIGH")
    assert cited.operation == "tile with a negative count now stops with an error."


CATEGORIES = [
    (("numpy.tile no longer supports nested tuples. Deprecated in 1.4.", None), "Expired Deprecations"),
    (("The flag of numpy.load is to go and hence deprecated.", None), "New Deprecations"),
    (("numpy.arange may give an OverflowError at its end.", None), "Compatibility Changes"),
    (("A breaking change of the wire format", None), "Breaking Changes"),
    (("Closes CVE-2031-7 in the archive reader", None), "Security Updates"),
    (("Adds support for sparse masks", None), "New Features"),
    (("One more bug in the writer is gone", None), "Bug Fixes"),
    (("numpy.unique got a speedup on strings", None), "Performance Improvements"),
    (("Wheels need another msvc runtime", None), "Build / Toolchain Changes"),
    (("Compatible with files of last year", None), "Compatibility Changes"),
    (("The old hook is no longer available", None), "Breaking Changes"),
    (("whatever it says", "Expired Deprecations"), "Expired Deprecations"),
    (("np.q deprecated since 0.3", "New Deprecations"), "Expired Deprecations"),
    (("np.q will leave", "Deprecations"), "New Deprecations"),
    (("nothing but words", None), "Other User-Impacting Changes"),
]


def test_categories(spark):
    assert column(spark, [c for c, _ in CATEGORIES], T.category, "t string, s string") == [want for _, want in CATEGORIES]


def test_noise(spark):
    noisy = ["The readme has a new logo", "#45", "(#45)", "gh-812", "(gh-9)", "OK", "", "========", "[#45](https://a.b/45)", "<", "from numpy import tile", "y = np.tile(1)", ".. note:: listen", "As a result, it is quicker", "#4 abc", "Thank you all"]
    clear = ["Mended a leak in the writer", "numpy.tile is deprecated; numpy.repeat is there.", "Größere Puffer für Listen"]
    assert column(spark, noisy + clear, T.is_noise) == [True] * len(noisy) + [False] * len(clear)
    assert column(spark, ["Mended wrong rounding", "Solves a crash in tile", "reads pkg.mod of the caller"], T.is_meaningful) == [False, True, True]
    assert column(spark, ["src/q.pyx:7:2: bad", "(812) and more", "for instance, so", "a plain line"], T.is_noise_fragment) == [True, True, True, False]


def test_names(spark):
    got = column(spark, ["np.a and numpy.A, np.b.c() xnp.d np.e.", "none"], T.api_names)
    assert got == [["numpy.a", "numpy.b.c", "numpy.e"], []]
    names = ["`np.dot(x)`.", "numpy.a[0];", "e.g.", "a/b", "setup.py", "two words", None]
    assert column(spark, names, T.api_name) == ["numpy.dot", "numpy.a", None, None, None, None, None]


@pytest.mark.parametrize("text", ["x (gh-1)", "x (deprecated since 1.4) (gh-77)", "x (gh-1). ", "x (gh-1) y", "(gh-1)", "x (deprecation since 1.0)."])
def test_citations_are_stripped_to_the_end(spark, text):
    import re

    one = re.compile(r"\s*\((?:gh-\d+|deprecated since [\d.]+|deprecation since [\d.]+)\)\.?\s*$", re.I)
    want, before = text, None
    while before != want:
        before, want = want, one.sub("", want).rstrip()
    assert column(spark, [text], T.strip_citations) == [want]


def test_lines_and_markup(spark):
    assert column(spark, ["a\r\nb\n", "a\x0bb\x85c\u2028d e", "a\n\nb"], T.text_lines) == [["a", "b"], ["a", "b", "c", "d e"], ["a", "", "b"]]
    assert column(spark, [":cve:`2024-1` and `here <http://x>`_ ``code``"], T.clean_markup) == ["2024-1 and here code"]
    got = column(spark, ["A line [Section: New Features]", " no section ", "a [Section: x] b", "[Section: y]"], T.strip_section)
    assert [(r.text, r.section) for r in got] == [("A line", "New Features"), ("no section", None), ("a [Section: x] b", None), ("", "y")]
    assert column(spark, ["Café  fix!"], T.dedup_key) == ["caféfix"]


def test_behaviour_and_texts(spark):
    long = "Previously, " + "x" * 200 + ". Now, it raises. More."
    rows = [("Previously, a was kept. Now, it is dropped. End.", "BEHAVIOR_CHANGE"), (long, "COMPATIBILITY_CHANGE"), ("Previously, a. Now, b.", "REMOVAL")]
    assert column(spark, rows, lambda t, k: T.behaviour(t, k, 1), "t string, k string") == ["a was kept", "x" * 147 + "...", None]
    cells = [("HIGH", "SCANNED_CONFIRMED"), ("HIGH", "SCANNED_NOT_FOUND"), ("HIGH", "NOT_SCANNED"), ("MEDIUM", "SCANNED_CONFIRMED"), ("LOW", "NOT_SCANNED"), ("INFO", "SCANNED_CONFIRMED")]
    assert column(spark, cells, T.risk, "s string, u string") == ["CRITICAL", "LOW", "UNKNOWN", "HIGH", "LOW", "INFO"]
    assert column(spark, [("Expired Deprecations", "numpy.x deprecated"), ("Expired Deprecations", "numpy.x removed"), ("Bug Fixes", "x")], T.change_type, "c string, t string") == ["DEPRECATION", "REMOVAL", "BUG_FIX"]


def test_disagreement(spark):
    pairs = [("fixed login bug in session", "fixed login bug in session"), ("alpha beta gamma", "one two three"), ("", "x")]
    assert column(spark, pairs, T.disagree, "a string, b string") == [False, True, False]


def test_paths(spark):
    urls = ["git+https://github.com/o/r.git", " https://github.com/o/r/tree/main/ ", "https://www.github.com/o/r", "git@github.com:o/r.git", "https://github.com/o", None]
    assert column(spark, urls, P.repository) == ["o/r", "o/r", None, "git@github.com:o/r", None, None]
    assert column(spark, ["a/.venv/x.py", "src/x.py", "a\\node_modules\\x.js"], P.is_skipped) == [True, False, True]
    assert column(spark, ["tests/x.py", "src/test_x.py", "src/x_test.py", "src/latest.py"], P.is_test) == [True, True, True, False]
    assert column(spark, ["a.py", "a/b.TSX", "a.rst", ".py", "b.tar.js"], P.is_source) == [True, True, False, False, True]
