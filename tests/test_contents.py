"""Files are parsed by content: copies once, and what an earlier run has parsed not at all."""

from pyspark.sql import functions as F

from releaselode.operators import usage

CODE = "import numpy as np\nnp.polydiv_old({i})\narr.shape = (1, {i})\n"


def facts(df):
    return sorted(map(repr, (tuple(r) for r in df.select("path", "fact", "name", "ord", "line", "code", "method", "is_test").collect())))


def tree(spark):
    """1,000 files, of which 900 are copies of ten vendored ones; two can't be parsed, two are empty, one is listed twice."""
    own = [(f"src/m{i}.py", CODE.format(i=i)) for i in range(96)] + [("src/bad.py", "def broken(:"), ("src/none.py", None), ("src/empty.py", ""), ("src/worse.py", "x = (")]
    copies = [(f"lib/p{i // 10}/tests/v{i % 10}.py", CODE.format(i=1000 + i % 10)) for i in range(900)]
    return spark.createDataFrame([*own, *copies, own[0], ("node_modules/x.py", "skipped"), ("src/notes.txt", "no source")], "path string, content string")


def test_copies_are_parsed_once(spark):
    files = tree(spark)
    contents = usage.new_contents(files)
    assert contents.select("digest").distinct().count() == 96 + 3 + 10 and contents.count() == 96 + 3 + 10 + 1
    got = usage.usage_facts(files)
    one_by_one = [(p, *f[1:], "tests" in p) for p, c in ((r.path, r.content) for r in usage.source_files(files).collect()) for f in usage.facts_of("", c or "")]
    assert facts(got) == sorted(map(repr, one_by_one)) and len(one_by_one) == 2 * (96 + 900 + 1)


def test_known_contents_are_not_parsed_again(spark):
    files = tree(spark)
    first = files.where("path like 'lib/p1%' or path like 'src/m1%' or path = 'src/bad.py'")
    seen, parsed = usage.new_contents(first).select("digest"), usage.content_facts(usage.new_contents(first))
    rest = usage.new_contents(files, seen)
    assert rest.select("digest").distinct().count() == 96 + 3 + 10 - first.select("content").distinct().count()
    assert facts(usage.usage_facts(files, parsed, seen)) == facts(usage.usage_facts(files))
    # with nothing new, no content is left to parse
    assert usage.new_contents(first, seen).count() == 0
    assert usage.usage_facts(files.where(F.lit(False))).count() == 0
