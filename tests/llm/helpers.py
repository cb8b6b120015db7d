"""Small tables with every awkward case."""

AWKWARD = [
    (0, "The quick brown fox jumps over the lazy dog. " * 9),
    (1, None),
    (2, ""),
    (3, "   leading and  double   spaces \n\n\nand\ttabs\r\n trailing  \n"),
    (4, "The quick brown fox jumps over the lazy dog. " * 9),
    (5, "été   naïve — 東京都 \U0001f600 x <|endoftext|> don't we'll 12345 $$$"),
    (6, "a" * 3000 + " " + "word " * 4000),
    (7, "one two three"),
    (7, "one two three"),
    (9, "\n"),
    (10, " "),
    (11, "x\x1cy \x85 z w"),
    (None, "a row without a key, one two three four five six"),
]


def documents(spark, rows=AWKWARD):
    """documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), -1, "x", (i or 0) % 2, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, block int, key string, n int, rank string")


def utf8(t):
    return (t or "").encode()
