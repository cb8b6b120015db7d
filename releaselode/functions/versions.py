"""PEP 440 ordering as struct columns, and what is decided from it.

A number of any length is kept as its count of digits and the digits, without leading zeros, which sort as the number does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import RANGE_CONDITION, VERSION
from .text import let

#: Stands between the groups of a version; no version holds it.
_CUT = "\x01"
_GROUPS = 10


def _digits(s: Column) -> Column:
    """struct<n, d> of a run of digits; of '' it is zero."""
    return let(F.ltrim(s, F.lit("0")), lambda d: F.struct(F.length(d).alias("n"), d.alias("d")))


def _end(n: int) -> Column:
    """Sorts before (-1) or after (2**30) every number."""
    return F.struct(F.lit(n).alias("n"), F.lit("").alias("d"))


NONE, ENDLESS = -1, 2**30


def version_key(version: Column) -> Column:
    """Struct that sorts as PEP 440 does; null for what is no version. Trailing zeros of the release don't count.

    The pattern is matched once; its groups come as one string, which is split."""

    def part(x: Column) -> Column:
        return F.when(x.rlike(r"^\d+$"), F.struct(F.lit(1).alias("k"), _digits(x).alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(0).alias("k"), _end(NONE).alias("n"), x.alias("s")))

    def key(groups: Column) -> Column:
        g = lambda i: F.get(groups, F.lit(i - 1))
        release = F.transform(F.split(F.regexp_replace(g(2), r"(\.0+)+$", ""), r"\."), _digits)
        dev = g(8) != ""
        post = F.when(g(5) != "", _digits(g(5))).when(g(6) != "", _digits(g(7))).otherwise(_end(NONE))
        pre = F.when(g(3).isin("a", "alpha"), 0).when(g(3).isin("b", "beta"), 1).when(g(3) != "", 2).when(dev & (g(5) == "") & (g(6) == ""), -1).otherwise(3)
        local = F.when(g(10) != "", F.transform(F.split(g(10), r"[-_.]"), part)).otherwise(F.array().cast("array<struct<k:int,n:struct<n:int,d:string>,s:string>>"))
        found = F.struct(_digits(g(1)).alias("epoch"), release.alias("release"), pre.alias("pre"), _digits(g(4)).alias("pre_n"), post.alias("post"), F.when(dev, _digits(g(9))).otherwise(_end(ENDLESS)).alias("dev"), local.alias("local"))
        return F.when(F.size(groups) == _GROUPS, found)

    return let(F.split(F.regexp_replace(F.lower(version), VERSION, _CUT.join(f"${i}" for i in range(1, _GROUPS + 1))), _CUT), key)


def version_bytes(key: Column) -> Column:
    """binary whose byte order is the order of version keys, so that files can be sorted, pruned and filtered by it.

    A number is its count of digits (one byte; from 255 on, 255 and four bytes) and the digits. Lists put 1 (text) or 2 (a number, which sorts
    later) before each part and 0 at the end, so a list sorts before a longer one that it begins."""
    byte = lambda n: F.unhex(F.lit(f"{n:02x}"))

    def number(x: Column) -> Column:
        size = F.when(x["n"] < 255, F.unhex(F.lpad(F.hex(x["n"].cast("long")), 2, "0"))).otherwise(F.concat(byte(255), F.unhex(F.lpad(F.hex(x["n"].cast("long")), 8, "0"))))
        return F.concat(size, x["d"].cast("binary"))

    def listed(parts: Column, one) -> Column:
        return F.concat(F.aggregate(F.transform(parts, one), F.unhex(F.lit("")), lambda a, x: F.concat(a, x)), byte(0))

    release = listed(key["release"], lambda x: F.concat(byte(2), number(x)))
    pre = F.concat(F.unhex(F.lpad(F.hex((key["pre"] + 1).cast("long")), 2, "0")), number(key["pre_n"]))
    post = F.when(key["post"]["n"] == NONE, byte(0)).otherwise(F.concat(byte(1), number(key["post"])))
    dev = F.when(key["dev"]["n"] == ENDLESS, byte(2)).otherwise(F.concat(byte(1), number(key["dev"])))
    local = listed(key["local"], lambda x: F.when(x["k"] == 1, F.concat(byte(2), number(x["n"]))).otherwise(F.concat(byte(1), x["s"].cast("binary"), byte(0))))
    return F.when(key.isNotNull(), F.concat(number(key["epoch"]), release, pre, post, dev, local))


def is_prerelease(key: Column) -> Column:
    """Alpha, beta, candidate or development release."""
    return key["pre"].between(0, 2) | (key["dev"]["n"] != ENDLESS)


def classify_bump(before: Column, now: Column) -> Column:
    at = lambda k, i: F.coalesce(F.get(k["release"], F.lit(i)), _end(0))
    return F.when(is_prerelease(now), "prerelease").when(at(now, 0) != at(before, 0), "major").when(at(now, 1) != at(before, 1), "minor").otherwise("patch")


def conditions(text: Column) -> Column:
    """array<struct<op, bound>> of all conditions found in the text of a range; a bound that is no version is null."""
    ops, bounds = (F.regexp_extract_all(text, F.lit(RANGE_CONDITION), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(ops.alias("op"), F.transform(bounds, version_key).alias("bound"))


def holds(key: Column, found: Column) -> Column:
    """Whether all of these conditions hold for a key; false where there is none, or one without a bound."""

    def test(p: Column) -> Column:
        op, b = p["op"], p["bound"]
        return b.isNotNull() & F.when(op == ">=", key >= b).when(op == "<=", key <= b).when(op == ">", key > b).when(op == "<", key < b).otherwise(key == b)

    return F.coalesce((F.size(found) > 0) & key.isNotNull() & F.forall(found, test), F.lit(False))


def in_range(key: Column, text: Column) -> Column:
    """Whether all conditions found in the text hold. Where one text meets many keys, take conditions() of it once."""
    return let(conditions(text), lambda found: holds(key, found))
