"""Notes as tables: sections of changelogs, paragraphs, entries, categories, merging.

What lies in a line's past (open section, paragraph, which of two underlines counts) is carried over blocks of lines
(see scan.py), so a text of any length is spread over tasks. `size` is the lines of a block; it changes no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..session import stored
from . import scan as S


def exploded_lines(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos, line of each text."""
    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(*key, F.posexplode(T.text_lines(F.col(text))).alias("pos", "line"))


def _headings(lines: DataFrame, key: list[str], size: int) -> DataFrame:
    """lines dealt in blocks, with heading, section (headings so far) and label (a heading, or the underline it takes)."""
    s, no = T.strip(F.col("line")), F.lit(False)
    rows = S.dealt(lines, key, "pos", size).withColumns({"_under": s.rlike(X.UNDERLINE), "_names": s.rlike(X.VERSION_LIKE), "_hash": s.startswith("#")})
    # a heading for certain, or one if an underline follows, which for a block's last line the next block knows
    after = F.lead("_under").over(S.within())
    rows = rows.withColumn("_sure", F.col("_names") & (F.col("_hash") | F.coalesce(after, no)))
    leave = {"sure": F.sum(F.col("_sure").cast("long")), "open": S.last(F.col("_names") & ~F.col("_hash")), "closing": S.last(F.col("_sure")), "under": S.first(F.col("_under"))}
    steps = [
        {"_follows": F.coalesce(F.lead("under").over(S.over()), no)},
        {"all": F.col("sure") + (F.col("open") & F.col("_follows")).cast("long"), "closes": F.col("closing") | (F.col("open") & F.col("_follows"))},
        {"_before": S.before("all"), "_headed": F.coalesce(F.lag("closes").over(S.over()), no)},
    ]
    rows = S.told(rows, leave, steps, ["_follows", "_before", "_headed"])
    rows = rows.withColumn("heading", F.col("_names") & (F.col("_hash") | F.coalesce(after, F.col("_follows"))))
    headed = F.coalesce(F.lag("heading").over(S.within()), F.col("_headed"))
    return rows.withColumns({"section": F.col("_before") + F.sum(F.col("heading").cast("long")).over(S.so_far()), "label": F.col("heading") | (headed & F.col("_under"))})


def heading_lines(lines: DataFrame, key: list[str], size: int = S.BLOCK) -> DataFrame:
    """lines with `heading`: names a version, and begins with # or is underlined."""
    return _headings(lines, key, size).select(*lines.columns, "heading")


def version_sections(lines: DataFrame, key: list[str], size: int = S.BLOCK) -> DataFrame:
    """key, section, pos, heading, body: all sections of each text, cut once. The body is null where it is blank."""
    rows = _headings(lines, key, size).where("section > 0")
    body = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("label"), F.struct("pos", "line")))), lambda x: x["line"]), "\n"))
    out = rows.groupBy(S.TEXT, "section").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("heading"), body.alias("body"))
    return out.select(*S.unpacked(key), "section", "pos", "heading", F.when(F.col("body") != "", F.col("body")).alias("body"))


def mentions(heading: Column, version: Column) -> Column:
    """The version stands in the heading with no digit beside it."""
    quoted = F.regexp_replace(version, r"([^A-Za-z0-9])", r"\\$1")
    # a pattern of its own for each row is compiled for each row, so only where the text stands at all
    exact = F.regexp_like(heading, F.concat(F.lit("(^|[^0-9])"), quoted, F.lit("([^0-9]|$)")))
    return F.when(F.contains(heading, version), exact).otherwise(False)


def sections_of(versions: DataFrame, sections: DataFrame, on: list[str]) -> DataFrame:
    """on, version, body: of each version the first section whose heading mentions it; none where that one is blank.

    Headings are first matched by the numbers in them, an equi-join; the exact test follows."""
    head = sections.select(*on, "pos", "body", "heading", F.explode(F.array_distinct(F.regexp_extract_all("heading", F.lit(r"(\d+)"), F.lit(1)))).alias("first"))
    asked = versions.withColumn("first", F.regexp_extract("version", r"(\d+)", 1))
    hits = asked.join(head, [*on, "first"]).where(mentions(F.col("heading"), F.col("version")))
    return hits.groupBy(*on, "version").agg(F.min_by(F.struct("body"), "pos").alias("hit")).select(*on, "version", F.col("hit.body").alias("body")).where("body is not null")


def _marked(lines: DataFrame, key: list[str], size: int) -> DataFrame:
    """lines dealt in blocks, with s (stripped), head, taken (the underline of a heading), and name where it names a section."""
    no = F.lit(False)
    rows = S.dealt(lines, key, "pos", size).select(S.TEXT, S.PART, S.AT, "pos", "line", T.strip(F.col("line")).alias("s")).withColumn("hash", F.col("s").startswith("#"))
    rows = rows.withColumns({"_under": F.col("s").rlike(X.UNDERLINE), "_may": ~F.col("hash") & (F.col("s") != ""), "_n": F.row_number().over(S.within())})
    after = F.lead("_under").over(S.within())
    # of neighbouring lines that are each followed by an underline every other one is a heading: a block hands on whether its
    # last line is one, which depends on the block before it only where all its lines are such candidates
    rows = rows.withColumn("_gap", F.when(~(F.col("_may") & F.coalesce(after, no)) & after.isNotNull(), F.col("_n")))
    leave = {"n": F.count("*"), "gap": F.max("_gap"), "may": S.last(F.col("_may")), "under": S.first(F.col("_under"))}
    steps = [
        {"_follows": F.coalesce(F.lead("under").over(S.over()), no)},
        {"ends": F.col("may") & F.col("_follows")},
        {"odd": F.when(F.col("ends"), (F.col("n") - F.coalesce("gap", F.lit(0))) % 2).otherwise(0), "through": F.col("ends") & F.col("gap").isNull()},
        {"group": F.sum((~F.col("through")).cast("long")).over(S.over())},
        {"head": F.sum("odd").over(Window.partitionBy(S.TEXT, "group").orderBy(S.PART)) % 2 == 1},
        {"_headed": F.coalesce(F.lag("head").over(S.over()), no)},
    ]
    rows = S.told(rows, leave, steps, ["_follows", "_headed"])
    cand = F.col("_may") & F.coalesce(after, F.col("_follows"))
    rows = rows.withColumn("_cand", cand).withColumn("_since", F.max(F.when(~F.col("_cand"), F.col("_n"))).over(S.so_far()))
    setext = F.col("_cand") & (((F.col("_n") - F.coalesce("_since", F.lit(0))) % 2 == 1) != (F.col("_since").isNull() & F.col("_headed")))
    rows = rows.withColumn("setext", setext).withColumns({"head": F.col("hash") | F.col("setext"), "taken": F.coalesce(F.lag("setext").over(S.within()), F.col("_headed"))})
    return rows.withColumn("name", F.when(~F.col("head") & ~F.col("taken") & F.lower("s").isin(X.SECTION_NAMES), F.col("s")))


def paragraphs(lines: DataFrame, key: list[str], size: int = S.BLOCK) -> DataFrame:
    """key, para, section, block, is_change, lines (array): paragraphs in order, without lone subheaders.

    Headings (and the underline they take), blank lines and bare section names end a paragraph. Headings and section
    names open a block. A section name already holds for the paragraph that it ends. In a run of lines that could
    each be the heading of the next, every other one is. One paragraph is one row, so its own lines must fit a task."""
    rows = stored(_marked(lines, key, size), "marked-lines")
    named = F.col("name").isNotNull()
    rows = rows.withColumns({"_opens": (F.col("head") | named).cast("long"), "_stops": F.col("head") | F.col("taken") | (F.col("s") == "") | named})
    leave = {
        "opens": F.sum("_opens"), "stops": F.sum(F.col("_stops").cast("long")), "stop": S.last(F.col("_stops")), "name": S.first(F.col("name")),
        "upto": F.max_by("name", F.when(named, F.col(S.AT))),
    }
    steps = [{
        "_opened": S.before("opens"), "_stopped": S.before("stops"), "_fresh": F.coalesce(F.lag("stop").over(S.over()), F.lit(True)),
        "_upto": F.last("upto", ignorenulls=True).over(S.earlier()), "_named": F.lead("name").over(S.over()),
    }]
    rows = S.told(rows, leave, steps, ["_opened", "_stopped", "_fresh", "_upto", "_named"])
    upto = F.coalesce(F.last("name", ignorenulls=True).over(S.so_far()), F.col("_upto"))
    following = F.when(F.lead(S.AT).over(S.within()).isNull(), F.col("_named")).otherwise(F.lead("name").over(S.within()))
    rows = rows.withColumns({
        "block": F.col("_opened") + F.sum("_opens").over(S.so_far()), "para": F.col("_stopped") + F.sum(F.col("_stops").cast("long")).over(S.so_far()),
        "section": F.coalesce(following, upto), "_first": F.coalesce(F.lag("_stops").over(S.within()), F.col("_fresh")),
    }).where("not _stops")
    verb = ~F.col("_first") & ~T.is_noise(T.rstrip(F.col("line"))) & F.lower(T.rstrip(F.col("line"))).rlike(X.PARAGRAPH_VERBS)
    out = rows.withColumn("verb", verb).groupBy(S.TEXT, "para").agg(
        F.max_by(F.struct("section"), "pos").alias("last"), F.max("block").alias("block"), F.bool_or("verb").alias("is_change"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("lines"),
    )
    lone = (F.size("lines") == 1) & F.get("lines", F.lit(0)).rlike(X.SUBHEADER)
    return out.where(~lone).select(*S.unpacked(key), "para", F.col("last.section").alias("section"), "block", "is_change", "lines")


def entries(lines: DataFrame, key: list[str], size: int = S.BLOCK) -> DataFrame:
    """key, ord, section, entry: one clean line for each logical change.

    Paragraphs are written to the scratch folder first: each scan over blocks has its rows twice in the plan, which would grow with every one."""
    # paragraphs that go on with the one before them form a group
    df = S.dealt(stored(paragraphs(lines, key, size), "paragraphs"), key, "para", size).withColumn("_of", F.struct("section", "block"))
    earlier = F.lag("_of").over(S.within())
    goes_on = lambda change, of, past: ~change & past.isNotNull() & of["section"].eqNullSafe(past["section"]) & (of["block"] == past["block"])
    # of a block's first paragraph, the one before it is known to the block before
    inner = F.when(earlier.isNotNull(), (~goes_on(F.col("is_change"), F.col("_of"), earlier)).cast("long")).otherwise(0)
    df = df.withColumn("_inner", inner)
    leave = {"inner": F.sum("_inner"), "first": S.first(F.struct("is_change", "_of")), "end": S.last(F.col("_of"))}
    df = stored(df, "grouped-paragraphs")
    steps = [{"_past": F.lag("end").over(S.over())}, {"all": F.col("inner") + (~F.coalesce(goes_on(F.col("first.is_change"), F.col("first._of"), F.col("_past")), F.lit(False))).cast("long")}, {"_before": S.before("all")}]
    df = S.told(df, leave, steps, ["_past", "_before"])
    fresh = ~F.coalesce(goes_on(F.col("is_change"), F.col("_of"), F.coalesce(earlier, F.col("_past"))), F.lit(False))
    df = df.withColumn("group", F.col("_before") + F.sum(fresh.cast("long")).over(S.so_far()))
    df = df.groupBy(S.TEXT, "group").agg(F.min_by(F.struct("section"), "para").alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("para", "lines"))), lambda x: x["lines"])).alias("lines"))
    kept = T.once(F.filter("lines", lambda x: ~x.rlike(X.SUBHEADER) & ~T.is_noise(x)))
    bullet = lambda x: x.rlike(X.BULLET) | x.rlike(X.NUMBERED)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, X.BULLET, ""), r"^\d+\.\s+(?=[A-Za-z])", "")
    # each group's lines, with whether one opens an item; how many do so tells the entries of a group before they are made
    df = df.withColumn("lines", kept).where(F.size("lines") > 0)
    df = df.withColumn("lines", F.transform("lines", lambda x: F.struct(x.alias("line"), bullet(x).alias("bullet"))))
    listed = F.exists("lines", lambda x: x["bullet"])
    opening = F.transform("lines", lambda x, i: F.struct(F.when(F.col("listed"), bare(x["line"])).otherwise(x["line"]).alias("line"), ((i == 0) | (F.col("listed") & x["bullet"])).alias("opens")))
    df = df.withColumn("listed", listed).withColumn("lines", opening).withColumn("items", F.size(F.filter("lines", lambda x: x["opens"])).cast("long"))
    df = S.again(stored(df.select(S.TEXT, "group", F.col("first.section").alias("section"), "lines", "items"), "groups"), "group", size)
    df = S.told(df, {"all": F.sum("items")}, [{"_before": S.before("all")}], ["_before"])
    df = df.withColumn("_ord", F.col("_before") + F.sum("items").over(S.so_far()) - F.col("items"))
    rows = df.select(S.TEXT, "group", "section", "_ord", F.posexplode("lines").alias("i", "x"))
    v = Window.partitionBy(S.TEXT, "group").orderBy("i")
    rows = rows.withColumn("ord", F.col("_ord") + F.sum(F.col("x.opens").cast("long")).over(v))
    out = rows.groupBy(S.TEXT, "group", "ord", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x.line"))), lambda x: x["line"]), " ").alias("entry"))
    return out.select(*S.unpacked(key), "ord", "section", T.clean_markup(F.col("entry")).alias("entry"))


def categorized(found: DataFrame) -> DataFrame:
    """Meaningful entries with their category. `labelled` is the entry with its section."""
    labelled = F.when(F.col("section").isNotNull(), F.concat(F.col("entry"), F.lit(" [Section: "), F.col("section"), F.lit("]"))).otherwise(F.col("entry"))
    return found.where(T.is_meaningful(F.col("entry"))).withColumns({"category": T.category(F.col("entry"), F.col("section")), "labelled": labelled})


def from_model(answers: DataFrame, key: list[str], column: str = "answer") -> DataFrame:
    """key, ord, category, entry of a model's answers: JSON arrays, maybe fenced. An answer that is no array gives no row
    here; has_answer() tells it apart, so that its text can be categorized by keywords instead."""
    rows = answers.where(has_answer(F.col(column))).select(*key, F.posexplode(_items(F.col(column))).alias("i", "item"))
    cat, entry = T.strip(F.coalesce(F.col("item.category"), F.lit(""))), T.strip(F.coalesce(F.col("item.summary"), F.lit("")))
    w = Window.partitionBy(*key).orderBy("i")
    rows = rows.select(*key, "i", F.when(cat.isin(X.LLM_CATEGORIES), cat).otherwise(X.OTHER).alias("category"), entry.alias("entry")).where("entry != ''")
    return rows.select(*key, F.row_number().over(w).cast("long").alias("ord"), "category", "entry")


def _bare_json(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(T.strip(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def _items(answer: Column) -> Column:
    return F.from_json(_bare_json(answer), "array<struct<category:string,summary:string>>")


def has_answer(answer: Column) -> Column:
    return F.coalesce(_bare_json(answer).startswith("[") & _items(answer).isNotNull(), F.lit(False))


def merged(rows: DataFrame, request: list[str], order: list[str], line: str = "labelled") -> DataFrame:
    """The first of rows whose lines are equal but for case and signs, in each request and category.

    A window would bring all rows of a busy key together; a minimum is combined before the shuffle."""
    df = rows.withColumn("dedup_key", T.dedup_key(F.col(line)))
    return df.groupBy(*request, "category", "dedup_key").agg(F.min(F.struct(*order, *(c for c in df.columns if c not in {*order, *request, "category", "dedup_key"}))).alias("r")).select(*request, "category", "dedup_key", "r.*")
