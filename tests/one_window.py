"""Sections, paragraphs and entries by windows over whole texts: what the scan over blocks must equal."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from releaselode.functions import fixed as X
from releaselode.functions import text as T


def heading_lines(lines: DataFrame, key: list[str]) -> DataFrame:
    """lines with `heading`: names a version, and begins with # or is underlined."""
    w = Window.partitionBy(*key).orderBy("pos")
    s = T.strip(F.col("line"))
    under = F.coalesce(T.strip(F.lead("line").over(w)).rlike(X.UNDERLINE), F.lit(False))
    return lines.withColumn("heading", s.rlike(X.VERSION_LIKE) & (s.startswith("#") | under))


def version_sections(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, section, pos, heading, body: all sections of each text, cut once. The body is null where it is blank."""
    w = Window.partitionBy(*key).orderBy("pos")
    df = heading_lines(lines, key).withColumn("section", F.sum(F.col("heading").cast("int")).over(w)).where("section > 0")
    v = Window.partitionBy(*key, "section").orderBy("pos")
    df = df.withColumn("at", F.row_number().over(v))
    label = (F.col("at") == 1) | ((F.col("at") == 2) & T.strip(F.col("line")).rlike(X.UNDERLINE))
    body = T.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~label, F.struct("pos", "line")))), lambda x: x["line"]), "\n"))
    out = df.groupBy(*key, "section").agg(F.min("pos").alias("pos"), F.min_by("line", "pos").alias("heading"), body.alias("body"))
    return out.withColumn("body", F.when(F.col("body") != "", F.col("body")))


def paragraphs(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, para, section, block, is_change, lines (array): paragraphs in order, without lone subheaders.

    Headings (and the underline they take), blank lines and bare section names end a paragraph. Headings and section
    names open a block. A section name already holds for the paragraph that it ends. In a run of lines that could
    each be the heading of the next, every other one is."""
    w = Window.partitionBy(*key).orderBy("pos")
    s = T.strip(F.col("line"))
    df = lines.withColumn("s", s).withColumn("hash", s.startswith("#"))
    df = df.withColumn("cand", ~F.col("hash") & (F.col("s") != "") & F.coalesce(F.lead("s").over(w).rlike(X.UNDERLINE), F.lit(False)))
    df = df.withColumn("runs", F.sum((~F.col("cand")).cast("int")).over(w))
    r = Window.partitionBy(*key, "runs").orderBy("pos")
    # a run starts after its first, uncandidate row, or at the top of the text
    df = df.withColumn("setext", F.col("cand") & (F.sum(F.col("cand").cast("int")).over(r) % 2 == 1))
    df = df.withColumn("head", F.col("hash") | F.col("setext")).withColumn("taken", F.coalesce(F.lag("setext").over(w), F.lit(False)))
    name = ~F.col("head") & ~F.col("taken") & F.lower("s").isin(X.SECTION_NAMES)
    df = df.withColumn("name", F.when(name, F.col("s"))).withColumn("stop", F.col("head") | F.col("taken") | (F.col("s") == "") | name)
    df = df.withColumn("block", F.sum((F.col("head") | name).cast("int")).over(w)).withColumn("para", F.sum(F.col("stop").cast("int")).over(w))
    upto = F.last("name", ignorenulls=True).over(w)
    df = df.withColumn("upto", upto).withColumn("section", F.coalesce(F.lead("upto").over(w), F.col("upto"))).where("not stop")
    p = Window.partitionBy(*key, "para").orderBy("pos")
    verb = (F.row_number().over(p) > 1) & ~T.is_noise(T.rstrip(F.col("line"))) & F.lower(T.rstrip(F.col("line"))).rlike(X.PARAGRAPH_VERBS)
    df = df.withColumn("verb", verb)
    out = df.groupBy(*key, "para").agg(
        F.max_by(F.struct("section"), "pos").alias("last"), F.max("block").alias("block"), F.bool_or("verb").alias("is_change"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("lines"),
    )
    lone = (F.size("lines") == 1) & F.get("lines", F.lit(0)).rlike(X.SUBHEADER)
    return out.where(~lone).select(*key, F.col("para").cast("long").alias("para"), F.col("last.section").alias("section"), F.col("block").cast("long").alias("block"), "is_change", "lines")


def entries(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, ord, section, entry: one clean line for each logical change."""
    w = Window.partitionBy(*key).orderBy("para")
    df = paragraphs(lines, key)
    fresh = F.col("is_change") | (F.row_number().over(w) == 1) | ~F.col("section").eqNullSafe(F.lag("section").over(w)) | (F.col("block") != F.lag("block").over(w))
    df = df.withColumn("group", F.sum(fresh.cast("int")).over(w))
    df = df.groupBy(*key, "group").agg(F.min_by(F.struct("section"), "para").alias("first"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("para", "lines"))), lambda x: x["lines"])).alias("lines"))
    kept = F.filter("lines", lambda x: ~x.rlike(X.SUBHEADER) & ~T.is_noise(x))
    df = df.withColumn("lines", kept).where(F.size("lines") > 0)
    bullet = lambda x: x.rlike(X.BULLET) | x.rlike(X.NUMBERED)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, X.BULLET, ""), r"^\d+\.\s+(?=[A-Za-z])", "")
    rows = df.select(*key, "group", F.col("first.section").alias("section"), F.exists("lines", bullet).alias("listed"), F.posexplode("lines").alias("i", "line"))
    v = Window.partitionBy(*key, "group").orderBy("i")
    rows = rows.withColumn("item", F.when(F.col("listed"), F.sum((bullet(F.col("line")) | (F.col("i") == 0)).cast("int")).over(v)).otherwise(1))
    text = F.when(F.col("listed"), bare(F.col("line"))).otherwise(F.col("line"))
    out = rows.withColumn("part", text).groupBy(*key, "group", "item").agg(F.min_by(F.struct("section"), "i").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), " ").alias("entry"))
    order = Window.partitionBy(*key).orderBy("group", "item")
    return out.select(*key, F.row_number().over(order).cast("long").alias("ord"), F.col("first.section").alias("section"), T.clean_markup(F.col("entry")).alias("entry"))
