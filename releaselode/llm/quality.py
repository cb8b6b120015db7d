"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules (too few words, too many repeated windows) come first. The method: a document's shares of six classes of
characters, and of the twelve most common words of its language and all others, are compared with the language's
reference by Jensen-Shannon distance. Short documents scatter more, so the limits fall with the root of the
number of words, and documents under `least_words` are not judged; nor are languages without a reference.

Everything is a projection of the scan: no shuffle, no Python, nothing depends on other rows.

Null or empty text: no word, so base_failed. No reference for the language (or null): kept unless base_failed. A very long text is
judged whole, in arrays of its words within its row. Repeated rows and null keys: one result each. Empty table: no row. Only doc_id,
text and lang are read by divergence_rules; keep_documents keeps all columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java and RE2 read these alike.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

#: Shares of characters (other letters and marks, capitals, digits, symbols, other signs, white space), and
#: of words in the order given, then of all other words; measured on documents labelled as good.
REFERENCES = {
    "en": ([0.7950, 0.0140, 0.0005, 0.0001, 0.0236, 0.1668], "the of and to a in is that it for on was", [0.0494, 0.0301, 0.0193, 0.0159, 0.0128, 0.0111, 0.0094, 0.0082, 0.0071, 0.0067, 0.0059, 0.0058, 0.8183]),
    "de": ([0.8091, 0.0132, 0.0004, 0.0001, 0.0220, 0.1552], "der die und in den von zu das mit sich des auf", [0.0484, 0.0290, 0.0191, 0.0163, 0.0126, 0.0107, 0.0096, 0.0082, 0.0071, 0.0066, 0.0059, 0.0056, 0.8209]),
    "fr": ([0.7948, 0.0141, 0.0005, 0.0001, 0.0237, 0.1668], "de la le et les en des un du une que est", [0.0496, 0.0290, 0.0193, 0.0156, 0.0128, 0.0095, 0.0109, 0.0083, 0.0071, 0.0067, 0.0060, 0.0058, 0.8194]),
    "es": ([0.8015, 0.0135, 0.0004, 0.0001, 0.0227, 0.1618], "de la que el en y los se del las un por", [0.0498, 0.0289, 0.0189, 0.0156, 0.0124, 0.0106, 0.0094, 0.0085, 0.0073, 0.0065, 0.0064, 0.0062, 0.8195]),
}
MARKS = "abcdefghijkl"


@dataclass(frozen=True)
class DivergenceParams:
    least_words: int = 50
    char_limit: float = 0.05
    char_scatter: float = 1.6
    word_limit: float = 0.12
    word_scatter: float = 2.0


def _by_lang(lang: Column, value) -> Column:
    out = F.when(lang == "en", value(*REFERENCES["en"]))
    for k in ("de", "fr", "es"):
        out = out.when(lang == k, value(*REFERENCES[k]))
    return out


def _doubles(x: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def js_distance(counts: Column, reference: Column) -> Column:
    """Root of the Jensen-Shannon divergence (bits) between counts and a distribution without zeros; 0 where all counts are 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(F.transform(counts, lambda c: c / total), reference, lambda p, r: (term(p, (p + r) / 2) + term(r, (p + r) / 2)) / 2)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))).otherwise(0.0)


def _repeat_words(grams: Column) -> Column:
    """Words that windows found twice or more cover. grams: a hash of each window, in order."""
    n = F.size(grams)
    by_gram = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | ((k + 1 < n) & (F.get(s, k + 1)["g"] == x["g"])))
    let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    covered = lambda at: F.aggregate(F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(8), b - a)), F.lit(8), lambda a, x: a + x)
    return let(by_gram, lambda s: let(F.array_sort(F.transform(twice(s), lambda x: x["i"])), covered))


def judged(docs: DataFrame, params: DivergenceParams) -> DataFrame:
    """The verdicts, and `row`: the document as it came."""
    p = params
    df = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), docs["lang"].alias("lang"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("words")
    df = df.withColumn("grams", F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(8))))).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    common = _by_lang(F.col("lang"), lambda _, words, __: F.lit(words.split()))
    # one letter for each common word, none for others; all common words are short
    longest = max(len(w) for _, words, _ in REFERENCES.values() for w in words.split())
    letter = lambda w: F.when(F.octet_length(w) <= longest, F.element_at(F.lit(["", *MARKS]), F.array_position(F.col("common"), w).cast("int") + 1)).otherwise("")
    letters = F.array_join(F.transform("words", letter), "")
    df = df.withColumn("common", common)
    df = df.select(
        "doc_id", "lang", "common", "text", "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _repeat_words(F.col("grams"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.when(F.col("common").isNotNull(), letters).alias("letters"),
        F.regexp_replace("text", r"[\p{L}\s]+", "").alias("signs"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("capitals"),
    )
    df = df.withColumn("n_symbols", F.regexp_count("signs", F.lit(SYMBOLS)).cast("long")).withColumn("digits", F.regexp_count("signs", F.lit("[0-9]"))).withColumn("total", F.length("text"))
    spaces = F.col("total") - F.col("word_chars")
    other = F.length("signs") - F.col("n_symbols") - F.col("digits")
    rest = F.col("total") - spaces - F.length("signs") - F.col("capitals")
    chars = F.transform(F.array(rest, F.col("capitals"), F.col("digits"), F.col("n_symbols"), other, spaces), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    counted = [F.length("letters") - F.length(F.replace("letters", F.lit(c), F.lit(""))) for c in MARKS]
    counted.append(F.col("n_words") - F.length("letters"))
    words = F.transform(F.array(*counted), lambda x: x.cast("double"))
    df = df.withColumns({"char_distance": js_distance(chars, _by_lang(F.col("lang"), lambda c, _, __: _doubles(c))), "word_distance": js_distance(words, _by_lang(F.col("lang"), lambda _, __, w: _doubles(w)))})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    root = F.sqrt(F.col("n_words"))
    far = (F.col("n_words") >= p.least_words) & ((F.col("char_distance") > p.char_limit + p.char_scatter / root) | (F.col("word_distance") > p.word_limit + p.word_scatter / root))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.coalesce(far, F.lit(False))).alias("kept"), "char_distance", "word_distance", "row"]
    # one row from one row: filters on the verdicts stay above, as pushed below they would repeat every expression
    return df.select(F.inline(F.array(F.struct(*out))))


def divergence_rules(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long; base_failed, kept boolean; char_distance, word_distance double."""
    return judged(docs, params).drop("row")


def keep_documents(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """The documents that are kept, with all columns."""
    return judged(docs, params).where("kept").select("row.*")


def oracle_sql(params: DivergenceParams = DivergenceParams()) -> str:
    """The same in DuckDB, with windows as strings instead of hashes."""
    p = params
    rows = ", ".join(f"('{k}', {c}, {w.split()}, {s})" for k, (c, w, s) in REFERENCES.items())
    js = lambda c, r: f"case when list_sum({c}) > 0 then sqrt(greatest(0, list_sum([(case when {c}[k] > 0 then {c}[k] / list_sum({c}) * log2({c}[k] / list_sum({c}) / (({c}[k] / list_sum({c}) + {r}[k]) / 2)) else 0 end + {r}[k] * log2({r}[k] / (({c}[k] / list_sum({c}) + {r}[k]) / 2))) / 2 for k in range(1, len({c}) + 1)]))) else 0 end"
    return f"""
with ref(lang, chars, words, shares) as (values {rows}),
d as (select doc_id, coalesce(text, '') as t, lang from documents),
w as (select *, regexp_extract_all(t, '{WORD}+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines, regexp_replace(t, '[\\p{{L}}\\s]+', '', 'g') as signs from d),
g as (select doc_id, i, array_to_string(ws[i:i+7], ' ') as gram from (select doc_id, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
c as (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(i, i + 8)) as q from c where n > 1) group by doc_id),
x as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, length(t) as total, length(signs) as signs, len(regexp_extract_all(signs, '[0-9]')) as digits,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) as capitals, ref.chars, ref.shares,
  list_append([cast(len(list_filter(ws, lambda y: y = ref.words[k])) as double) for k in range(1, 13)], cast(len(list_filter(ws, lambda y: not list_contains(ref.words, y))) as double)) as wc
  from w left join r on r.doc_id = w.doc_id left join ref on ref.lang = w.lang),
y as (select *, [cast(greatest(v, 0) as double) for v in [word_chars - signs - capitals, capitals, digits, n_symbols, signs - n_symbols - digits, total - word_chars]] as cc,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as failed from x),
z as (select *, {js("cc", "chars")} as char_distance, {js("wc", "shares")} as word_distance from y)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  failed as base_failed, not failed and not coalesce(n_words >= {p.least_words} and (char_distance > {p.char_limit} + {p.char_scatter} / sqrt(n_words) or word_distance > {p.word_limit} + {p.word_scatter} / sqrt(n_words)), false) as kept from z"""
