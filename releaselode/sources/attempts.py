"""The log of a loader's requests, reduced to what each request came to, and notes read from it.

responses: source ('release' or 'compare'), repo, request (a tag, or old...new), attempt (from 1), status, body. The status is
null where the network failed; body is the JSON text of the answer. A failure of the network is tried again, three times at most; the
first answer counts, whatever it is. Log rows beyond the third attempt, or after the answer, are of no account. Rows may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .notes import first_release, first_compare, release_tags, compare_pairs

ATTEMPTS = 3
SCHEMA = "source string, repo string, request string, attempt int, status int, body string"


def outcomes(responses: DataFrame, key: list[str]) -> DataFrame:
    """key, state (ok, missing, rate_limit or network), attempts (that were of account), body: one row a request.

    A minimum of structs, so that a request that is logged very often is combined before the shuffle; bodies that don't count go first."""
    seen = F.col("status").isNotNull()
    limited = (F.col("status") == 403) & F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit("rate limit"))
    said = F.when(limited, "rate_limit").when(F.col("status") == 200, "ok").when(seen, "missing")
    rows = responses.where(F.col("attempt").between(1, ATTEMPTS)).select(*key, "attempt", said.alias("state"), F.when(F.col("status") == 200, F.col("body")).alias("body"))
    out = rows.groupBy(*key).agg(F.min(F.when(F.col("state").isNotNull(), F.struct("attempt", "state", "body"))).alias("r"), F.max("attempt").alias("last"))
    return out.select(*key, F.coalesce("r.state", F.lit("network")).alias("state"), F.coalesce("r.attempt", "last").alias("attempts"), F.col("r.body").alias("body"))


def failed(state: Column) -> Column:
    """A request that ended so ends the search of its source, and may go better later."""
    return state.isin("rate_limit", "network")


def release_candidates(versions: DataFrame, responses: DataFrame) -> DataFrame:
    """repo, package, version, source, text, url, had_error: as release_notes; the first tag in order that has text or failed decides."""
    got = outcomes(responses.where("source = 'release'"), ["repo", "request"]).where("state != 'missing'")
    post = F.from_json("body", "body string, html_url string")
    got = got.select("repo", F.col("request").alias("tag"), failed(F.col("state")).alias("had_error"), T.strip(F.coalesce(post["body"], F.lit(""))).alias("text"), post["html_url"].alias("html_url"))
    return first_release(release_tags(versions), got.where("had_error or text != ''"))


def commit_candidates(versions: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """key, source, text, url, had_error: as commit_notes."""
    got = outcomes(responses.where("source = 'compare'"), ["repo", "request"]).where("state != 'missing'")
    answer = F.from_json("body", "commits array<struct<commit:struct<message:string>>>")
    messages = F.transform(answer["commits"], lambda c: c["commit"]["message"])
    parts = F.split("request", r"\.\.\.", 2)
    got = got.select("repo", F.get(parts, F.lit(0)).alias("old_tag"), F.get(parts, F.lit(1)).alias("new_tag"), failed(F.col("state")).alias("had_error"), messages.alias("messages"))
    return first_compare(compare_pairs(versions, key), got, key)
