"""Fetched URLs as documents: conditional requests, one plan from responses to outcomes, and what is kept of each URL between runs.

A table of responses has url and any of status (int; null: no answer), body or html (binary or text), etag, last_modified, blocked
(boolean: refused before a connection), fetched_at. Of several responses of one URL the latest counts, of equal ones the greatest.

Outcomes: Unchanged (304, or the body that was indexed before under the same policy), Gone (404, 410), Blocked (401, 403, refused), FetchError (no
answer, or another error), and by the parser chain for the rest Indexed, Empty, Unsupported and ParseFailed. Only Gone is evidence
that a document has left; all others leave what is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.operators.extract import parse_documents
from loamline.sources.fetch import Fetched, Pacer
from loamline.sources.fetch import fetch as fetch_one

FETCHES = "store_id string, source_id string, uri string, outcome string, etag string, last_modified string, body_hash string, policy_version string, fetched_at string"
RESPONSES = "url string, status int, body binary, etag string, last_modified string, blocked boolean, fetched_at string"
#: What a parser's status makes of a downloaded response, and what the outcomes are to the plan of changes.
PARSED = {"ok": "Indexed", "empty": "Empty", "unsupported": "Unsupported", "error": "ParseFailed"}
_STATUS = {"Fetched": 200, "Unchanged": 304, "Gone": 404, "RateLimited": 429}


def responses(pages: DataFrame) -> DataFrame:
    """The rows of RESPONSES, one for each URL that isn't null; columns that are missing are null, a missing status is 200."""
    kinds = dict(x.split(" ") for x in RESPONSES.split(", "))
    have = {c: F.col(c) for c in kinds if c in pages.columns}
    if "body" not in have and "html" in pages.columns:
        have["body"] = F.col("html")
    have.setdefault("status", F.lit(200))
    rows = pages.select(*(have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items())).filter("url IS NOT NULL")
    # By the body's digest, so that bodies aren't compared; a URL's repeats combine before the shuffle.
    order = F.struct("fetched_at", "status", F.sha2(F.coalesce("body", F.lit("").cast("binary")), 256))
    one = rows.groupBy("url").agg(F.max_by(F.struct(*kinds), order).alias("r"))
    return one.select("r.*")


def requests(urls: DataFrame, fetches: DataFrame) -> DataFrame:
    """url, etag, last_modified to ask for: validators go along only where a document is held that they vouch for."""
    held = fetches.filter("body_hash IS NOT NULL").select(F.col("uri").alias("url"), "etag", "last_modified")
    return urls.select("url").filter("url IS NOT NULL").distinct().join(held, "url", "left")


def fetch(wanted: DataFrame, fetcher: Callable[..., Fetched] = fetch_one, per_second: float = 1.0, tasks: int = 200) -> DataFrame:
    """RESPONSES of requests. Each host is in one task, so that its pace holds; a failing fetcher is a response without an answer."""
    host = F.lower(F.coalesce(F.parse_url("url", F.lit("HOST")), F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(per_second)
        for batch in batches:
            for url, etag, modified in zip(batch["url"], batch["etag"], batch["last_modified"], strict=True):
                try:
                    got = fetcher(url, etag, modified, pacer=pacer)
                except Exception as e:  # one URL must not stop the others
                    got = Fetched("FetchError", reason=str(e)[:200])
                now = pd.Timestamp.now("UTC").strftime("%Y-%m-%dT%H:%M:%S.%fZ")
                # One row at a time: bodies may be long.
                yield pd.DataFrame([(url, _STATUS.get(got.outcome), got.body, got.etag, got.modified, got.outcome == "Blocked", now)], columns=[x.split(" ")[0] for x in RESPONSES.split(", ")]).astype({"status": "Int32"})

    return wanted.repartition(tasks, host).mapInPandas(run, RESPONSES)


def outcomes(got: DataFrame, fetches: DataFrame, policy: str, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """uri, outcome, etag, last_modified, body_hash, fetched_at of responses() rows, and the parsed documents (as of parse_documents) of those that are Indexed.

    fetches are the source's rows of FETCHES. A body that was indexed before under the same policy isn't parsed again.
    """
    digest = F.sha2("body", 256)
    known = fetches.select(F.col("uri").alias("url"), F.col("body_hash").alias("known"), F.col("policy_version").alias("known_policy"))
    rows = got.join(known, "url", "left").withColumn("digest", digest)
    same = F.coalesce((F.col("digest") == F.col("known")) & (F.col("known_policy") == policy), F.lit(False))
    told = (
        F.when(F.coalesce("blocked", F.lit(False)) | F.col("status").isin(401, 403), "Blocked").when(F.col("status") == 304, "Unchanged").when(F.col("status").isin(404, 410), "Gone")
        .when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)) | F.col("body").isNull(), "FetchError").when(same, "Unchanged")
    )
    rows = rows.withColumn("told", told)
    parsed = keep(parse_documents(rows.filter("told IS NULL").select(F.col("url").alias("uri"), F.col("body").alias("content"))))
    of = F.create_map(*(F.lit(x) for pair in PARSED.items() for x in pair))
    status = parsed.select(F.col("uri").alias("url"), of[F.col("status")].alias("parsed"))
    out = rows.drop("body").join(status, "url", "left").select(F.col("url").alias("uri"), F.coalesce("told", "parsed").alias("outcome"), "etag", "last_modified", F.col("digest").alias("body_hash"), "fetched_at")
    return out, parsed


def after(fetches: DataFrame, found: DataFrame, store_id: str, source_id: str, policy: str) -> DataFrame:
    """The source's rows of FETCHES after a run: what is Indexed takes the new validators, what is Gone loses them, all else keeps those of the document that is held."""
    old = fetches.select("uri", *(F.col(c).alias(f"old_{c}") for c in ("outcome", "etag", "last_modified", "body_hash", "policy_version", "fetched_at")))
    both = old.join(found, "uri", "full")
    new, gone = F.col("outcome") == "Indexed", F.col("outcome") == "Gone"
    value = lambda c, fresh: F.when(F.coalesce(new, F.lit(False)), fresh).when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(F.col(f"old_{c}")).alias(c)
    renewed = lambda c: F.when(F.col("outcome") == "Unchanged", F.coalesce(c, f"old_{c}")).otherwise(value(c, F.col(c))).alias(c)
    return both.select(
        F.lit(store_id).alias("store_id"), F.lit(source_id).alias("source_id"), "uri", F.coalesce("outcome", "old_outcome").alias("outcome"), renewed("etag"), renewed("last_modified"),
        value("body_hash", F.col("body_hash")), value("policy_version", F.lit(policy)), F.coalesce("fetched_at", "old_fetched_at").alias("fetched_at"),
    )


def observed(found: DataFrame) -> DataFrame:
    """uri, status of outcomes as plan_changes() takes them; Gone ones are not observed."""
    status = F.when(F.col("outcome") == "Indexed", "ok").when(F.col("outcome") == "Empty", "empty").when(F.col("outcome") == "Unsupported", "unsupported").when(F.col("outcome").isin("FetchError", "ParseFailed"), "error").otherwise("unchanged")
    return found.filter("outcome <> 'Gone'").select("uri", status.alias("status"))
