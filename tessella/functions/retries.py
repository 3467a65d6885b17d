"""Which failed calls are tried again, and when: errors unwrapped, classed by status, message and what they say themselves, waits with Retry-After."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import register
from .fixed import PASSING, RATE_LIMITED
from .pages import mapped

#: Errors looked at within one, and how many of a list.
MOST_ERRORS, MOST_LISTED = 8, 4
#: Attempts, first wait and longest wait of calls to models and to searches.
MODEL_RETRIES, SEARCH_RETRIES = (6, 1_000, 30_000), (5, 500, 15_000)
SHAPE = "struct<name: string, message: string, status: int, retryable: boolean, after: string>"


def unwrapped(error: str) -> list[dict]:
    """(name, message, status, retryable, after) of an error written as JSON and of those that it names as its causes, the nearest first."""
    queue, out = deque([json.loads(error)]), []
    while queue and len(out) < MOST_ERRORS:
        one = queue.popleft()
        if not isinstance(one, dict):
            continue
        headers = one.get("responseHeaders") if isinstance(one.get("responseHeaders"), dict) else {}
        status, says, message = one.get("statusCode"), one.get("isRetryable"), one.get("message")
        after = headers.get("retry-after") or headers.get("Retry-After")
        out.append({"name": one.get("name"), "message": message if isinstance(message, str) else "", "status": status if type(status) is int else None, "retryable": says if isinstance(says, bool) else None, "after": after})
        listed = one.get("errors")
        queue.extend(x for x in (one.get("cause"), one.get("lastError"), *(listed[:MOST_LISTED] if isinstance(listed, list) else ())) if x)
    return out


def unwrap(errors: DataFrame, key: str, error: str) -> DataFrame:
    """(key, errors) of rows with an error as JSON."""
    return mapped(errors.select(key, error), f"{key} {dict(errors.dtypes)[key]}, errors array<{SHAPE}>", lambda k, e: (k, unwrapped(e)))


def retry_after_ms(raw: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, by seconds or by a date; null if it says neither."""
    seconds = F.trim(raw).try_cast("double")
    day = F.regexp_extract(raw, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1)
    at = F.coalesce(F.try_to_timestamp(F.concat(F.lpad(day, 20, "0"), F.lit(" +00:00")), F.lit("dd MMM yyyy HH:mm:ss XXX")), F.trim(raw).try_cast("timestamp"))
    until = F.unix_millis(at) - F.unix_millis(now)
    number = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    asked = F.when(number, seconds * 1000).otherwise(until.cast("double"))
    return F.when((F.length(raw) > 0) & asked.isNotNull(), F.greatest(F.lit(0.0), asked))


def classed(errors: Column, now: Column) -> Column:
    """(retryable, rate_limit, retry_after_ms) of a failure by its unwrapped errors.

    What was broken off or timed out isn't tried again. Else the first error that says itself whether it may be decides, else any status or message of those that pass.
    """
    after = F.try_element_at(F.filter(F.transform(errors, lambda e: retry_after_ms(e["after"], now)), lambda x: x.isNotNull()), F.lit(1))
    said = F.try_element_at(F.filter(F.transform(errors, lambda e: e["retryable"]), lambda x: x.isNotNull()), F.lit(1))
    message = F.lower(F.array_join(F.transform(errors, lambda e: F.coalesce(e["message"], F.lit(""))), "\n"))
    status = F.exists(errors, lambda e: F.coalesce(e["status"].isin(408, 409, 429) | (e["status"] >= 500), F.lit(False)))
    limited = F.exists(errors, lambda e: F.coalesce(e["status"] == 429, F.lit(False))) | message.rlike(RATE_LIMITED)
    broken_off = F.coalesce(F.try_element_at(errors, F.lit(1))["name"].isin("AbortError", "TimeoutError"), F.lit(False))
    again = ~broken_off & F.coalesce(said, status | message.rlike(PASSING))
    return F.struct(again.alias("retryable"), (again & limited).alias("rate_limit"), F.when(again, after).alias("retry_after_ms"))


def search_classed(name: Column, status: Column, message: Column, after_ms: Column) -> Column:
    """(retryable, retry_after_ms) of a failed search: one that got an answer by its status alone, another by its message."""
    broken_off = F.coalesce(name.isin("AbortError", "TimeoutError"), F.lit(False))
    again = ~broken_off & F.when(status.isNotNull(), status.isin(408, 409, 429) | (status >= 500)).otherwise(F.lower(F.coalesce(message, F.lit(""))).rlike(PASSING))
    return F.struct(again.alias("retryable"), F.when(again & status.isNotNull(), after_ms).alias("retry_after_ms"))


def wait_ms(attempt: Column, after_ms: Column, draw: Column, base: int, most: int) -> Column:
    """How long to wait before the next attempt: between half and all of a doubling time, as long as the answer asks for, never longer than ``most``."""
    doubling = F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1))
    return F.least(F.lit(float(most)), F.greatest(F.coalesce(after_ms, F.lit(0.0)), doubling / 2 + draw * (doubling / 2)))


def _failures(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    inner = F.struct(F.col("event_type").alias("message"), F.when(i % 13 == 0, F.lit(False)).when(i % 13 == 1, F.lit(True)).alias("isRetryable"))
    headers = F.struct(F.when(i % 3 == 0, (i % 7).cast("string")).alias("retry-after"))
    outer = F.struct(F.when(i % 11 == 0, "AbortError").otherwise("Error").alias("name"), pick("Rate limit hit", "no", "Socket hang up", "bad request").alias("message"), F.when(i % 5 > 0, pick(0, 429, 503, 400, 408)).alias("statusCode"), headers.alias("responseHeaders"), inner.alias("cause"))
    return e.select("event_id", F.to_json(outer).alias("error"))


SQL = """WITH f AS (SELECT event_id, event_id % 11 = 0 AS aborted, CASE event_id % 13 WHEN 0 THEN false WHEN 1 THEN true END AS said, CASE WHEN event_id % 5 > 0 THEN [0, 429, 503, 400, 408][event_id % 5 + 1] END AS status,
  event_id % 4 AS m, CASE WHEN event_id % 3 = 0 THEN 1000.0::DOUBLE * (event_id % 7) END AS after FROM events),
r AS (SELECT event_id, NOT aborted AND coalesce(said, coalesce(status IN (408, 409, 429) OR status >= 500, false) OR m IN (0, 2)) AS retryable, coalesce(status = 429, false) OR m = 0 AS limited, after FROM f)
SELECT event_id, retryable, retryable AND limited AS rate_limit, CASE WHEN retryable THEN after END AS retry_after_ms, CASE WHEN retryable THEN least(30000.0::DOUBLE, greatest(coalesce(after, 0), 0.75::DOUBLE * least(30000.0::DOUBLE, 1000 * pow(2, event_id % 6)))) END AS wait_ms FROM r"""


def _retried(e: DataFrame) -> DataFrame:
    c = unwrap(_failures(e), "event_id", "error").select("event_id", classed(F.col("errors"), F.lit("2024-01-01").cast("timestamp")).alias("c")).select("event_id", "c.*")
    _, base, most = MODEL_RETRIES
    return c.withColumn("wait_ms", F.when(F.col("retryable"), wait_ms(F.col("event_id") % 6 + 1, F.col("retry_after_ms"), F.lit(0.5), base, most)))


register("fn26_retries", "events", _retried, SQL)
