"""Column expressions on text: terms, tokens, windows, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of a retrieval window and how far the next begins after it, in code points.
WINDOW, STEP = 900, 700
#: Length of a stored chunk.
CHUNK = 12_000


def words(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` occurs in ``text`` without overlaps; 0 for an empty needle."""
    lost = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (lost / F.length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def window_starts(n: Column, width: int = WINDOW, step: int = STEP) -> Column:
    """Starts of overlapping windows up to the one that reaches the end; none of an empty text."""
    last = F.greatest(F.lit(0), F.ceil((n - width) / step)) * step
    return F.when(n > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))


def query_terms(query: Column) -> Column:
    """Quoted phrases and then single terms of two characters or more, lower-cased, each once."""
    phrases = F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), 1), lambda p: F.lower(F.trim(p)))
    single = F.transform(F.split(F.regexp_replace(query, '"[^"]+"', " "), r"[^\p{L}\p{N}_-]+"), F.lower)
    return F.array_distinct(F.concat(F.filter(phrases, lambda p: p != ""), F.filter(single, lambda t: F.length(t) >= 2)))


def canonical_query(query: Column) -> Column:
    """The distinct tokens of a query in order: queries of equal tokens are one."""
    return F.array_join(F.array_sort(F.array_distinct(words(F.lower(query)))), " ")


def trail_key(query: Column) -> Column:
    """canonical_query() without bare years; of a query of nothing else its trimmed text."""
    tokens = F.filter(words(F.lower(query)), lambda t: ~t.rlike(r"^(?:19|20)\d{2}$"))
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(tokens)), " "), F.lit("")), F.lower(F.trim(query)))


def host(url: Column) -> Column:
    """The host of an http(s) URL in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """A clean http(s) URL without fragment and tracking parameters, its other parameters sorted by name, stably.

    For URLs whose serialisation needs more than that (ports, escapes), pages.canonical() parses in full.
    """
    bare = F.regexp_replace(url, r"#.*$", "")
    base, query = F.split_part(bare, F.lit("?"), F.lit(1)), F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[^=]*|fbclid|gclid|igshid|mc_cid|mc_eid|msclkid)(=|$)"))
    named = F.transform(params, lambda p, i: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), i.alias("i"), p.alias("p")))
    kept = F.array_join(F.transform(F.array_sort(named), lambda x: x["p"]), "&")
    path = F.regexp_extract(base, r"(?i)^https?://[^/]*(/.*)?$", 1)
    whole = F.concat(F.lower(F.regexp_extract(base, r"(?i)^(https?://[^/]*)", 1)), F.when(path == "", "/").otherwise(path))
    return F.when(host(url).isNull(), url).otherwise(F.concat(whole, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))
