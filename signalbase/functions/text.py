"""Column functions over text and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _query_pairs(query: Column, drop: tuple[str, ...]) -> Column:
    """A url's query, decoded and encoded again, without tracking parameters."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    named = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, r"=(.*)$", 1)).alias("v")))
    kept = F.filter(named, lambda p: ~F.lower(p["k"]).startswith(config.TRACKING_PREFIX) & ~F.lower(p["k"]).isin(*drop))
    return F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def normalize_url(url: Column, drop: tuple[str, ...] = config.TRACKING_INGEST, loader: bool = False) -> Column:
    """The key under which two urls are one page: host in lower case without ``www.``,
    path without final slash and kept query; no scheme, fragment or tracking parameters.

    A root path is '/', and no slash leads. ``loader``'s form has '' for a root path and
    the slashes before the host, and '' for no url.
    """
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?]*)?([^?]*)(?:\?(.*))?$", i)
    host = F.regexp_replace(F.lower(F.substring(part(1), 3, 1 << 20)), r"^www\.", "")
    path = F.rtrim(part(2), F.lit("/"))
    pairs = _query_pairs(part(3), drop)
    query = F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise("")
    if loader:
        return F.coalesce(F.concat(F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, query), F.lit(""))
    return F.ltrim(F.concat(host, F.when(path == "", "/").otherwise(path), query), F.lit("/"))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://[^/?#]+"), F.lit(False))


def domain(url: Column) -> Column:
    """Authority in lower case, without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def title_from_slug(url: Column) -> Column:
    """Words of a url's last path part; only the first letter is raised."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    slug = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.html?$", ""), r"_\d+_\d+$", "")
    words = F.trim(F.translate(slug, "-_", "  "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 20))


def news_id(url: Column) -> Column:
    """An id that all urls of one page share."""
    return F.concat(F.lit("N-"), F.left(F.sha1(normalize_url(url)), F.lit(12)))


def group_id(least_member: Column) -> Column:
    return F.concat(F.lit("G-"), F.left(F.sha2(least_member, 256), F.lit(12)))


def indicator_id(country: Column, indicator: Column, year: Column) -> Column:
    return F.concat_ws("-", F.lit("IND"), country, indicator, year.cast("string"))


def unaccent(text: Column) -> Column:
    """Lower case without marks, for characters that decompose into one."""
    return F.translate(F.lower(text), config.MARKED, config.PLAIN)


def provenance(outlet: Column, title: Column, url: Column) -> Column:
    """An agency's mark as a whole word of title or url, else the outlet."""
    text = F.upper(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    found = None
    for mark, name in config.AGENCIES:
        hit, value = text.rlike(rf"(^|[^A-Za-z0-9]){mark}([^A-Za-z0-9]|$)"), F.lit(f"agencia:{name}")
        found = F.when(hit, value) if found is None else found.when(hit, value)
    return found.otherwise(F.coalesce(F.nullif(outlet, F.lit("")), F.lit("desconocido")))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds any of the words, as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return hit


def place_tokens(text: Column, generic: tuple[str, ...] = config.GENERIC_PLACES) -> Column:
    words = F.regexp_extract_all(unaccent(F.coalesce(text, F.lit(""))), F.lit(r"([a-z]{4,})"), 1)
    return F.array_except(words, F.array(*(F.lit(g) for g in generic)))


def magnitudes(title: Column) -> Column:
    """Magnitudes that a headline states, comma or dot decimals."""
    text = unaccent(F.coalesce(title, F.lit("")))
    # fixed values: how headlines state a magnitude
    patterns = (r"magnitud(?:\s+de)?\s+(\d+(?:[.,]\d+)?)", r"(\d+(?:[.,]\d+)?)\s+(?:grados?|de\s+magnitud)", r"(?:sismos?|temblor(?:es)?|terremotos?)\s+de\s+(\d+[.,]\d+)")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), 1) for p in patterns))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def split_list(text: Column, mark: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), F.trim), lambda x: x != "")


def query_terms(text: Column, stop: tuple[str, ...] = config.STOP_WORDS) -> Column:
    """Distinct plain terms of three letters or more that are no stop words."""
    words = F.array_distinct(F.regexp_extract_all(unaccent(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9]+)"), 1))
    stops = F.array(*(F.lit(s) for s in stop)) if stop else F.array().cast("array<string>")
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stops)


def neutralize(text: Column, marks: tuple[str, str] = ("<<<", ">>>"), limit: int = 400) -> Column:
    """Prompt-safe text: delimiters broken up, long texts cut with an ellipsis."""
    safe = F.replace(F.replace(text, F.lit(marks[0]), F.lit("‹‹‹")), F.lit(marks[1]), F.lit("›››"))
    return F.when(F.length(safe) > limit, F.concat(F.left(safe, F.lit(limit)), F.lit("…"))).otherwise(safe)
