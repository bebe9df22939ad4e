"""URL functions: column expressions over normalised URLs, and Arrow UDFs that normalise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions import url_kernel

_ORIGIN = r"^(https?://[^/?#]+)"
# Path endings that navigation doesn't follow.
ASSET_ENDINGS = r"\.(css|js|mjs|png|jpe?g|gif|webp|avif|svg|pdf|zip|gz|tar|tgz|woff2?|ttf|otf|eot|mp4|webm|mp3|wav|ogg)$"


@F.pandas_udf(T.StringType())
def normalize_url(raw: pd.Series, base: pd.Series) -> pd.Series:
    """Resolves and normalises; null where the text is no http(s) URL without credentials."""
    return pd.Series([url_kernel.normalize(r, b) for r, b in zip(raw, base, strict=True)], dtype=object)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, _ORIGIN, 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)


def path(url: Column) -> Column:
    """Path of a normalised URL; '/' where it is missing."""
    found = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_segments(url: Column) -> Column:
    return F.size(segments(url))


def query_keys(url: Column) -> Column:
    """Names of query parameters, repeats included, in order."""
    return F.transform(F.filter(F.split(query(url), "&"), lambda p: p != ""), lambda p: F.regexp_extract(p, "^([^=]*)", 1))


def query_param_count(url: Column) -> Column:
    return F.size(query_keys(url))


def directory(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^(.*/)", 1)


def path_pattern(url: Column) -> Column:
    """Path with numeric segments as :number and segments over 24 characters as :long."""
    kind = F.transform(F.split(path(url), "/"), lambda s: F.when(s.rlike("^[0-9]+$"), ":number").when(F.length(s) > 24, ":long").otherwise(s))
    return F.array_join(kind, "/")


def query_pattern(url: Column) -> Column:
    return F.array_join(F.array_sort(query_keys(url)), "&")


def is_navigation(url: Column) -> Column:
    return ~F.lower(path(url)).rlike(ASSET_ENDINGS)


def glob_regex(pattern: str) -> str:
    """A glob over whole URLs: '*' is any text, everything else itself, case-sensitive."""
    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def make_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 24))
