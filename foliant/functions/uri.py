"""Web and mail addresses in visible words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant import constants as K

EMAIL, WEB, DOMAIN = rf"\A{K.EMAIL}\z", rf"(?i)\A{K.WEB}\z", rf"\A{K.DOMAIN}\z"
SUPPORTED = rf"(?i)\A{K.SUPPORTED}"


def bare_value(raw: Column) -> Column:
    """A word without the brackets, quotes and punctuation that may enclose an address."""
    trimmed = F.regexp_replace(raw, r"\A\s+|\s+\z", "")
    return F.rtrim(F.ltrim(trimmed, F.lit(K.LEADING_URL_PUNCTUATION)), F.lit(K.TRAILING_URL_PUNCTUATION))


def _domain(value: Column) -> Column:
    tld = F.lower(F.regexp_extract(value, r"\A[^/:]*\.([^./:]+)(?:[:/]|\z)", 1))
    return value.rlike(DOMAIN) & ~tld.isin(*K.BLOCKED_FILE_TLDS)


def normalized_uri(raw: Column, allow_bare_domains: bool = False) -> Column:
    """The address that a word stands for (mailto, http, https), or null."""
    value = bare_value(raw)
    out = F.when(value.rlike(EMAIL), F.concat(F.lit("mailto:"), value)).when(value.rlike(WEB), F.when(value.rlike("(?i)\\Ahttps?://"), value).otherwise(F.concat(F.lit("https://"), value)))
    return out.when(_domain(value), F.concat(F.lit("https://"), value)) if allow_bare_domains else out


def bare_domain(raw: Column) -> Column:
    """Whether a word is an address only when bare domains are allowed."""
    return normalized_uri(raw, True).isNotNull() & normalized_uri(raw).isNull()


def supported_uri(uri: Column) -> Column:
    """http, https and ftp with a host, mailto with an ``@``; null is not supported."""
    return F.coalesce(uri.rlike(SUPPORTED), F.lit(False))
