"""Text and URL helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webtally.functions import fixed


def join_text(*parts: Column, separator: str = "") -> Column:
    """Concatenation that is NULL when any part is NULL."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit(separator), part] if separator else [part]
    return F.concat(*pieces)


def page_path(url: Column) -> Column:
    """Path of a URL: scheme, host and query removed, fragment kept."""
    return F.regexp_replace(url, r"^https?://[^/]+|[?].*", "")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "")


def without_query_and_fragment(url: Column) -> Column:
    return F.regexp_replace(without_query(url), r"#.*$", "")


def tidy_url(url: Column) -> Column:
    """Lower case, no query, no trailing slash."""
    return F.regexp_replace(without_query(F.lower(url)), r"/$", "")


def transform_url(url: Column, part: str) -> Column:
    """``url`` without its ``parameters``, ``protocol``, ``domain`` or ``all`` of them; NULL for any other name."""
    if part not in fixed.URL_PARTS:
        return F.lit(None).cast("string")
    for pattern, left in fixed.URL_PARTS[part]:
        url = F.regexp_replace(url, pattern, left)
    return url


def is_promo(text: Column, pattern: str = fixed.PROMO_PATTERN) -> Column:
    """True when the text names a promotion; NULL for NULL text."""
    return text.rlike(pattern)
