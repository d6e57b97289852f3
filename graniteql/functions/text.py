"""Text expressions, all of them JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams, in order of first occurrence."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def mask_email(text: Column, by: str = "<email>") -> Column:
    return F.regexp_replace(text, EMAIL, by)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)
