"""String and number expressions with the semantics that site rules need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the web platform: Unicode white space and the byte order mark.
SPACE = r"[\s\x{FEFF}]"


def has(c: Column) -> Column:
    """Present: neither null nor empty."""
    return c.isNotNull() & (c != "")


def trim_all(c: Column) -> Column:
    """Trims all Unicode white space; Spark's trim knows the space alone."""
    return F.regexp_replace(c, rf"^(?U){SPACE}+|(?U){SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return trim_all(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def excerpt(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def slug(c: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def table_cell(c: Column) -> Column:
    """Safe in a Markdown table: null is '-', pipes are escaped, line breaks become spaces."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\n", " "), F.lit("-"))


def percent_encoded(c: Column) -> Column:
    """Like encodeURIComponent for what url_encode leaves: spaces become %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def mask_secret(c: Column, secret: Column, mask: str = "***") -> Column:
    """Replaces a token and its URL-encoded form."""
    masked = F.replace(F.replace(c, secret, F.lit(mask)), percent_encoded(secret), F.lit(mask))
    return F.when(has(secret), masked).otherwise(c)


def script_safe(c: Column) -> Column:
    """JSON text that may stand inside a script element."""
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def fixed(c: Column, digits: int) -> Column:
    """The number with so many decimals, halves away from zero; null stays null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", F.round(c, digits)))


def finite(c: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def one_of(c: Column, allowed: list[str]) -> Column:
    """The value, or an error if it is outside the enumeration."""
    return F.when(c.isNull() | c.isin(allowed), c).otherwise(F.raise_error(F.concat(F.lit("value outside the enumeration: "), c)).cast("string"))
