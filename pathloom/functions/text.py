"""Scalar functions over text, as Column expressions: file names, table tests, word counts, normal forms.

White space and word characters are ASCII throughout, so results do not depend
on the engine's Unicode tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space.
WS = r"[\x09-\x0D ]"
#: One word.
WORD = r"[^\x09-\x0D ]+"

# Ticker symbols in the order in which they are tried, with their companies.
COMPANIES = {"AAPL": "Apple Inc.", "AMZN": "Amazon.com Inc.", "INTC": "Intel Corporation", "MSFT": "Microsoft Corporation", "NVDA": "NVIDIA Corporation"}
UNKNOWN = "Unknown"
REPORT_TYPE = "10-Q"
# The number patterns of the table tests, a number of up to three digits or with thousands separators.
NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
PERCENT_NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?%?\b"
#: ASCII punctuation without the hyphen.
PUNCTUATION = r"[!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Without white space at both ends (Spark's trim removes blanks only)."""
    return F.regexp_replace(_col(c), rf"^{WS}+|{WS}+$", "")


def squeeze(c: Column | str) -> Column:
    """Words joined by one blank."""
    return F.trim(F.regexp_replace(_col(c), rf"{WS}+", " "))


def words(c: Column | str) -> Column:
    """Array of the words; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(WORD), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(WORD))


def base_filename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+)$", 1)


def ticker(filename: Column | str) -> Column:
    """The first symbol, in the order of COMPANIES, that stands as a word in the name; an underscore is part of a word."""
    return F.coalesce(*[F.when(_col(filename).rlike(rf"(?i)\b{t}\b"), F.lit(t)) for t in COMPANIES], F.lit(UNKNOWN))


def company(symbol: Column | str) -> Column:
    pairs = [F.lit(x) for pair in COMPANIES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(symbol)), F.lit(UNKNOWN))


def fiscal_quarter(filename: Column | str) -> Column:
    """``Q2 2024`` of a name with year and quarter 1 to 3, else Unknown."""
    pattern = r"(?i)(\d{4})[ _]?Q([1-3])"
    year, quarter = (F.regexp_extract(_col(filename), pattern, g) for g in (1, 2))
    return F.when(year != "", F.concat(F.lit("Q"), quarter, F.lit(" "), year)).otherwise(F.lit(UNKNOWN))


def is_table(c: Column | str) -> Column:
    """At least 3 lines, more than half of which hold more than two short numbers."""
    lines = F.split(strip(c), "\n")
    dense = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(NUMBER)) > 2))
    return F.coalesce((F.size(lines) >= 3) & (dense > 0.5 * F.size(lines)), F.lit(False))


def is_table_dense(c: Column | str) -> Column:
    """At least 3 lines, and more than 40 % of them with more than two numbers or more than one number in five words."""
    text = strip(c)
    lines = F.split(text, "\n")
    dense = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(PERCENT_NUMBER)) > 2))
    numbers = F.regexp_count(text, F.lit(PERCENT_NUMBER))
    return F.coalesce((F.size(lines) >= 3) & ((dense > 0.4 * F.size(lines)) | (numbers > word_count(text) / 5)), F.lit(False))


def normalize(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation but hyphens, single blanks; null gives the empty text."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), PUNCTUATION, ""))


def capitalize(c: Column | str) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.left(_col(c), F.lit(1))), F.lower(F.substring(_col(c), 2, 1 << 30)))
