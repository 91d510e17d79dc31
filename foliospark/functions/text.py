"""Words, tokens and tag keys as column expressions (no Python in the data path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a longest run of letters and digits with at least two characters.
WORD = r"[\p{L}\p{N}]{2,}"
#: A search token. Only letters and decimal digits of the basic plane belong to it.
TOKEN = r"[[\p{L}\p{Nd}]&&[\x{0000}-\x{FFFF}]]{2,}"
#: White space at the ends, in the Unicode sense.
ENDS = r"(?U)^\s+|\s+$"


def words(text: Column) -> Column:
    """All words of a text in order, lower case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """All search tokens of a text in order, lower case; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, ENDS, "")


def folded(text: Column) -> Column:
    """Upper case, ends stripped, every run of white space as one blank: the form in which labels are compared."""
    return F.upper(F.regexp_replace(strip(text), r"(?U)\s+", " "))


def tag_key(tag: Column) -> Column:
    """The form in which tags are compared: stripped, case ignored."""
    return F.upper(strip(tag))


def tag_keys(tags: Column) -> Column:
    """Distinct keys of a document's tags; null and blank tags have none, a null list is empty."""
    keys = F.array_distinct(F.transform(F.filter(tags, lambda t: t.isNotNull()), tag_key))
    return F.coalesce(F.filter(keys, lambda t: t != ""), F.array().cast("array<string>"))
