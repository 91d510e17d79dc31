"""Several values packed in one field (problem 7): split, keep positions; built-in expressions only.

The field is split on quote characters. Odd pieces are literals; in even pieces separators become a mark. The pieces are
put together again, split on the mark, cleaned, and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Noncharacters of Unicode: they can't be in a valid text.
_MARK, _QUOTE = "\ufdd0", "\ufdd1"
#: Marks, line ends and the joining word that separate values.
SEPARATOR = r"(?iU)[,;|/&\t\r\n\x{0B}\x{0C}\x{85}\x{2028}\x{2029}、，；・•]|(?<!\S)and(?!\S)"
_BLANKS = r"(?U)^\s+|\s+$"
_BY = r"(?iU)^by(?:[\s:]+|$)"


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, _BLANKS, ""), _BY, ""), _BLANKS, "")


def values(field: Column) -> Column:
    """The values of a packed field in order, as an array; null and empty fields give an empty one.

    A separator inside double quotes separates nothing. Quotes around a whole value are dropped and a doubled quote in
    them stands for one; other quotes stay. A quote that is never closed is an ordinary character. Brackets around the
    whole field and a leading "by" are dropped; so are empty values.
    """
    whole = _bare(F.translate(field, _MARK + _QUOTE, "  "))
    whole = F.regexp_replace(whole, r"(?s)^(?:\[(.*)\]|\{(.*)\}|\((.*)\))$", "$1$2$3")
    pieces = F.split(whole, '"', -1)
    last = F.size(pieces) - 1
    closed = last - last % 2  # pieces from here on are outside: an odd count of quotes leaves the last one open
    rebuilt = F.transform(
        pieces,
        lambda p, i: F.concat(
            F.when((i % 2 == 0) | (i > closed), F.regexp_replace(p, SEPARATOR, _MARK)).otherwise(p),
            F.when(i == last, "").when(i >= closed, '"').otherwise(_QUOTE),
        ),
    )
    cut = F.split(F.array_join(rebuilt, ""), _MARK, -1)

    def clean(value: Column) -> Column:
        inner = F.regexp_replace(_bare(value), f"(?s)^{_QUOTE}((?:[^{_QUOTE}]|{_QUOTE}{_QUOTE})*){_QUOTE}$", "$1")
        return _bare(F.replace(F.replace(inner, F.lit(_QUOTE * 2), F.lit('"')), F.lit(_QUOTE), F.lit('"')))

    return F.coalesce(F.filter(F.transform(cut, clean), lambda v: v != ""), F.array().cast("array<string>"))


def unpack(df: DataFrame, key: str, field: str, position: str = "position", value: str = "value") -> DataFrame:
    """Distinct rows ``key, position, value``: one for each value of the field, numbered from 1.

    Other columns are ignored. Rows are handled alone; only the removal of repeated rows shuffles, after a partial one
    on the map side.
    """
    rows = df.select(F.col(key).alias("_k"), F.posexplode(values(F.col(field))).alias("_p", "_v"))
    return rows.select(F.col("_k").alias(key), (F.col("_p") + 1).cast("int").alias(position), F.col("_v").alias(value)).distinct()
