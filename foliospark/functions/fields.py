"""Fields of a document: paths into its JSON, string forms, numbers, string leaves. Built-in expressions only."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.json_tree import leaves, parse
from foliospark.functions.text import tokens

# Texts that .NET's float style reads as a number, apart from NaN and infinity.
_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_STEP = re.compile(r"\[(\d+)\]$")
#: Dotted parts up to which a path is expanded to all it may mean; longer ones are walked.
EXPANDED = 4


def _quoted(name: str) -> str:
    return f'["{name}"]' if "'" in name else f"['{name}']"


def json_paths(path: str) -> list[str]:
    """The JSON paths that a dotted path may mean: dots part names or belong to them."""
    parts = path.split(".")
    out = []
    for cuts in range(1 << (len(parts) - 1)):
        names, current = [], parts[0]
        for i, part in enumerate(parts[1:]):
            if cuts >> i & 1:
                current += "." + part
            else:
                names.append(current)
                current = part
        steps = ""
        for name in [*names, current]:
            places = ""
            while m := _STEP.search(name):
                places, name = f"[{m[1]}]{places}", name[: m.start()]
            steps += (_quoted(name) if name else "") + places
        out.append("$" + steps)
    return out


def variant(data_json: Column) -> Column:
    """The parsed JSON, null if it is not complete JSON."""
    return F.try_parse_json(data_json)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _walked(data_json: Column, path: str, kinds: tuple[str, ...]) -> Column:
    """The text of the scalar at a dotted path, by a walk over the parsed values; for paths of many parts."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: next((text for at, kind, text, _ in leaves(parse(t), "") if at == path and kind in kinds), None) if t else None)

    return F.pandas_udf(run, "string")(data_json)


def path_text(data_json: Column, path: str) -> Column:
    """The indexed string at a path below the data: of strings and booleans only, else null."""
    if path.count(".") >= EXPANDED:
        return _walked(data_json, path, ("string", "bool"))
    v = variant(data_json)
    found = []
    for p in json_paths(path):
        at = F.try_variant_get(v, p, "variant")
        found.append(F.when(_kind(at).isin("STRING", "BOOLEAN"), F.try_variant_get(v, p, "string")))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def path_number(data_json: Column, path: str) -> Column:
    """The indexed number at a path below the data: of JSON numbers only, else null."""
    if path.count(".") >= EXPANDED:
        return _walked(data_json, path, ("number",)).try_cast("double")
    v = variant(data_json)
    found = []
    for p in json_paths(path):
        at = F.try_variant_get(v, p, "variant")
        found.append(F.when(_kind(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, p, "double")))
    return F.coalesce(*found) if len(found) > 1 else found[0]


def top_text(data_json: Column, field: str) -> Column:
    """The string form of a top-level field: text of strings, raw JSON of the rest, empty for null, null if missing."""
    p = "$" + _quoted(field)
    return F.coalesce(F.get_json_object(data_json, p), F.when(F.is_variant_null(F.try_variant_get(variant(data_json), p, "variant")), ""))


def to_number(text: Column) -> Column:
    """The number a text means, null if it is none. Endings like ``7d`` and names like ``NaN`` are no numbers."""
    return F.when(text.rlike(_FLOAT), F.trim(text).try_cast("double"))


def top_number(data_json: Column, field: str) -> Column:
    """A top-level field as a number: JSON numbers and numeric strings, else null."""
    p = "$" + _quoted(field)
    at = F.try_variant_get(variant(data_json), p, "variant")
    return F.when(_kind(at).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)"), to_number(F.get_json_object(data_json, p)))


def string_leaves(data_json: Column) -> Column:
    """All string values in a JSON text at any depth, names and other values left out; empty if it is not complete JSON.

    Escapes that stand for separators become blanks first, so that a string is a run without quotes; letters written as
    ``\\u`` escapes are then decoded.
    """
    plain = F.regexp_replace(F.regexp_replace(data_json, r"\\\\", " "), r'\\["nrtbf/]', " ")
    names_too = F.regexp_extract_all(plain, F.lit(r'"[^"]*"(?:\s*:)?'), F.lit(0))
    leaves = F.transform(F.filter(names_too, lambda s: ~s.endswith(":")), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
    decoded = F.transform(leaves, lambda s: F.when(s.contains("\\u"), F.coalesce(F.get_json_object(F.concat(F.lit('["'), s, F.lit('"]')), "$[0]"), s)).otherwise(s))
    return F.when(variant(data_json).isNotNull(), decoded).otherwise(F.array().cast("array<string>"))


def searchable_tokens(data_json: Column, tags: Column, content: Column) -> Column:
    """Distinct search tokens of a document: of every string in its data, its tags and its content."""
    return F.array_distinct(tokens(F.concat_ws("\n", string_leaves(data_json), tags, content)))
