"""JSON texts as trees that keep repeated names and the text of numbers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa


def texts(values: Iterable[str | None]) -> pa.Array:
    """An Arrow array of strings; halves of surrogate pairs, which JSON's escapes can name, become those escapes again."""
    values = list(values)
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else whole(v) for v in values], pa.string())


def whole(text: str) -> str:
    return text.encode("utf-8", "backslashreplace").decode()


class _Object(list):
    """A JSON object as its (name, value) pairs, so that repeated names are kept."""


def _bad(constant: str):
    raise ValueError(constant)


# Numbers keep their text: 5 and 5.0 stay apart and no precision is lost.
class _Number(str):
    pass


_decoder = json.JSONDecoder(object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_bad)
_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r'[^\[\]{},:"\s]+')


def _deep(text: str):
    """The same as the decoder, with a stack of its own: for texts nested deeper than the interpreter can recurse."""
    top: list = []
    stack: list[tuple[list, bool]] = [(top, False)]
    names: list[str] = []
    at, want = 0, "value"
    while True:
        at = _SPACE.match(text, at).end()
        if at == len(text):
            break
        into, is_object = stack[-1]
        c = text[at]
        if want in ("value", "value or end") and c in "[{":
            fresh = _Object() if c == "{" else []
            into.append((names.pop(), fresh) if is_object else fresh)
            stack.append((fresh, c == "{"))
            want, at = ("name or end" if c == "{" else "value or end"), at + 1
        elif c in "]}" and len(stack) > 1 and is_object == (c == "}") and want in ("next", "value or end", "name or end"):
            stack.pop()
            want, at = "next", at + 1
        elif want == "next" and c == "," and len(stack) > 1:
            want, at = ("name" if is_object else "value"), at + 1
        elif want in ("name", "name or end") and c == '"':
            name, at = _decoder.raw_decode(text, at)
            at = _SPACE.match(text, at).end()
            if text[at : at + 1] != ":":
                raise ValueError(at)
            names.append(name)
            want, at = "value", at + 1
        elif want in ("value", "value or end") and c not in "]},:":
            value, at = _decoder.raw_decode(text, at)
            into.append((names.pop(), value) if is_object else value)
            want = "next"
        else:
            raise ValueError(at)
    if len(stack) != 1 or len(top) != 1:
        raise ValueError("incomplete")
    return top[0]


def parse(text: str | None):
    """The value of a complete JSON text, else None."""
    if text is None:
        return None
    try:
        return _decoder.decode(text)
    except RecursionError:
        try:
            return _deep(text)
        except ValueError:
            return None
    except ValueError:
        return None


def leaves(value, path: str) -> Iterator[tuple[str, str, str | None, float | None]]:
    """(path, kind, text, number) of every scalar below a parsed value, in order, with a stack of its own."""
    stack = [(path, value)]
    while stack:
        at, node = stack.pop()
        if isinstance(node, _Object):
            stack.extend((f"{at}.{k}" if at else k, v) for k, v in reversed(node))
        elif isinstance(node, list):
            stack.extend((f"{at}[{i}]", v) for i, v in reversed(list(enumerate(node))))
        elif isinstance(node, _Number):
            yield at, "number", str(node), float(node)
        elif isinstance(node, bool):
            yield at, "bool", "true" if node else "false", None
        elif node is None:
            yield at, "null", None, None
        else:
            yield at, "string", node, None
