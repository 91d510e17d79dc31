"""Documents in the Protocol Buffers wire format: one message with a ``Struct`` for the data."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the message: numbers of its fields, of those of Struct's entries, and of the kinds of a Value.
ID, REV, DELETED, DATA, TAGS, CONTENT = range(1, 7)
FIELDS, KEY, VALUE, VALUES = 1, 1, 2, 1
NULL, NUMBER, STRING, BOOL, STRUCT, LIST = range(1, 7)
# Fixed values of the wire format: ways a field's value is laid out.
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, raw: bytes) -> bytes:
    return _varint(number << 3 | BYTES) + _varint(len(raw)) + raw


def _value(v) -> bytes:
    if v is None:
        return _varint(NULL << 3) + b"\0"
    if isinstance(v, bool):
        return _varint(BOOL << 3) + bytes([v])
    if isinstance(v, (int, float)):
        return _varint(NUMBER << 3 | FIXED64) + struct.pack("<d", v)
    if isinstance(v, str):
        return _field(STRING, v.encode("utf-8", "replace"))
    if isinstance(v, dict):
        return _field(STRUCT, _struct(v))
    return _field(LIST, b"".join(_field(VALUES, _value(x)) for x in v))


def _struct(d: dict) -> bytes:
    return b"".join(_field(FIELDS, _field(KEY, k.encode("utf-8", "replace")) + _field(VALUE, _value(v))) for k, v in d.items())


def encode(doc: dict) -> bytes:
    """A document (``id, rev, deleted, data, tags, content``) as a message. Null and empty texts are left out alike; all
    numbers become doubles; null tags become empty ones."""
    out = b"".join(_field(n, doc[c].encode()) for n, c in ((ID, "id"), (REV, "rev")) if doc.get(c))
    if doc.get("deleted"):
        out += _varint(DELETED << 3) + b"\1"
    if doc.get("data") is not None:
        out += _field(DATA, _struct(doc["data"]))
    out += b"".join(_field(TAGS, (t or "").encode()) for t in doc.get("tags") or ())
    return out + (_field(CONTENT, doc["content"].encode()) if doc.get("content") else b"")


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(raw):
            raise ValueError("the data ends too early")
        n |= (raw[at] & 0x7F) << shift
        shift, at = shift + 7, at + 1
        if raw[at - 1] < 0x80:
            return n, at


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(raw):
        tag, at = _read_varint(raw, at)
        how = tag & 7
        if how == VARINT:
            value, at = _read_varint(raw, at)
        else:
            if how == BYTES:
                n, at = _read_varint(raw, at)
            elif how in (FIXED64, FIXED32):
                n = 8 if how == FIXED64 else 4
            else:
                raise ValueError(f"unknown wire type {how}")
            value, at = raw[at : at + n], at + n
            if at > len(raw):
                raise ValueError("the data ends too early")
        yield tag >> 3, value


def _read_value(raw: bytes):
    for kind, v in _fields(raw):
        if kind == NUMBER:
            n = struct.unpack("<d", v)[0]
            return int(n) if n.is_integer() and abs(n) < 2**53 else n
        if kind == STRING:
            return v.decode()
        if kind == BOOL:
            return bool(v)
        if kind == STRUCT:
            return _read_struct(v)
        if kind == LIST:
            return [_read_value(x) for n, x in _fields(v) if n == VALUES]
    return None


def _read_struct(raw: bytes) -> dict:
    out = {}
    for number, entry in _fields(raw):
        if number == FIELDS:
            own = dict(_fields(entry))
            out[own.get(KEY, b"").decode()] = _read_value(own.get(VALUE, b""))
    return out


def decode(raw: bytes) -> dict:
    """The document of a message; unknown fields are skipped, empty texts and lists are null. Lists keep the kinds of
    their elements, whole doubles come back as whole numbers."""
    doc: dict = {"id": "", "rev": None, "deleted": False, "data": None, "tags": None, "content": None}
    for number, v in _fields(raw):
        if number in (ID, REV, CONTENT):
            doc[{ID: "id", REV: "rev", CONTENT: "content"}[number]] = v.decode() or (None if number != ID else "")
        elif number == DELETED:
            doc["deleted"] = bool(v)
        elif number == DATA:
            doc["data"] = _read_struct(v)
        elif number == TAGS:
            doc["tags"] = [*(doc["tags"] or ()), v.decode()]
    return doc


def to_proto(docs: DataFrame, column: str = "message") -> DataFrame:
    """``id`` and the message of each document. A broken or non-object ``data_json`` counts as none."""

    def run(ids: pd.Series, revs: pd.Series, dead: pd.Series, data: pd.Series, tags: pd.Series, content: pd.Series) -> pd.Series:
        def one(i, r, x, d, t, c) -> bytes:
            try:
                parsed = json.loads(d) if d else None
            except ValueError:
                parsed = None
            return encode({"id": i, "rev": r, "deleted": x, "data": parsed if isinstance(parsed, dict) else None, "tags": None if t is None else list(t), "content": c})

        return pd.Series([one(*row) for row in zip(ids, revs, dead, data, tags, content)])

    return docs.select("id", F.pandas_udf(run, "binary")("id", "rev", "deleted", "data_json", "tags", "content").alias(column))


def from_proto(rows: DataFrame, column: str = "message") -> DataFrame:
    """Documents of messages."""

    def run(raw: pd.Series) -> pd.DataFrame:
        docs = [decode(bytes(b)) for b in raw]
        data = [None if d["data"] is None else json.dumps(d["data"], ensure_ascii=False) for d in docs]
        return pd.DataFrame({"id": [d["id"] for d in docs], "rev": [d["rev"] for d in docs], "deleted": [d["deleted"] for d in docs], "data_json": data, "tags": [d["tags"] for d in docs], "content": [d["content"] for d in docs]})

    schema = "id string, rev string, deleted boolean, data_json string, tags array<string>, content string"
    return rows.select(F.pandas_udf(run, schema)(column).alias("_d")).select("_d.*")
