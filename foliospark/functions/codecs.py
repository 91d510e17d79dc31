"""Documents and columns in binary forms: tagged binary fields, gzip."""

from __future__ import annotations

import gzip
import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: field numbers, then kinds of values.
VERSION, ID, REV, DELETED, DATA, TAGS, CONTENT = 1, 2, 3, 4, 5, 6, 7
NULL, STRING, INT, DOUBLE, BOOL, STRINGS, DICT, LIST = range(8)
_I, _D = struct.Struct("<i"), struct.Struct("<d")


def _text(value: str) -> bytes:
    raw = value.encode("utf-8", "replace")
    return _I.pack(len(raw)) + raw


def _value(v) -> bytes:
    if v is None:
        return bytes([NULL])
    if isinstance(v, bool):
        return bytes([BOOL, v])
    if isinstance(v, str):
        return bytes([STRING]) + _text(v)
    if isinstance(v, int):
        if not -(2**31) <= v < 2**31:
            if -(2**63) <= v < 2**63:
                raise OverflowError(f"{v} is no 32-bit integer")
            return bytes([DOUBLE]) + _D.pack(float(v))
        return bytes([INT]) + _I.pack(v)
    if isinstance(v, float):
        return bytes([DOUBLE]) + _D.pack(v)
    if isinstance(v, dict):
        raw = _dict(v)
        return bytes([DICT]) + _I.pack(len(raw)) + raw
    return bytes([LIST]) + _I.pack(len(v)) + b"".join(_value("" if x is None else x) for x in v)


def _dict(d: dict) -> bytes:
    return _I.pack(len(d)) + b"".join(_text(k) + _value(v) for k, v in d.items())


def encode(doc: dict) -> bytes:
    """A document (``id, rev, deleted, data, tags, content``) as tagged fields. Empty fields are left out.

    Whole numbers must fit 32 bits; nulls in lists become empty strings.
    """
    out = bytes([VERSION]) + _I.pack(1) + b"\x01"

    def field(number: int, raw: bytes) -> bytes:
        return bytes([number]) + _I.pack(len(raw)) + raw

    if doc.get("id"):
        out += field(ID, doc["id"].encode())
    if doc.get("rev"):
        out += field(REV, doc["rev"].encode())
    out += field(DELETED, bytes([bool(doc.get("deleted"))]))
    if doc.get("data"):
        out += field(DATA, _dict(doc["data"]))
    if doc.get("tags"):
        out += field(TAGS, _I.pack(len(doc["tags"])) + b"".join(_text(t or "") for t in doc["tags"]))
    if doc.get("content"):
        out += field(CONTENT, doc["content"].encode())
    return out


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("the data ends too early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def int(self) -> int:
        return _I.unpack(self.take(4))[0]

    def text(self, n: int | None = None) -> str:
        return self.take(self.int() if n is None else n).decode("utf-8")

    def dict(self) -> dict:
        out = {}
        for _ in range(self.int()):
            key = self.text()
            out[key] = self.value()
        return out

    def value(self):
        kind = self.take(1)[0]
        if kind == NULL:
            return None
        if kind == STRING:
            return self.text()
        if kind == INT:
            return self.int()
        if kind == DOUBLE:
            return _D.unpack(self.take(8))[0]
        if kind == BOOL:
            return self.take(1) != b"\0"
        if kind == STRINGS:
            return [self.text() for _ in range(self.int())]
        if kind == DICT:
            return _Reader(self.take(self.int())).dict()
        if kind == LIST:
            return [self.value() for _ in range(self.int())]
        raise ValueError(f"unknown kind {kind}")


def decode(raw: bytes) -> dict:
    """The document of tagged fields; unknown fields are skipped, absent ones are null."""
    doc = {"id": "", "rev": None, "deleted": False, "data": None, "tags": None, "content": None}
    r = _Reader(raw)
    while r.at < len(raw):
        number, n = r.take(1)[0], r.int()
        own = r.take(n)
        if number == VERSION:
            if own != b"\x01":
                raise ValueError(f"unsupported version {own!r}")
        elif number in (ID, REV, CONTENT):
            doc[{ID: "id", REV: "rev", CONTENT: "content"}[number]] = own.decode("utf-8")
        elif number == DELETED:
            doc["deleted"] = own != b"\0"
        elif number == DATA:
            doc["data"] = _Reader(own).dict()
        elif number == TAGS:
            inner = _Reader(own)
            doc["tags"] = [inner.text() for _ in range(inner.int())]
    return doc


def to_binary(docs: DataFrame, column: str = "binary") -> DataFrame:
    """``id`` and the binary form of each document. A broken or non-object ``data_json`` counts as none."""

    def run(ids: pd.Series, revs: pd.Series, dead: pd.Series, data: pd.Series, tags: pd.Series, content: pd.Series) -> pd.Series:
        def one(i, r, x, d, t, c) -> bytes:
            try:
                parsed = json.loads(d) if d else None
            except ValueError:
                parsed = None
            return encode({"id": i, "rev": r, "deleted": x, "data": parsed if isinstance(parsed, dict) else None, "tags": None if t is None else list(t), "content": c})

        return pd.Series([one(*row) for row in zip(ids, revs, dead, data, tags, content)])

    return docs.select("id", F.pandas_udf(run, "binary")("id", "rev", "deleted", "data_json", "tags", "content").alias(column))


def from_binary(rows: DataFrame, column: str = "binary") -> DataFrame:
    """Documents of binary forms."""

    def run(raw: pd.Series) -> pd.DataFrame:
        docs = [decode(bytes(b)) for b in raw]
        data = [None if d["data"] is None else json.dumps(d["data"], ensure_ascii=False) for d in docs]
        return pd.DataFrame({"id": [d["id"] for d in docs], "rev": [d["rev"] for d in docs], "deleted": [d["deleted"] for d in docs], "data_json": data, "tags": [d["tags"] for d in docs], "content": [d["content"] for d in docs]})

    schema = "id string, rev string, deleted boolean, data_json string, tags array<string>, content string"
    return rows.select(F.pandas_udf(run, schema)(column).alias("_d")).select("_d.*")


def _gzip(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else gzip.compress(bytes(b), mtime=0))


def _gunzip(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else gzip.decompress(bytes(b)))


def gzip_bytes(raw: Column) -> Column:
    return F.pandas_udf(_gzip, "binary")(raw.cast("binary"))


def gunzip_bytes(raw: Column) -> Column:
    return F.pandas_udf(_gunzip, "binary")(raw)


def is_gzip(raw: Column) -> Column:
    """Whether bytes start as gzip data does."""
    return F.coalesce(F.substring(raw.cast("binary"), 1, 2) == F.lit(b"\x1f\x8b"), F.lit(False))
