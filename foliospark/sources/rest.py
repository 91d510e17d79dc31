"""A Spark data source for a paged document API, or for a local folder of such pages.

``spark.dataSource.register(DocumentSource)``, then ``spark.read.format("foliodocs").option("baseUrl", ...).load()``.
"""

from __future__ import annotations

import itertools
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from foliospark.sources.schema import DOCUMENT

#: Rows that a server gives on one page at most; a larger page size would lose rows.
SERVER_PAGE = 1000
#: Bytes of a local file in one partition.
FILE_PART = 64 << 20


@dataclass
class Page(InputPartition):
    skip: int
    limit: int


@dataclass
class Lines(InputPartition):
    """The lines that begin in a range of a file's bytes; ``limit`` ends the reading, None doesn't."""

    parts: list[tuple[str, int, int]]
    limit: int | None


class DocumentSource(DataSource):
    """Options: baseUrl, db, pageSize, includeDeleted, maxRows, connectTimeoutMs, readTimeoutMs, retries, retryBackoffMs.

    ``path`` instead of ``baseUrl`` reads JSON-lines files of documents, in ranges of bytes. ``deleted = false`` and
    ``id = x`` are pushed to the server.
    """

    @classmethod
    def name(cls) -> str:
        return "foliodocs"

    def schema(self):
        return DOCUMENT

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.base = o.get("baseurl", "http://localhost:5000").rstrip("/")
        self.path = o.get("path")
        self.db = o.get("db", "news")
        self.page = max(1, min(int(o.get("pagesize", 100)), SERVER_PAGE))
        self.deleted = o.get("includedeleted", "false").lower() == "true"
        self.most = int(o["maxrows"]) if o.get("maxrows") else None
        self.timeout = max(int(o.get("connecttimeoutms", 5000)), int(o.get("readtimeoutms", 15000))) / 1000
        self.retries, self.backoff = max(0, int(o.get("retries", 3))), max(0, int(o.get("retrybackoffms", 500))) / 1000
        self.only: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("id",) and self.only is None and not self.path:
                self.only = str(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("deleted",) and f.value is False:
                self.deleted = False
            else:
                yield f

    def _get(self, route: str, missing_ok: bool = False):
        """The JSON of a route. Server errors and lost connections are retried, each time waiting longer."""
        url = f"{self.base}/v1/db/{urllib.parse.quote(self.db, safe='')}/{route}"
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json"}), timeout=self.timeout) as reply:
                    return json.loads(reply.read())
            except urllib.error.HTTPError as e:
                if e.code == 404 and missing_ok:
                    return None
                if e.code < 500 or attempt == self.retries:
                    raise RuntimeError(f"HTTP {e.code} for {url}") from e
            except (urllib.error.URLError, OSError) as e:
                if attempt == self.retries:
                    raise RuntimeError(f"{e} for {url}") from e
            time.sleep(self.backoff * max(1, attempt))

    def _items(self, skip: int, limit: int) -> list[dict]:
        query = urllib.parse.urlencode({"skip": skip, "limit": max(1, limit), "includeDeleted": str(self.deleted).lower()})
        return self._get(f"_all_docs?{query}").get("items") or []

    def _file(self, parts: list[tuple[str, int, int]]) -> Iterator[dict]:
        for name, start, end in parts:
            with open(name, "rb") as lines:
                lines.seek(max(0, start - 1))
                if start:
                    lines.readline()  # the line that begins before the range belongs to the range before
                while lines.tell() < end and (line := lines.readline()):
                    if line := line.removeprefix(b"\xef\xbb\xbf").strip():
                        doc = json.loads(line)
                        if self.deleted or not (doc.get("deleted") or doc.get("Deleted")):
                            yield doc

    def _total(self) -> int:
        """How many documents there are: as asked for, as the server counts them, or sought by single rows."""
        if self.most is not None:
            return self.most
        counts = self._get("_stats", missing_ok=True)
        try:
            return int(counts["docsTotal" if self.deleted else "docsAlive"])
        except (KeyError, TypeError):
            pass
        # A server without counts: the first place without a row, by doubling and halving.
        low, high = 0, 1
        while self._items(high - 1, 1):
            low, high = high, high * 2
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self._items(middle, 1) else (low, middle)
        return low

    def partitions(self) -> list[InputPartition]:
        if self.path:
            names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path))
            parts = [(n, at, min(at + FILE_PART, size)) for n in names for size in [os.path.getsize(n)] for at in range(0, size, FILE_PART)]
            return [Lines([p], None) for p in parts] if self.most is None else [Lines(parts, self.most)]
        if self.only is not None:
            return [Page(0, 1)]
        total = self._total()
        return [Page(skip, min(self.page, total - skip)) for skip in range(0, total, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, Lines):
            docs: Iterable[dict] = itertools.islice(self._file(partition.parts), partition.limit)
        elif self.only is not None:
            doc = self._get(f"docs/{urllib.parse.quote(self.only, safe='')}", missing_ok=True)
            docs = [doc] if doc else []
        else:
            docs = self._items(partition.skip, partition.limit)
        for doc in docs:
            d = {k.lower(): v for k, v in doc.items()}
            data = d.get("data")
            tags = d.get("tags")
            yield d.get("id"), d.get("rev"), bool(d.get("deleted")), None if data is None else json.dumps(data, ensure_ascii=False), None if tags is None else [None if t is None else str(t) for t in tags], d.get("content")


def post_documents(docs, base: str, db: str, timeout: float = 15.0, retries: int = 3, backoff: float = 0.5) -> None:
    """Send every row of a DataFrame of documents to the API, from the executors; an error fails the job.

    Rows with an id are put under it, and a conflict then means that an earlier try has sent them: a repeated task sends
    nothing twice. Rows without id are posted and get one from the server. Server errors and lost connections are
    retried.
    """
    url = f"{base.rstrip('/')}/v1/db/{urllib.parse.quote(db, safe='')}"

    def call(method: str, target: str, body: bytes) -> None:
        for attempt in range(retries + 1):
            try:
                urllib.request.urlopen(urllib.request.Request(target, body, {"Content-Type": "application/json"}, method=method), timeout=timeout).close()
                return
            except urllib.error.HTTPError as e:
                if e.code == 409 and target != url:
                    return
                if e.code < 500 or attempt == retries:
                    raise
            except (urllib.error.URLError, OSError):
                if attempt == retries:
                    raise
            time.sleep(backoff * max(1, attempt))

    def send(rows) -> None:
        for row in rows:
            doc = {"id": row.id, "data": json.loads(row.data_json) if row.data_json else None, "tags": row.tags, "content": row.content}
            body = json.dumps({k: v for k, v in doc.items() if v is not None}, ensure_ascii=False).encode()
            call("PUT" if row.id else "POST", f"{url}/docs/{urllib.parse.quote(row.id, safe='')}" if row.id else f"{url}/docs", body)

    call("PUT", url, b"")
    docs.foreachPartition(send)


def load_url(spark, url: str, max_docs: int | None = None, timeout: float = 60.0):
    """JSON lines behind a URL: passed on by the driver into the shared folder, then read like a file."""
    import uuid

    from foliospark.sources.files import _fs, _path, load_json
    from foliospark.sources.tables import keep_for_release, shared_dir

    target = keep_for_release(f"{shared_dir(spark)}/foliospark/url-{uuid.uuid4().hex}.jsonl")
    out = _fs(spark, target).create(_path(spark, target), True)
    try:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            while piece := reply.read(1 << 20):
                out.write(bytearray(piece))
    finally:
        out.close()
    return load_json(spark, target, max_docs)
