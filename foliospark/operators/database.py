"""Databases of documents in a folder: catalog, reads, checked writes, snapshots and recovery.

A database is a folder with a log in JSON lines (a segment for each snapshot epoch), snapshots and a manifest. Reads
are DataFrames over the recovered state; a batch of writes is one serial writer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import revlog, search, stats
from foliospark.sources import files
from foliospark.sources.numbering import numbered
from foliospark.sources.schema import DOC_COLUMNS, DOCUMENT
from foliospark.sources.tables import stage


def sanitize_name(name: str) -> str:
    """A name usable as a folder: signs that file systems forbid become underscores."""
    return "".join("_" if c in '<>:"/\\|?*' or ord(c) < 32 else c for c in name)


@dataclass
class Result:
    """What a single write gave."""

    ok: bool
    rev: str | None = None
    error: str | None = None
    id: str | None = None


def _answer(search) -> tuple[bool, list[Row], str | None]:
    """A page of a search, or the error; pages have at most 1000 rows."""
    try:
        return True, search().collect(), None
    except Exception as e:  # the caller gets the message instead
        return False, [], str(e)


class Engine:
    """All databases below a folder."""

    def __init__(self, spark: SparkSession, root: str, snapshot_every: int = 0, max_log_mb: float = 0):
        self.spark, self.root, self.snapshot_every, self.max_log_mb = spark, root.rstrip("/"), snapshot_every, max_log_mb

    def _dir(self, db: str) -> str:
        return f"{self.root}/{sanitize_name(db)}"

    # catalog

    def create_db(self, db: str) -> Result:
        if not db or not db.strip():
            return Result(False, error="Bad database name")
        files._fs(self.spark, self._dir(db)).mkdirs(files._path(self.spark, self._dir(db)))
        return Result(True)

    def delete_db(self, db: str) -> Result:
        files._fs(self.spark, self._dir(db)).delete(files._path(self.spark, self._dir(db)), True)
        return Result(True)

    def list_dbs(self) -> list[str]:
        if not files._exists(self.spark, self.root):
            return []
        return sorted(s.getPath().getName() for s in files._fs(self.spark, self.root).listStatus(files._path(self.spark, self.root)) if s.isDirectory())

    def exists(self, db: str) -> bool:
        return files._exists(self.spark, self._dir(db))

    def _written(self, db: str) -> int:
        """The number of the last line of the log, which never falls; snapshot and heads go by it."""
        return max(self._epoch(db), self.log(db, self._epoch(db)).agg(F.max("seq")).first()[0] or 0)

    def seq(self, db: str) -> int:
        """The last sequence number, 0 for a missing database: that of the log, shifted by what was set."""
        return self._written(db) + self._shift(db)

    def _shift(self, db: str) -> int:
        return int(files.read_text(self.spark, f"{self._dir(db)}/seq-shift") or 0)

    def set_seq(self, db: str, value: int) -> None:
        """Set the sequence number to any value, a negative one counting as 0; nothing happens for a missing database."""
        if self.exists(db):
            files.write_text(self.spark, f"{self._dir(db)}/seq-shift", str(max(0, value) - self._written(db)))

    def stats(self, db: str) -> DataFrame:
        return stats.db_stats(self.heads(db), self.seq(db))

    # state

    def _epoch(self, db: str) -> int:
        return int((files.read_manifest(self.spark, self._dir(db)) or {}).get("LastSeq", 0))

    def log(self, db: str, since: int = 0) -> DataFrame:
        return files.read_log(self.spark, f"{self._dir(db)}/wal", since)

    def revisions(self, db: str, since: int = 0) -> DataFrame:
        """All revisions known: those of the active snapshot, with its seq, and those logged from an epoch on."""
        puts = self.log(db, since).where(F.col("op").isin("put", "del") & F.col("id").isNotNull())
        body = [F.col(f"doc.{c}").alias(c) for c in revlog.BODY]
        dead = (F.col("op") == "del") | F.coalesce(F.col("doc.deleted"), F.lit(False))
        rows = puts.select("seq", "id", "rev", dead.alias("deleted"), *body)
        snapshot, last = files.read_snapshot(self.spark, self._dir(db))
        return rows if snapshot is None else rows.unionByName(snapshot.select(F.lit(last).cast("long").alias("seq"), *DOC_COLUMNS).where(F.col("id").isNotNull()))

    def heads(self, db: str) -> DataFrame:
        """Current documents, deleted ones too: the snapshot, then the log since it; older segments aren't read."""
        return revlog.heads(self.revisions(db, self._epoch(db))).select(*DOC_COLUMNS, "seq")

    # reads

    def get(self, db: str, doc_id: str, rev: str | None = None) -> Row | None:
        found = revlog.get(self.heads(db), doc_id) if rev is None else revlog.get_revision(self.revisions(db), doc_id, rev)
        return found.select(*DOC_COLUMNS).first()

    def all_docs(self, db: str, skip: int = 0, limit: int = 1000, include_deleted: bool = True) -> DataFrame:
        return search.all_docs(self.heads(db), skip, limit, include_deleted).select(*DOC_COLUMNS)

    def find_by_fields(self, db: str, equals=None, numeric=None, skip: int = 0, limit: int = 100, mode: str = "address") -> DataFrame:
        return search.find_by_fields(self.heads(db), equals, numeric, skip, limit, mode).select(*DOC_COLUMNS)

    def find_by_tags(self, db: str, all_of=None, any_of=None, none_of=None, skip: int = 0, limit: int = 100) -> DataFrame:
        return search.find_by_tags(self.heads(db), all_of, any_of, none_of, skip, limit).select(*DOC_COLUMNS)

    def full_text_search(self, db: str, query: str, skip: int = 0, limit: int = 100, order: str = "id") -> DataFrame:
        docs = self.heads(db)
        if order == "insertion":
            first = self.revisions(db).groupBy("id").agg(F.min("seq").alias("doc_num"))
            docs = docs.join(first, "id")
        return search.full_text(docs, query, skip, limit, order).select(*DOC_COLUMNS)

    def find(self, db: str, equals=None, numeric=None, limit: int = 100, offset: int = 0) -> tuple[bool, list[Row], str | None]:
        """:meth:`find_by_fields` as (ok, documents, error)."""
        return _answer(lambda: self.find_by_fields(db, equals, numeric, offset, limit))

    def full_text(self, db: str, query: str, limit: int = 50, offset: int = 0) -> tuple[bool, list[Row], str | None]:
        """:meth:`full_text_search` as (ok, documents, error)."""
        return _answer(lambda: self.full_text_search(db, query, offset, limit))

    # writes

    def write(self, db: str, intents: DataFrame) -> DataFrame:
        """Apply intents (``seq, op`` and document columns, ``seq`` giving their order) and log what is accepted.

        Gives ``seq, op, id, ok, error, rev``, staged, with the intents' own ``seq``. Accepted writes get consecutive
        numbers in the log.
        """
        if not self.exists(db):
            raise ValueError(f"no database {db!r}")
        intents = stage(revlog.with_new_ids(intents), "intents")
        results = stage(revlog.apply_intents(self.heads(db), intents), "results")
        before = self._written(db)
        rows = revlog.accepted(results, intents)
        rows = numbered(rows, ["seq"], "_n", before + 1)
        # The line of a deletion carries the revision before it, and the document as it was.
        doc = F.struct(F.col("id"), F.col("rev"), F.col("deleted"), *revlog.BODY)
        files.append_log(rows.select("op", "id", "rev", F.col("_n").alias("seq"), doc.alias("doc"), F.current_timestamp().alias("ts")), f"{self._dir(db)}/wal", self._epoch(db))
        self.maybe_snapshot(db, before)
        return results

    def _one(self, db: str, op: str, doc: dict) -> Result:
        row = {"seq": 1, "op": op, **{c: doc.get(c) for c in DOC_COLUMNS}, "deleted": bool(doc.get("deleted"))}
        schema = "seq long, op string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOCUMENT)
        if not self.exists(db):
            return Result(False, error="Database not found")
        r = self.write(db, self.spark.createDataFrame([row], schema)).first()
        return Result(r.ok, r.rev, r.error, r.id)

    def put(self, db: str, doc: dict) -> Result:
        return self._one(db, "put", doc)

    def post(self, db: str, doc: dict) -> Result:
        return self._one(db, "post", doc)

    def delete(self, db: str, doc_id: str, rev: str | None = None) -> Result:
        """Delete a document; without a revision its current one counts. The tombstone keeps the body."""
        head = self.heads(db).where(F.col("id") == doc_id).first()
        if head is None:
            return Result(False, error="Document not found")
        return self._one(db, "del", {**head.asDict(), "rev": rev or head.rev})

    def import_docs(self, db: str, docs: DataFrame) -> None:
        """Documents as they are, after what is there."""
        rows = numbered(revlog.import_rows(docs), ["id", "rev"], "seq", self._written(db) + 1)
        doc = F.struct(*DOC_COLUMNS)
        files.append_log(rows.select(F.when(F.col("deleted"), "del").otherwise("put").alias("op"), "id", "rev", "seq", doc.alias("doc"), F.current_timestamp().alias("ts")), f"{self._dir(db)}/wal", self._epoch(db))

    def export_all(self, db: str, include_deleted: bool = False) -> DataFrame:
        docs = self.heads(db).select(*DOC_COLUMNS)
        return docs if include_deleted else docs.where(~F.col("deleted"))

    # snapshots

    def snapshot(self, db: str) -> str:
        """Write the heads as a snapshot; later writes go to a new segment of the log. Older segments stay for history."""
        return files.create_snapshot(stage(self.heads(db).select(*DOC_COLUMNS), "heads"), self._dir(db), self._written(db))

    def maybe_snapshot(self, db: str, before: int) -> str | None:
        """A snapshot if a multiple of ``snapshot_every`` was passed, or the log exceeds ``max_log_mb``."""
        due = self.snapshot_every and self._written(db) // self.snapshot_every > before // self.snapshot_every
        large = self.max_log_mb and files.log_bytes(self.spark, f"{self._dir(db)}/wal/epoch={self._epoch(db)}") > self.max_log_mb * 2**20
        return self.snapshot(db) if due or large else None

    def recover(self, dbs: Sequence[str] | None = None) -> dict[str, DataFrame]:
        """The current documents of all databases, read back from their files."""
        return {db: self.heads(db) for db in (dbs or self.list_dbs())}
