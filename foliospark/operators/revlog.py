"""The append-only log of revisions: current heads, time travel, and writes checked against the heads.

Rows of a log: ``seq, op, id, rev, deleted, data_json, tags, content, ts``; a database's own columns may precede them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.sources.schema import DOC_COLUMNS

BODY = ["data_json", "tags", "content"]


def heads(log: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The latest revision of each document, by ``seq`` (never by the text of ``rev``)."""
    rest = [c for c in log.columns if c not in (*keys, "seq")]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_b"), F.max("seq").alias("seq"))
    return best.select(*keys, "seq", *(F.col(f"_b.{c}").alias(c) for c in rest))


def get(docs: DataFrame, doc_id: str) -> DataFrame:
    """The live document with an id: one row or none."""
    return docs.where((F.col("id") == doc_id) & ~F.col("deleted"))


def get_revision(log: DataFrame, doc_id: str, rev: str) -> DataFrame:
    """A revision of a document, also after a later deletion; a revision that is a deletion itself gives nothing."""
    return log.where((F.col("id") == doc_id) & (F.col("rev") == rev) & ~F.col("deleted"))


def rev_number(rev: Column) -> Column:
    """The number before the first dash of a revision, 0 if there is none."""
    return F.coalesce(F.when(rev.rlike(r"^\s*[+-]?\d+\s*-"), F.trim(F.substring_index(rev, "-", 1)).try_cast("int")), F.lit(0))


def body_hash(deleted: Column) -> Column:
    """SHA-1 of a document's canonical body: fixed order of fields, nulls kept, id and revision left out."""
    return F.sha1(F.to_json(F.struct(F.lit("").alias("id"), deleted.alias("deleted"), *BODY), {"ignoreNullFields": "false"}).cast("binary"))


def next_rev(previous: Column, deleted: Column) -> Column:
    """The revision that follows: its number plus one, and the hash of the body."""
    return F.concat((rev_number(previous) + 1).cast("string"), F.lit("-"), body_hash(deleted))


_RESULT = "seq long, op string, id string, ok boolean, error string, rev string"
_ARROW = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("id", pa.string()), ("ok", pa.bool_()), ("error", pa.string()), ("rev", pa.string())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decides intents sorted by id and seq, the head (seq null) first; only the current revision is held."""
    last, rev, number, known = None, None, 0, False
    for batch in batches:
        out = []
        for seq, op, i, given, digest, given_number in zip(*(c.to_pylist() for c in batch.columns)):
            if i != last:
                last, rev, number, known = i, None, 0, False
            if seq is None:
                rev, number, known = given, given_number, True
                continue
            error = None
            if not i or not i.strip():
                error = "Missing _id"
            elif op == "del":
                error = "Document not found" if not known else None if given == rev else "Document update conflict"
            elif not known:
                error = "New document must not provide _rev" if given else None
            elif given != rev:
                error = "Document update conflict"
            fresh = None
            if error is None:
                number, known = number + 1, True
                fresh = rev = f"{number}-{digest}"
            out.append((seq, op, i, error is None, error, fresh))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)


def with_new_ids(intents: DataFrame) -> DataFrame:
    """``intents`` in which posts without id have a new one. Ids are random, so stage the result before it is used twice."""
    blank = (F.col("op") == "post") & (F.coalesce(F.trim("id"), F.lit("")) == "")
    return intents.withColumn("id", F.when(blank, F.replace(F.uuid(), F.lit("-"), F.lit(""))).otherwise(F.col("id")))


def apply_intents(current: DataFrame, intents: DataFrame) -> DataFrame:
    """``seq, op, id, ok, error, rev``: what becomes of each intended write, in the order of ``seq`` for each document.

    ``intents`` has ``seq, op`` (``put``, ``post`` or ``del``), the document's columns, and in ``rev`` the revision it
    is based on; posts have the ids of :func:`with_new_ids`. A put of an existing document needs its current revision
    (none for a head without one), a new one none; a deletion needs the current revision and keeps the body. A deleted
    document is still a head. Each write sees the ones before it. ``current`` needs ``id, rev, deleted, data_json, tags,
    content``.
    """
    dead = F.coalesce(F.col("deleted"), F.lit(False)) | (F.col("op") == "del")
    wanted = intents.select("seq", "op", "id", "rev", body_hash(dead).alias("digest"), F.lit(0).alias("number"))
    known = current.join(wanted.select("id").distinct(), "id", "left_semi").select(F.lit(None).cast("long").alias("seq"), F.lit("head").alias("op"), "id", "rev", F.lit(None).cast("string").alias("digest"), rev_number(F.col("rev")).alias("number"))
    rows = known.union(wanted)
    return rows.repartition("id").sortWithinPartitions("id", F.col("seq").asc_nulls_first()).mapInArrow(_fold, _RESULT)


def accepted(results: DataFrame, intents: DataFrame, base_seq: int = 0) -> DataFrame:
    """Log rows of the accepted intents; ``seq`` is the intent's own plus ``base_seq``."""
    r = results.where("ok").select("seq", "op", F.col("id").alias("_id"), F.col("rev").alias("_rev"))
    joined = r.join(intents.select("seq", *(c for c in DOC_COLUMNS if c not in ("id", "rev"))), "seq")
    dead = F.coalesce(F.col("deleted"), F.lit(False)) | (F.col("op") == "del")
    return joined.select((F.col("seq") + base_seq).alias("seq"), F.when(F.col("op") == "del", "del").otherwise("put").alias("op"), F.col("_id").alias("id"), F.col("_rev").alias("rev"), dead.alias("deleted"), *BODY)


def import_rows(docs: DataFrame) -> DataFrame:
    """Documents taken over as they are: no check of revisions; blank ids and revisions are left out."""
    return docs.where((F.coalesce(F.trim("id"), F.lit("")) != "") & (F.coalesce(F.trim("rev"), F.lit("")) != "")).select(*DOC_COLUMNS)


def replicated(entries: DataFrame) -> DataFrame:
    """``db, alive, since``: which databases exist after entries ``seq, op, db``, and from which seq their rows count.

    ``createdb`` and ``deletedb`` follow the order of ``seq``; what was written before the last ``deletedb`` is gone.
    """
    op = F.lower("op")
    ddl = entries.where(op.isin("createdb", "deletedb"))
    return ddl.groupBy("db").agg((F.max_by(op, "seq") == "createdb").alias("alive"), F.coalesce(F.max(F.when(op == "deletedb", F.col("seq"))), F.lit(-1)).alias("since"))


def apply_entries(entries: DataFrame) -> DataFrame:
    """Current heads ``db, id, rev, deleted, seq`` after replicated entries ``seq, op, db, id, rev, doc``.

    Writes to databases that don't exist at the end, and those before a database was last deleted, leave nothing.
    """
    dbs = replicated(entries).where("alive").select("db", "since")
    op = F.lower("op")
    writes = entries.where(op.isin("put", "post", "delete", "del")).join(dbs, "db").where(F.col("seq") > F.col("since"))
    dead = op.isin("delete", "del") | F.coalesce(F.col("doc.deleted"), F.lit(False))
    best = writes.groupBy("db", "id").agg(F.max(F.struct("seq", "rev", dead.alias("deleted"))).alias("_b"))
    return best.select("db", "id", "_b.rev", "_b.deleted", "_b.seq")
