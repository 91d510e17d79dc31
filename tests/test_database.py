import pytest
from pyspark.sql import functions as F

from foliospark.operators import revlog
from foliospark.operators.database import Engine, sanitize_name
from foliospark.sources import files


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "dbs"))
    assert e.create_db("notes").ok and e.create_db("notes").ok
    return e


def test_catalog(engine):
    assert engine.create_db(" ").error == "Bad database name"
    assert engine.list_dbs() == ["notes"] and engine.seq("notes") == 0 and engine.seq("missing") == 0
    assert engine.put("missing", {"id": "x"}).error == "Database not found" and engine.list_dbs() == ["notes"]
    engine.set_seq("notes", 41)
    assert engine.seq("notes") == 41
    engine.set_seq("notes", -3)
    assert engine.seq("notes") == 0
    assert engine.delete_db("notes").ok and engine.delete_db("notes").ok and engine.list_dbs() == []
    assert sanitize_name("a/b:c") == "a_b_c"


def test_writing_and_reading(engine):
    made = engine.put("notes", {"id": "n1", "data_json": '{"type":"note","rating":5}', "tags": ["blue", "draft"], "content": "first text"})
    assert made.ok and made.rev.startswith("1-")
    assert engine.put("notes", {"id": "n1", "rev": "1-wrong"}).error == "Document update conflict"
    assert engine.put("notes", {"id": "n2", "rev": "1-x"}).error == "New document must not provide _rev"
    assert engine.put("notes", {"id": ""}).error == "Missing _id"
    second = engine.put("notes", {"id": "n1", "rev": made.rev, "data_json": '{"type":"note","rating":10}', "tags": ["blue", "published"], "content": "an updated note"})
    assert second.ok and second.rev.startswith("2-")
    posted = engine.post("notes", {"content": "posted"})
    assert posted.ok and len(posted.id) == 32
    assert engine.get("notes", "n1").rev == second.rev
    assert engine.get("notes", "n1", made.rev).content == "first text"
    one = lambda df: [r.id for r in df.collect()]
    assert one(engine.find_by_fields("notes", {"type": "note"}, ("rating", 7, 10))) == ["n1"]
    assert one(engine.find_by_tags("notes", ["blue"], ["published"])) == ["n1"]
    assert one(engine.full_text_search("notes", "updated note")) == ["n1"]
    assert one(engine.full_text_search("notes", "note", order="insertion")) == ["n1"]
    assert engine.delete("notes", "n1", made.rev).error == "Document update conflict"
    assert engine.delete("notes", "nothing").error == "Document not found"
    assert engine.delete("notes", "n1", second.rev).ok
    assert engine.get("notes", "n1") is None
    assert engine.get("notes", "n1", second.rev).content == "an updated note"
    assert "n1" in one(engine.all_docs("notes")) and "n1" not in one(engine.all_docs("notes", include_deleted=False))
    s = engine.stats("notes").first()
    assert (s.seq, s.docs_total, s.docs_alive, s.docs_deleted) == (4, 2, 1, 1)


def test_equal_posts_are_two_documents(engine):
    one, two = engine.post("notes", {"content": "hello"}), engine.post("notes", {"content": "hello"})
    assert one.ok and two.ok and one.id != two.id and len(two.id) == 32
    assert engine.export_all("notes").count() == 2


def test_a_lowered_number_changes_no_document(engine):
    made = engine.put("notes", {"id": "n", "content": "old"})
    engine.set_seq("notes", 100)
    made = engine.put("notes", {"id": "n", "rev": made.rev, "content": "newer"})
    assert engine.seq("notes") == 101
    engine.set_seq("notes", 3)
    engine.put("notes", {"id": "n", "rev": made.rev, "content": "newest"})
    assert engine.seq("notes") == 4 and engine.get("notes", "n").content == "newest"


def test_odd_revisions(spark):
    heads = spark.createDataFrame([("a", "++3-x"), ("b", "²-x"), ("c", None), ("d", "-2-x"), ("e", " 7 -x")], "id string, rev string")
    heads = heads.select("id", "rev", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("data_json"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("content"))
    intents = heads.withColumn("seq", F.lit(1).cast("long")).withColumn("op", F.lit("put"))
    assert {r.id: r.rev.rsplit("-", 1)[0] for r in revlog.apply_intents(heads, intents).collect()} == {"a": "1", "b": "1", "c": "1", "d": "1", "e": "8"}


def test_adapters(engine):
    for i in range(3):
        engine.put("notes", {"id": f"n{i}", "content": "some words", "data_json": '{"k":"v"}'})
    ok, found, error = engine.full_text("notes", "words", 2)
    assert ok and [r.id for r in found] == ["n0", "n1"] and error is None
    ok, found, _ = engine.find("notes", {"data.k": "v"}, offset=1)
    assert ok and [r.id for r in found] == ["n1", "n2"]
    ok, found, error = engine.find("notes", numeric=("x",))
    assert not ok and found == [] and error


def test_heads_read_nothing_older_than_the_snapshot(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.create_db("d")
    first = e.put("d", {"id": "a", "content": "one"})
    e.snapshot("d")
    e.put("d", {"id": "a", "rev": first.rev, "content": "two"})
    e.put("d", {"id": "b", "content": "b"})
    old = tmp_path / "d" / "wal" / "epoch=0"
    assert not any("epoch=0" in f for f in e.log("d", 1).inputFiles()) and any("epoch=0" in f for f in e.log("d").inputFiles())
    assert e.get("d", "a", first.rev).content == "one"
    for f in old.iterdir():
        f.unlink()
    assert {r.id: r.content for r in e.heads("d").collect()} == {"a": "two", "b": "b"} and e.seq("d") == 3


def test_a_batch_is_applied_in_order(spark):
    heads = spark.createDataFrame([("a", "3-h", False, None, None, "old")], "id string, rev string, deleted boolean, data_json string, tags array<string>, content string")
    rows = [(1, "put", "a", "3-h", "x"), (2, "put", "a", "3-h", "y"), (3, "put", "b", None, "z"), (4, "del", "b", "1-?", ""), (5, "del", "c", "1-x", ""), (6, "put", "a", None, "w")]
    intents = spark.createDataFrame(rows, "seq long, op string, id string, rev string, content string").select("seq", "op", "id", "rev", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("data_json"), F.lit(None).cast("array<string>").alias("tags"), "content")
    r = {x.seq: x for x in revlog.apply_intents(heads, intents).collect()}
    assert r[1].ok and r[1].rev.startswith("4-") and r[2].error == r[6].error == "Document update conflict"
    assert r[3].ok and r[4].error == "Document update conflict" and r[5].error == "Document not found"
    # The same body gives the same hash; another body another one.
    again = {x.seq: x.rev for x in revlog.apply_intents(heads, intents).collect()}
    assert again[1] == r[1].rev and r[1].rev[2:] != r[3].rev[2:]


def test_snapshots_and_recovery(spark, tmp_path):
    e = Engine(spark, str(tmp_path), snapshot_every=3)
    e.create_db("d")
    a = e.put("d", {"id": "a1", "content": "Alpha"})
    b = e.put("d", {"id": "b1", "content": "gone"})
    e.put("d", {"id": "a1", "rev": a.rev, "content": "Alpha v2"})
    assert files.read_manifest(spark, str(tmp_path / "d"))["LastSeq"] == 3
    assert e.delete("d", "b1", b.rev).ok and e.put("d", {"id": "a2", "content": "Beta"}).ok
    fresh = Engine(spark, str(tmp_path)).recover()["d"]
    assert {r.id: (r.content, r.deleted) for r in fresh.collect()} == {"a1": ("Alpha v2", False), "b1": ("gone", True), "a2": ("Beta", False)}
    assert Engine(spark, str(tmp_path)).seq("d") == 5
    (tmp_path / "d" / "manifest.json").write_text("{broken")
    for crc in (tmp_path / "d").glob(".manifest*.crc"):
        crc.unlink()
    assert files.read_manifest(spark, str(tmp_path / "d")) is None


def test_import_and_export(engine, docs):
    engine.import_docs("notes", docs)
    assert sorted(r.id for r in engine.export_all("notes", include_deleted=True).collect()) == ["a", "b", "c", "d", "f"]
    assert sorted(r.id for r in engine.export_all("notes").collect()) == ["a", "b", "c", "f"]


def test_replicated_entries(spark):
    rows = [(1, "createdb", "x", None, None, False), (2, "put", "x", "a", "1-a", False), (3, "deletedb", "x", None, None, False), (4, "CreateDb", "x", None, None, False), (5, "put", "x", "b", "1-b", False), (6, "delete", "x", "b", "1-b", False), (7, "put", "y", "c", "1-c", False), (8, "put", "x", "d", "1-d", False)]
    e = spark.createDataFrame(rows, "seq long, op string, db string, id string, rev string, dead boolean").withColumn("doc", F.struct(F.col("dead").alias("deleted")))
    assert sorted((r.db, r.id, r.deleted) for r in revlog.apply_entries(e).collect()) == [("x", "b", True), ("x", "d", False)]


def test_revision_numbers(spark):
    rows = spark.createDataFrame([("12-abc",), ("x-1",), ("7",), (None,), ("-3",)], "r string")
    assert [r[0] for r in rows.select(revlog.rev_number(F.col("r"))).collect()] == [12, 0, 0, 0, 0]
