import gzip
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from foliospark.functions import codecs, proto
from foliospark.sources import files, rest
from foliospark.sources.numbering import numbered

DOCS = [{"id": f"d{i:03d}", "rev": "1-a", "deleted": i % 10 == 3, "data": {"n": i, "s": "é"}, "tags": ["t"] if i % 2 else None, "content": None if i == 5 else f"c{i}"} for i in range(57)]


class Api(BaseHTTPRequestHandler):
    failures = 2
    seen: list[str] = []

    def log_message(self, *a):
        pass

    def do_GET(self):
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        Api.seen.append(self.path)
        status, body = 200, None
        if url.path.endswith("/_stats"):
            body = {"docsTotal": len(DOCS), "docsAlive": sum(not d["deleted"] for d in DOCS)}
        elif url.path.endswith("/_all_docs"):
            if Api.failures:
                Api.failures -= 1
                status, body = 503, {}
            else:
                rows = [d for d in DOCS if q["includeDeleted"] == "true" or not d["deleted"]]
                page = rows[int(q["skip"]) : int(q["skip"]) + int(q["limit"])]
                body = {"total": len(page), "items": page}
        else:
            hit = [d for d in DOCS if url.path.endswith("/docs/" + d["id"])]
            status, body = (200, hit[0]) if hit else (404, {})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture(scope="module")
def api():
    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_paged_api(spark, api):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rest.DocumentSource)
    load = lambda **o: spark.read.format("foliodocs").options(baseUrl=api, db="news", retryBackoffMs=1, **o).load()
    rows = load(pageSize=10).collect()
    assert sorted(r.id for r in rows) == [d["id"] for d in DOCS if not d["deleted"]]
    assert load(pageSize=10).rdd.getNumPartitions() == 6
    assert json.loads(rows[0].data_json)["s"] == "é"
    assert load(pageSize=5000, includeDeleted=True).count() == 57
    assert load(pageSize=10, maxRows=7).count() == 7
    assert [r.id for r in load().where("id = 'd007'").collect()] == ["d007"]
    assert any(p.endswith("/docs/d007") for p in Api.seen)
    assert load().where("id = 'none'").count() == 0


def test_local_pages(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_text("\n".join(json.dumps(d) for d in DOCS) + "\n\n")
    spark.dataSource.register(rest.DocumentSource)
    load = spark.read.format("foliodocs").option("path", str(tmp_path / "docs.jsonl")).option("pageSize", 9).load()
    assert load.count() == sum(not d["deleted"] for d in DOCS)


def test_local_ranges(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("\ufeff" + "\n".join(json.dumps(d) for d in DOCS[:30]) + "\n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(d) for d in DOCS[30:]))
    for part in (7, 50, 333, 1 << 20):
        monkeypatch.setattr(rest, "FILE_PART", part)
        reader = rest.DocumentReader({"path": str(tmp_path), "includeDeleted": "true"})
        assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [d["id"] for d in DOCS]
        few = rest.DocumentReader({"path": str(tmp_path), "includeDeleted": "true", "maxRows": "33"})
        assert [r[0] for p in few.partitions() for r in few.read(p)] == [d["id"] for d in DOCS[:33]]


def test_a_server_without_counts_loses_nothing(monkeypatch):
    for n in (0, 1, 2, 57, 64, 1001):
        reader = rest.DocumentReader({})
        monkeypatch.setattr(reader, "_get", lambda route, missing_ok=False, n=n: None if route == "_stats" else {"items": [1] * max(0, min(1, n - int(route.split("skip=")[1].split("&")[0])))})
        assert reader._total() == n


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('﻿{"a":1,"b":null,"c":{"d":null,"e":[null,5.0]}}\n\n  \nbad line\n[1,2]\n{"z":"x"}\n')
    docs, seen = files.load_json(spark, str(path))
    got = [(r.id, r.data_json, r.tags, r.content) for r in docs.orderBy("id").collect()]
    assert got == [("ds-000000", '{"a":1,"c":{"e":[null,5.0]}}', None, None), ("ds-000001", "{}", None, None), ("ds-000002", '{"z":"x"}', None, None)]
    assert (seen.parsed_documents, seen.skipped_bad_lines, seen.hit_max_docs) == (3, 1, False)
    assert seen.sha256 == hashlib.sha256(path.read_bytes()).hexdigest().upper() and seen.size_bytes == path.stat().st_size
    limited, seen = files.load_json(spark, str(path), max_docs=2)
    assert limited.count() == 2 and seen.hit_max_docs


def test_json_array_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(' [{"a":1}, {"a":2}]')
    (tmp_path / "o.json").write_text('{"a":3}')
    assert [json.loads(r.data_json)["a"] for r in files.load_json(spark, str(tmp_path / "a.json"))[0].orderBy("id").collect()] == [1, 2]
    assert [json.loads(r.data_json)["a"] for r in files.load_json(spark, str(tmp_path / "o.json"))[0].collect()] == [3]


def test_preparing_news(spark):
    lines = spark.createDataFrame([('{"headline":"H","short_description":"S","category":"C","link":"L"}',), ('junk {"title":"T","summary":""} tail',), ("{no",), ("",), ('{"headline":"","x":1}',)], "line string")
    items = files.salvage(lines)
    assert items.count() == 3
    docs = files.to_documents(items).collect()
    assert [(d.content, d.tags) for d in docs] == [("H S", ["C"]), ("T", None), (None, None)]
    assert docs[0].id == "news-" + hashlib.sha1(b"L").hexdigest()[:16]
    array = "\n".join(r.value for r in files.to_json_array(lines).collect())
    assert [x.get("headline") for x in json.loads(array)] == ["H", ""]
    assert [r.value for r in files.to_json_array(lines.limit(0)).collect()] == ["[]"]


def test_projection_and_columnar_sinks(spark, docs, tmp_path):
    got = {r.id: r for r in files.news_projection(docs).collect()}
    assert got["f"].tags_count == 0 and got["e"].tags_count == -1 and got["f"].content_len is None
    files.write_columnar(docs, str(tmp_path))
    assert spark.read.orc(str(tmp_path / "orc")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 6
    m = spark.createDataFrame([(1, "orc")], "n int, format string")
    files.append_metrics(m, str(tmp_path / "m"))
    files.append_metrics(m, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_log_lines_in_either_case(spark):
    lines = spark.createDataFrame([('{"op":"put","id":"a","rev":"1-x","seq":1,"doc":{"Id":"a","Rev":"1-x","Deleted":false,"Data":{"k":1},"Tags":["t"],"Content":null},"ts":"2025-01-01T00:00:00Z"}',), ('{"Op":"del","Id":"a","Seq":2}',), ("broken",), ("",)], "value string")
    rows = files.parse_log(lines).collect()
    assert [(r.op, r.id, r.seq) for r in rows] == [("put", "a", 1), ("del", "a", 2)]
    assert rows[0].doc.data_json == '{"k":1}' and rows[0].doc.tags == ["t"] and rows[1].doc is None


def test_generators(spark):
    rows = files.synthetic(spark, 20, 7).orderBy("id").collect()
    assert rows[4].id == "syn-000004" and json.loads(rows[4].data_json)["age"] == 22 and rows[4].content.count("lorem") == 6
    assert rows == files.synthetic(spark, 20, 7).orderBy("id").collect() and rows != files.synthetic(spark, 20, 8).orderBy("id").collect()
    assert files.bench_documents(spark, 3).first().id == "bench-000000"
    t = files.tokenised_documents(spark, 5, 4, 9).first()
    assert len(set(t.tokens)) == 4


def test_numbering(spark):
    rows = numbered(spark.range(1000).repartition(7), [F.desc("id")], "n", 5).collect()
    assert {r.id: r.n for r in rows} == {i: 5 + 999 - i for i in range(1000)}
    assert numbered(spark.range(0), ["id"], "n").count() == 0


def test_binary_form(spark, docs):
    nested = {"chart": {"result": [{"meta": {"symbol": "S", "price": 1.5}, "ts": [1, 2], "mixed": [1, "t", True, None, {"k": None}]}]}}
    doc = {"id": "x", "rev": "1-a", "deleted": True, "data": nested, "tags": ["a", "б"], "content": "text"}
    back = codecs.decode(codecs.encode(doc))
    nested["chart"]["result"][0]["mixed"][3] = ""  # a null in a list becomes an empty string
    assert back == doc
    assert codecs.decode(codecs.encode({"id": "x", "tags": [], "content": ""})) == {"id": "x", "rev": None, "deleted": False, "data": None, "tags": None, "content": None}
    assert codecs.decode(codecs.encode({"id": "y"}) + b"\x63\x02\x00\x00\x00zz")["id"] == "y"
    with pytest.raises(OverflowError):
        codecs.encode({"data": {"n": 2**40}})
    with pytest.raises(ValueError):
        codecs.decode(b"\x02\x09\x00\x00\x00abc")
    assert {r.id for r in codecs.from_binary(codecs.to_binary(docs)).collect()} == set("abcdef")


def test_messages(spark, docs, tmp_path):
    assert proto.encode({"id": "a", "deleted": True, "tags": ["t", ""], "content": "é"}) == b"\x0a\x01a\x18\x01\x2a\x01t\x2a\x00\x32\x02\xc3\xa9"
    assert proto.encode({"id": "a", "data": {"k": 1.5}}) == b"\x0a\x01a\x22\x10\x0a\x0e\x0a\x01k\x12\x09\x11" + b"\x00\x00\x00\x00\x00\x00\xf8\x3f"
    doc = {"id": "x" * 300, "rev": "1-a", "deleted": False, "data": {"a": [1, "t", True, None, {"k": {"z": -2.5}}], "": {}, "big": 2**60}, "tags": ["a", "б"], "content": "text"}
    assert proto.decode(proto.encode(doc)) == doc | {"data": doc["data"] | {"big": float(2**60)}}
    assert proto.decode(b"\x0a\x01y\x7a\x02zz\x68\x05")["id"] == "y"
    for broken in (b"\x0a\x09abc", b"\x0a", b"\x0b"):
        with pytest.raises(ValueError):
            proto.decode(broken)
    assert {r.id for r in proto.from_proto(proto.to_proto(docs)).collect()} == set("abcdef")
    for n, form in enumerate((codecs.encode, proto.encode)):
        (tmp_path / str(n)).mkdir()
        (tmp_path / str(n) / "one.bin").write_bytes(form({"id": "one", "content": "c"}))
        row = files.read_binary_documents(spark, str(tmp_path / str(n)), ("binary", "proto")[n]).first()
        assert (row.id, row.content, row.data_json) == ("one", "c", None)
    files.write_binary_documents(docs, str(tmp_path / "out"), "proto")
    assert proto.from_proto(spark.read.parquet(str(tmp_path / "out")), "binary").count() == 6


def test_digests(spark, tmp_path, monkeypatch):
    for name, text in (("a", b"one"), ("b", b"two" * 10)):
        (tmp_path / name).write_bytes(text)
    whole = files._digest(spark, str(tmp_path))
    monkeypatch.setattr(files, "DIGESTED", 5)
    assert files._digest(spark, str(tmp_path)) == whole and whole[0] == 33
    assert files._digest(spark, str(tmp_path / "b")) == (30, hashlib.sha256(b"two" * 10).hexdigest().upper())


def test_gzip(spark):
    rows = spark.createDataFrame([("x" * 5000,), ("",), (None,)], "t string")
    z = rows.select("t", codecs.gzip_bytes(F.col("t")).alias("z")).collect()
    assert gzip.decompress(bytes(z[0].z)).decode() == "x" * 5000 and z[2].z is None
    back = rows.select("t", codecs.gunzip_bytes(codecs.gzip_bytes(F.col("t"))).cast("string").alias("b"), codecs.is_gzip(F.col("t")).alias("g")).collect()
    assert all(r.t == r.b and not r.g for r in back)
