import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import codecs, proto
from foliospark.functions.json_tree import _deep, parse
from foliospark.operators import incremental, indexes, nested, packed, replay
from foliospark.sources import files
from foliospark.sources.state import StaleVersion, StateStore
from foliospark.streaming import replay as streaming

# nested records


def brute_elements(data, tags):
    out = set()

    def walk(v, path, parent, element):
        if isinstance(v, dict):
            if element:
                out.add((path, parent))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path if element else parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True)

    try:
        walk(json.loads(data), "data", "$", False)
    except (TypeError, ValueError):
        pass
    return out | {(f"tags[{i}]", "$") for i, t in enumerate(tags or []) if t is not None}


def test_nested_records_against_a_plain_walk(spark):
    texts = [
        '{"a":{"b":[{"c":[1,2,{"d":[]}]},[[{"e":{}}]],"{}"]}}', "[]", '[{"x":[{"y":1}]}]', "{}", "", "{", None, '{"a":NaN}', '{"a.b":[{"c d":[{}]}]}', '"text"', "5", '{"a":[null,{"b":null}]}', '{"a":[{}]} x',
    ]
    rows = [(f"d{i}", t, [None, "x", ""] if i % 2 else None, 1, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows * 2, "id string, data_json string, tags array<string>, path int, tag string")
    got = {(r.id, r.path, r.parent_path) for r in nested.elements(df).collect()}
    texts[7] = None  # NaN is no JSON
    assert got == {(i, *e) for (i, t, g, *_), u in zip(rows, texts) for e in brute_elements(u, g)}
    assert nested.elements(df.limit(0)).count() == 0


def test_repeated_names_numbers_and_depth():
    assert [p for _, p, *_ in nested.visit(parse('{"a":[{"x":1}],"a":[{"y":2},{}]}')) if "[" in p] == ["data.a[0]", "data.a[0]", "data.a[1]"]
    assert next(nested.visit(parse('{"n":5.0,"m":12345678901234567890,"t":true}')))[6] == '{"n":5.0,"m":12345678901234567890,"t":true}'
    deep = "[" * 200_000 + '{"a":[{}]}' + "]" * 200_000
    found = [e for e in nested.visit(parse(deep)) if e[4]]
    assert len(found) == 2 and found[1][2] == found[0][1]
    assert parse("[" * 200_000) is None and parse('{"a":' * 100_000 + "1" + "}" * 99_999) is None
    for text in ('{"a":[1,{"b":null}],"c":{}}', "[[],{}]", '"x"', "[1.50]", '{"a":[]}'):
        assert _deep(text) == parse(text)


def test_halves_of_surrogate_pairs(spark):
    df = spark.createDataFrame([("a", '{"x":["\\ud800y",{"k\\udfff":"\\ud83d\\ude00"}]}', ["t"], False, None, "c")], "id string, data_json string, tags array<string>, deleted boolean, rev string, content string")
    got = {r.path: r.payload for r in nested.relational(df).collect()}
    assert got["data.x[0]"] == '{"value":"\\ud800y"}' and got["data.x[1]"] == '{"k\\udfff":"😀"}'
    assert {r.text for r in indexes.flatten_fields(df).collect()} == {"\\ud800y", "😀"}
    assert codecs.to_binary(df).count() == proto.to_proto(df).count() == 1
    assert df.select(files.drop_null_properties(F.col("data_json"))).first()[0].startswith('{"x":["\\ud800y"')


def test_flat_tables(spark, tmp_path):
    df = spark.createDataFrame([("o1", '{"k":"v","items":[{"sku":"a","qty":2},{"sku":"b"}]}', ["t"])], "id string, data_json string, tags array<string>")
    df = df.union(spark.createDataFrame([("o2", '{"tags":["x","y"],"items":[{"sku":"s","sizes":[1,2.50]}],"m":[[1,2],{"q":{"r":1}}],"no":[],"n":[null,true]}', None), ("o3", "[1,[2]]", None), ("o4", '"text"', None), ("o5", "null", None)], df.schema))
    nested.write_tables(nested.relational(df), str(tmp_path))
    values = {(r.id, r.path): (r.owner, r.payload) for r in nested.read_rows(spark, str(tmp_path)).where("kind = 'value' and id <> 'o1'").collect()}
    assert values == {
        ("o2", "data.tags[0]"): ("data", '{"value":"x"}'), ("o2", "data.tags[1]"): ("data", '{"value":"y"}'), ("o2", "data.items[0].sizes[0]"): ("data.items[0]", '{"value":1}'), ("o2", "data.items[0].sizes[1]"): ("data.items[0]", '{"value":2.50}'),
        ("o2", "data.m[0][0]"): ("data", '{"value":1}'), ("o2", "data.m[0][1]"): ("data", '{"value":2}'), ("o2", "data.n[0]"): ("data", '{"value":null}'), ("o2", "data.n[1]"): ("data", '{"value":true}'),
        ("o3", "data[0]"): ("$", '{"value":1}'), ("o3", "data[1][0]"): ("$", '{"value":2}'), ("o4", "data"): ("$", '{"value":"text"}'), ("o5", "data"): ("$", '{"value":null}'),
    }
    inner = nested.read_table(spark, str(tmp_path), "data.m[].q").first()
    assert (inner.parent_path, inner.owner, inner.fields) == ("data.m[1]", "data.m[1]", {"r": "1"})
    assert nested.read_table(spark, str(tmp_path), "data", "no array<int>").where("id = 'o2'").first().no == []
    df = df.where("id = 'o1'")
    nested.write_tables(nested.relational(df), str(tmp_path))
    items = nested.read_table(spark, str(tmp_path), "data.items[]", "sku string, qty int").orderBy("path").collect()
    assert [(r.path, r.parent_path, r.sku, r.qty) for r in items] == [("data.items[0]", "$", "a", 2), ("data.items[1]", "$", "b", None)]
    assert nested.read_table(spark, str(tmp_path), "data").first().fields == {"k": "v"}
    assert nested.read_table(spark, str(tmp_path), "tags", "value string").first().value == "t"


# packed fields

PACKED = {
    None: [], "": [], " ; ": [], '""': [], "A B": ["A B"], "by A B": ["A B"], "BY A, C": ["A", "C"], "A and B AND C & D": ["A", "B", "C", "D"], "Sandra Orlando": ["Sandra Orlando"],
    "A, B, and C": ["A", "B", "C"], '"Last, First"; "X ""Y"" Z"': ["Last, First", 'X "Y" Z'], '[ "A","B" ]': ["A", "B"], "A\r\nB \n\tC": ["A", "B", "C"], "A/B|C": ["A", "B", "C"], ', A;;"B / desk";': ["A", "B / desk"],
    '"A" and "B, C"': ["A", "B, C"], 'A "x, y" B, C': ['A "x, y" B', "C"], '"open, end': ['"open', "end"], "and": [], "by": [], "[A": ["[A"], "A ": ["A"], "byron": ["byron"],
}


def test_packed_values(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(PACKED)] * 2, "id string, authors string")
    rows = packed.unpack(df, "id", "authors", value="author").collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.position):
        got.setdefault(r.id, []).append((r.position, r.author))
    for i, (t, want) in enumerate(PACKED.items()):
        assert got.get(str(i), []) == list(enumerate(want, 1)), t
    long = spark.createDataFrame([("x", ", ".join(["Name"] * 100_000), 1)], "id string, authors string, position int")
    assert packed.unpack(long, "id", "authors", value="author").count() == 100_000


# log replay

LINE = "db string, shard int, op string, id string, rev string, seq long, doc struct<deleted:boolean,content:string>, ts timestamp_ntz"


def lines(spark, rows):
    start = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(db, 0, op, i, rev, seq, None if dead is None else (dead, "c"), None if ts is None else start + dt.timedelta(hours=ts)) for db, op, i, rev, seq, dead, ts in rows], LINE)


def brute_state(rows):
    best = {}
    for db, op, i, rev, seq, dead, ts in rows:
        op = op.strip().lower() if op else None
        if op not in ("del", "put") or (op == "put" and dead is None) or i is None or seq is None:
            continue
        key = (seq, -1 if ts is None else ts, rev or "", op == "del")
        if (db, i) not in best or key > best[db, i][0]:
            best[db, i] = (key, op == "put" and dead is False, rev)
    return {(db, i, k[0], rev) for (db, i), (k, live, rev) in best.items() if live}


def random_log(n, seed):
    rnd = random.Random(seed)
    return [
        (rnd.choice("xy"), rnd.choice(["put", " PUT", "del", "Del ", "noop", None]), "hot" if rnd.random() < 0.35 else f"d{rnd.randint(0, 30)}", rnd.choice([None, f"{rnd.randint(1, 9)}-a"]), rnd.choice([None] + list(range(200))) if rnd.random() < 0.1 else rnd.randint(0, 200), rnd.choice([None, True, False, False]), rnd.choice([None, *range(48)]))
        for _ in range(n)
    ]


def test_replay_against_a_plain_fold(spark):
    rows = random_log(800, 1)
    got = {(r.db, r.id, r.seq, r.rev) for r in replay.replay(lines(spark, rows + rows[::3])).collect()}
    assert got == brute_state(rows)
    assert replay.replay(lines(spark, [])).count() == 0
    odd = lines(spark, rows[:200]).withColumns({"ready": F.lit("x"), "block": F.lit(9), "alive": F.lit(0), "hi": F.lit(1)})
    assert {(r.db, r.id, r.seq, r.rev) for r in replay.replay(odd).collect()} == brute_state(rows[:200])


def test_watermarks(spark):
    rows = [("x", "put", f"d{s}", "1-a", s, False, 1) for s in [3, 4, 5, 7, 8]] + [("y", "noop", "a", None, s, None, 1) for s in range(1, 6)] + [("z", "put", "q", "1-a", None, False, 1)]
    got = {r.db: (r.first_seq, r.last_seq, r.watermark, r.held) for r in replay.watermarks(lines(spark, rows)).collect()}
    assert got == {"x": (3, 8, 5, 2), "y": (1, 5, 5, 0)}
    assert sorted(r.id for r in replay.replay(lines(spark, rows), closed=False).collect()) == ["d3", "d4", "d5"]
    assert sorted(r.id for r in replay.replay(lines(spark, rows)).collect()) == ["d3", "d4", "d5", "d7", "d8"]


def test_transactions_assemble_deliveries(spark):
    rows = [("x", "put", "a", "1-a", 1, False, 1), ("x", "del", "a", "1-b", 1, None, 2), ("x", "put", "b", "1-c", 1, False, 0), ("x", "noop", "c", None, 2, None, 1), ("x", "put", "c", "1-d", None, False, 1)]
    got = {(r.seq, r.id): (r.rev, r.is_del, r.alive) for r in replay.transactions(lines(spark, rows + rows)).collect()}
    assert got == {(1, "a"): ("1-b", True, False), (1, "b"): ("1-c", False, True), (2, None): (None, False, False)}


def test_watermarks_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK", 10)
    for seqs in (range(5, 95), [*range(5, 40), *range(41, 60)], [*range(5, 40), *range(60, 80)], [7], [*range(0, 20), 20, 22]):
        want = seqs[0]
        while want + 1 in set(seqs):
            want += 1
        got = replay.watermarks(lines(spark, [("x", "put", "a", "r", s, False, 1) for s in seqs])).first()
        assert (got.first_seq, got.watermark, got.held) == (seqs[0], want, sum(s > want for s in seqs)), seqs


def test_streamed_replay(spark, tmp_path):
    rows = random_log(300, 2)
    start = dt.datetime(2025, 1, 1)
    source = tmp_path / "in"
    source.mkdir()

    def drop(part, name):
        with open(source / name, "w") as f:
            for db, op, i, rev, seq, dead, ts in part:
                f.write(json.dumps({"db": db, "shard": 0, "op": op, "id": i, "rev": rev, "seq": seq, "doc": None if dead is None else {"id": i, "deleted": dead}, "ts": None if ts is None else (start + dt.timedelta(hours=ts)).isoformat()}) + "\n")

    for n, part in enumerate((rows[:100], rows[100:200], rows[200:])):
        drop(part, f"{n}.json")
        streaming.replay_stream(spark, str(source), str(tmp_path / "state"), str(tmp_path / "ck"), files_per_batch=1).awaitTermination()
        seen = rows[: 100 * (n + 1)]
        assert {(r.db, r.id, r.seq, r.rev) for r in streaming.current(spark, str(tmp_path / "state")).collect()} == brute_state(seen)


# incremental runs


def brute_runs(rows, runs):
    ok = [(i, db, until) for i, db, until, status in runs if status and status.strip().lower() == "ok" and until is not None]
    seen, out = {}, set()
    for db, op, i, rev, seq, dead, ts in rows:
        fit = [r for r, d, until in ok if d == db and ts is not None and until >= ts]
        content = (db, seq, op.strip().lower() if op else op, rev)
        seen.setdefault(content, set()).add(min(fit) if fit else 10**9)
    for (db, seq, *_), found in seen.items():
        first = min(found)
        out.add((0 if first == 10**9 else first, db, seq))
    return out


def test_runs_against_a_plain_history(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = random_log(400, seed + 10)
        runs = [(i, rnd.choice("xyz"), rnd.choice([None, *range(60)]), rnd.choice(["ok", "OK ", "failed", None])) for i in range(1, 25)]
        start = dt.datetime(2025, 1, 1)
        table = spark.createDataFrame([(i, db, 0, None if u is None else start + dt.timedelta(hours=u), s) for i, db, u, s in runs + runs[:5]], "run_id long, db string, shard int, read_until timestamp_ntz, status string")
        got = {(r.run_id, r.db, r.seq) for r in incremental.run_history(lines(spark, rows), table).collect()}
        assert got == brute_runs(rows, runs)
    assert incremental.run_history(lines(spark, []), table).count() == 0
    odd = lines(spark, rows[:50]).withColumns({"run_id": F.lit("x"), "round": F.lit(9), "_hash": F.lit(0), "status": F.lit("ok")})
    assert {(r.run_id, r.db, r.seq) for r in incremental.run_history(odd, table.limit(0)).collect()} == {(0, db, seq) for db, _, _, _, seq, *_ in rows[:50]}


def test_a_history_survives_failures(spark, tmp_path):
    rows = random_log(300, 5)
    runs = [(i, "xy"[i % 2], i * 2, "ok") for i in range(1, 21)]
    start = dt.datetime(2025, 1, 1)
    table = spark.createDataFrame([(i, db, 0, start + dt.timedelta(hours=u), s) for i, db, u, s in runs], "run_id long, db string, shard int, read_until timestamp_ntz, status string")
    store = StateStore(spark, str(tmp_path / "s"))
    failures = iter([1, 3, 5])
    next_failure = [next(failures)]

    def between(number):
        if number == next_failure[0]:
            next_failure[0] = next(failures, None)
            raise RuntimeError("the run died before its commit")

    for _ in range(3):
        with pytest.raises(RuntimeError):
            incremental.run_history(lines(spark, rows), table, store, between=between)
    got = [(r.run_id, r.db, r.seq) for r in incremental.run_history(lines(spark, rows), table, store, between=between).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(rows, runs)
    assert store.version() == incremental.ROUNDS + 1


def test_single_runs_with_state(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, extra int")
    first = rows((1, "a", 0), (2, None, 0), (2, None, 1), (None, "n", 0))
    assert len(run_safe(first, store)) == len(run_safe(first, store)) == 3  # a failed run is repeated in full
    incremental.commit(incremental.run_once(first, store, ["k"], ["v"]), store)
    assert run_safe(first, store) == []
    second = rows((1, "a", 9), (1, "b", 0), (3, "c", 0), (None, "n", 0))
    before = store.version()
    assert run_safe(second, store) == [(1, "b"), (3, "c")]
    incremental.commit(incremental.run_once(second, store, ["k"], ["v"]), store)
    assert store.version() == before + 1 and run_safe(second, store) == []


def test_what_arrives_between_run_and_commit_is_left_for_the_next(spark, tmp_path):
    store, source = StateStore(spark, str(tmp_path / "s")), str(tmp_path / "t")
    frame = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    frame((1, "a")).write.parquet(source)
    run = incremental.run_once(spark.read.parquet(source), store, ["k"], ["v"])
    other = incremental.run_once(spark.read.parquet(source), store, ["k"], ["v"])
    frame((2, "b")).write.mode("append").parquet(source)
    incremental.commit(run, store)
    with pytest.raises(StaleVersion):
        incremental.commit(other, store)
    assert run_safe(spark.read.parquet(source), store) == [(2, "b")]


def run_safe(df, store):
    return sorted(((r.k, r.v) for r in incremental.run_once(df, store, ["k"], ["v"]).rows.collect()), key=str)


def test_replaced_parts_go_and_the_version_before_stays_readable(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    for n in range(3):
        store.add(spark.range(n, n + 1), n)
    store.replace(spark.range(10), 3)
    assert store.read().count() == 10 and store.read(3).count() == 3
    store.replace(spark.range(20), 4)
    store.replace(spark.range(30), 5)
    assert store.read().count() == 30 and store.read(5).count() == 20
    assert len(list((tmp_path / "s").glob("part-*"))) == 2


def test_content_hash_keeps_nulls_apart(spark):
    one = spark.createDataFrame([("a", None), (None, "a"), ("", "a"), ("a", "")], "x string, y string")
    assert one.select(incremental.content_hash(F.col("x"), F.col("y")).alias("h")).distinct().count() == 4
