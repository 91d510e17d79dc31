from pyspark.sql import functions as F

from foliospark.operators import indexes, routing, sets, stats

VECTORS = {  # id: (murmur3, crc32, sha256)
    "user-001": (793043194, 2140275671, 1241236869),
    "user-002": (1392358175, 1721455213, 513538421),
    "order-100": (2063573536, 555382685, 644175917),
    "log-2024-001": (1123568997, 1595347693, 1480449875),
    "config-cache": (886347482, 981505389, 940504201),
}


def test_routing_vectors(spark):
    rows = spark.createDataFrame([(k,) for k in VECTORS], "id string")
    for n, algorithm in enumerate(("murmur3", "crc32", "sha256")):
        got = {r.id: (r.h, r.s) for r in rows.select("id", routing.key_hash(F.col("id"), algorithm).alias("h"), routing.shard_id(F.col("id"), 3, algorithm).alias("s")).collect()}
        assert got == {k: (v[n], v[n] % 3) for k, v in VECTORS.items()}
    edge = spark.createDataFrame([("",), (None,)], "id string")
    assert [r[0] for r in edge.select(routing.shard_id(F.col("id"), 3)).collect()] == [0, 0]
    assert routing.keys_by_shard(rows, 3).agg(F.sum("n_keys")).first()[0] == 5


def test_topology(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(map(tuple, routing.topology_diff(a, b).collect())) == [(1, "removed"), (3, "added")]
    e = spark.createDataFrame([(0, "u2", 2), (0, "u1", 1), (1, "v", 1)], "shard int, url string, position int")
    assert sorted(map(tuple, routing.topology(e).collect())) == [(0, "u1", ["u2"]), (1, "v", [])]
    c = spark.createDataFrame([(5, 2), (7, 1), (7, 0)], "seq int, replica_index int")
    assert tuple(routing.best_candidate(c).first()) == (7, 0)


def test_flat_fields(docs):
    flat = {(r.id, r.path): (r.kind, r.text, r.number) for r in indexes.flatten_fields(docs).collect()}
    assert flat["a", "data.a[0].b"] == ("string", "deep", None) and flat["a", "data.geo.geo.hash"][1] == "u1"
    assert flat["c", "data.rating"] == ("number", "5.0", 5.0) and flat["c", "data.nul"][0] == "null"
    assert not [k for k in flat if k[0] in "ef"]
    plain = {r.path for r in indexes.flatten_fields(docs, "").where("id = 'b'").collect()}
    assert plain == {"type", "rating", "flag"}


def test_derived_tables(docs):
    assert indexes.eq_index(docs).where("field = 'data.type'").count() == 3  # no deleted document
    assert sorted(r.id for r in indexes.num_index(docs).where("field = 'data.rating'").collect()) == ["a", "c"]
    assert sorted(map(tuple, indexes.tag_index(docs).collect())) == [("ACTIVE", "a"), ("ACTIVE", "b"), ("BLUE", "a"), ("BLUE", "c")]
    df = {r.token: r.df for r in indexes.document_frequencies(docs).collect()}
    assert df["quick"] == 2 and df["note"] == 3 and "deleted" not in df
    numbered = docs.withColumn("doc_num", F.ascii("id") - 97)
    lists = {r.token: r.postings for r in indexes.posting_lists(numbered).collect()}
    assert lists["quick"] == [0, 1]
    assert [r.id for r in indexes.search_postings(indexes.token_index(docs), ["quick", "note"]).collect()] == ["a", "b"]
    s = indexes.index_stats(numbered).first()
    assert s.documents == 5 and s.postings == sum(df.values()) and s.hash_set_bytes == 48 * s.postings
    one = stats.db_stats(docs, 3).first()
    assert (one.docs_total, one.docs_alive, one.tag_index_count, one.full_text_tokens) == (6, 5, 2, len(df))
    empty = stats.db_stats(docs.limit(0)).first()
    assert (empty.docs_total, empty.tag_index_count) == (0, 0)


def test_shard_statistics(docs):
    shards = stats.shard_stats(docs.withColumn("shard", F.ascii("id") % 2))
    total = stats.merge_shard_stats(shards.withColumn("seq", F.lit(4))).first()
    assert total.docs_total == 6 and total.docs_alive == 5 and total.seq == 4
    assert total.full_text_tokens > stats.db_stats(docs).first().full_text_tokens  # shared tokens count in each shard


def test_lists_and_bits(spark):
    one = spark.createDataFrame([([1, 3, 5, 7, 9, 11, 13], [2, 3, 5, 8, 11, 14], [10, 20, 30, 40, 50], "10100110")], "a array<int>, b array<int>, c array<int>, bits string")
    r = one.select(
        sets.list_intersect([F.col("a"), F.col("b")]).alias("i"), sets.next_geq(F.col("c"), F.lit(25)).alias("g"), sets.next_geq(F.col("c"), F.lit(51)).alias("none"), sets.next_geq_index(F.col("c"), F.lit(25)).alias("gi"),
        F.array(*(sets.rank(F.col("bits"), F.lit(i)) for i in (0, 1, 3, 6, 8))).alias("rank"), F.array(*(sets.select(F.col("bits"), F.lit(i)) for i in range(5))).alias("sel"),
    ).first()
    assert (r.i, r.g, r.none, r.gi, r.rank, r.sel) == ([3, 5, 11], 30, None, 2, [0, 1, 2, 3, 4], [0, 2, 5, 6, -1])


def test_elias_fano_size(spark):
    rows = spark.createDataFrame([(8, 1000), (100, 50), (1, 0)], "n int, hi int")
    assert [r[0] for r in rows.select(indexes.elias_fano_bytes(F.col("n"), F.col("hi"))).collect()] == [8 + 8 + 8 + 8 + 12, 24 + 16 + 8 + 0 + 12, 8 + 8 + 8 + 12]


def test_measurements(spark):
    rows = spark.createDataFrame([("json", 10, 4.0), ("json", 10, 8.0), ("bin", 10, 3.0)], "format string, n int, ms double")
    m = {r.format: (r.ms_mean, r.ms_std) for r in stats.mean_and_deviation(rows, ["format", "n"], ["ms"]).collect()}
    assert m == {"json": (6.0, 2.0), "bin": (3.0, 0.0)}
    assert tuple(stats.percentiles(rows, "ms", [0.5, 0.95]).first()) == (4.0, 7.6)
    last = stats.latest_metric(rows.withColumn("k", F.col("ms")), ["format"], "k").where("format = 'json'").first()
    assert last.ms == 8.0
    two = spark.createDataFrame([("json", 10, 8.0), ("bin", 10, 2.0)], "format string, n int, ms double")
    assert {r.format: r.speedup for r in stats.speedup(two, "format", "ms", "json").collect()} == {"json": 1.0, "bin": 4.0}
    sizes = spark.createDataFrame([("json", 10, 100), ("json", 10, 100)], "format string, docs int, bytes int")
    assert tuple(stats.bench_sizes(sizes, "bytes", "docs", ["format"]).first()) == ("json", 200, 20.0)
    e = spark.createDataFrame([(1, True, None), (2, False, "bad"), (3, False, None)], "seq long, ok boolean, error string")
    assert tuple(stats.batch_result(e).first())[:3] == (1, 2, 1)
    assert sorted(map(tuple, stats.batch_errors(e).collect())) == [(2, "bad"), (3, "Unknown error")]


def test_keys_of_shards_and_scales(spark):
    rows = spark.createDataFrame([(f"k{i}",) for i in range(100)] * 2, "id string")
    lists = routing.group_by_shards(rows, 3, block=10).collect()
    assert sorted(k for r in lists for k in r["keys"]) == sorted(f"k{i}" for i in range(100)) and len(lists) > 6
    placed = {r.id: r.shard for r in routing.with_shard(rows.distinct(), 3).collect()}
    assert all(placed[k] == r.shard for r in lists for k in r["keys"])
    assert [r.n for r in stats.scales(spark.createDataFrame([(5,), (1000,), (5,), (70,), (None,)], "n int"), 100).collect()] == [5, 70, 100]


def test_batch_counters(spark):
    rows = spark.createDataFrame([(1, True, None), (2, False, "gone"), (3, True, None), (4, False, None)], "seq long, ok boolean, error string")
    r = stats.batch_result(rows).first()
    assert (r.success_count, r.failed_count, r.last_seq, r.errors) == (2, 2, 3, {2: "gone", 4: "Unknown error"})
