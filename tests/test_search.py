import random
import re

from pyspark.sql import functions as F

from foliospark.functions import fields
from foliospark.functions.text import tokens
from foliospark.operators import search
from tests.conftest import DOC


def found(df):
    return [r.id for r in df.collect()]


def test_pages_are_clamped(docs):
    assert found(search.all_docs(docs)) == ["a", "b", "c", "d", "e", "f"]
    assert found(search.all_docs(docs, include_deleted=False)) == ["a", "b", "c", "e", "f"]
    assert found(search.all_docs(docs, skip=-3, limit=2)) == ["a", "b"]
    assert found(search.all_docs(docs, skip=4, limit=5000)) == ["e", "f"]
    assert found(search.all_docs(docs, limit=0)) == []


def test_both_ways_to_address_a_field(docs):
    by = lambda **kw: found(search.find_by_fields(docs, **kw))
    assert by(equals={"type": "note"}) == ["a", "b", "c"]
    assert by(equals={"data.type": "note"}) == ["a", "b", "c"]
    assert by(equals={"rating": "5"}) == ["a", "b"]  # raw text: 5.0 differs
    assert by(equals={"data.rating": "5"}) == ["b"]  # the index holds strings only
    assert by(equals={"nul": ""}) == ["c"] and by(equals={"missing": ""}) == []
    assert by(equals={"data.a[0].b": "deep"}) == ["a"]
    assert by(equals={"data.geo.geo.hash": "u1"}) == ["a"]
    assert by(equals={"data.flag": "true"}) == ["b"]
    assert by(equals={"tags[0]": "BLUE"}) == ["c"] and by(equals={"content": "quick silver"}) == ["b"]
    assert by(equals={}) == ["a", "b", "c", "e", "f"]
    assert by(numeric=("data.rating", 5, 5)) == ["a", "c"]
    assert by(numeric=("rating", 5, None)) == ["a", "b", "c"]
    assert by(equals={"type": "note"}, numeric=("rating", None, 4)) == []


def test_the_data_may_decide_the_way(docs):
    # No live document has "Moscow" elsewhere; a path without any index entry falls back to the top-level name.
    assert found(search.find_by_fields(docs, {"data.city": "Moscow"}, mode="data")) == ["a"]
    assert found(search.find_by_fields(docs, None, ("data.rating", 5, 5), mode="data")) == ["a", "c"]
    assert found(search.find_by_fields(docs, {"data.rating": "6"}, mode="data")) == []


def test_tags(docs):
    by = lambda *a: found(search.find_by_tags(docs, *a))
    assert by(["active"]) == ["a", "b"]
    assert by(["ACTIVE ", "Blue"]) == ["a"]
    assert by(None, ["blue"]) == ["a", "c"]
    assert by(None, []) == []
    assert by([], None, []) == ["a", "b", "c", "e", "f"]
    assert by(None, None, ["active"]) == ["c", "e", "f"]


def test_full_text(docs):
    by = lambda q: found(search.full_text_search(docs, q))
    assert by("QUICK") == ["a", "b"]
    assert by("quick note") == ["a", "b"]
    assert by("moscow fox blue") == ["a"]
    assert by("ёлка") == ["e"]
    assert by("x !") == [] and by("") == []  # no token has one letter
    assert found(search.full_text_search_compact(docs.withColumn("doc_num", -F.ascii("id")), "quick")) == ["b", "a"]


def test_tokens_and_leaves(spark):
    one = spark.createDataFrame([("Ab-c1 é 𝒜𝒜x yy",)], "t string")
    assert one.select(tokens(F.col("t"))).first()[0] == ["ab", "c1", "yy"]
    j = r'{"k":"va\"lue","n":[1,"two",{"m":"Жx\\n"}],"t":true,"e":""}'
    leaves = spark.createDataFrame([(j,), ("{",), (None,)], "j string").select(fields.string_leaves(F.col("j"))).collect()
    assert [re.split(r"\s+", s) for s in leaves[0][0]] == [["va", "lue"], ["two"], ["Жx", "n"], [""]]
    assert leaves[1][0] == [] and leaves[2][0] == []


def test_numbers(spark):
    rows = spark.createDataFrame([(t,) for t in ("5", " 7 ", "1e3", "7d", "NaN", "", "-.5", "0x1", None)], "t string")
    assert [r[0] for r in rows.select(fields.to_number(F.col("t"))).collect()] == [5.0, 7.0, 1000.0, None, None, None, -0.5, None, None]


def test_random_documents_against_a_plain_model(spark):
    rnd = random.Random(5)
    words, tags = ["alpha", "beta", "gamma", "x"], ["Red", "red ", "BLUE", "", None]
    rows = [
        (f"d{i:03d}", "1-a", rnd.random() < 0.2, rnd.choice([None, "{}", '{"k":"alpha"}', '{"k":3}', '{"k":{"z":"beta"}}']), rnd.choice([None, rnd.sample(tags, 2)]), " ".join(rnd.choices(words, k=rnd.randint(0, 4))))
        for i in range(120)
    ]
    docs = spark.createDataFrame(rows, DOC).cache()

    def key_set(t):
        return {x.strip().upper() for x in t or [] if x and x.strip()}

    def token_set(r):
        inner = re.findall(r'"(\w+)"(?!\s*:)', r[3] or "")
        return set(re.findall(r"[a-z]{2,}", " ".join([*inner, *(t for t in r[4] or [] if t), r[5]]).lower()))

    live = [r for r in rows if not r[2]]
    assert found(search.find_by_tags(docs, ["RED"], limit=1000)) == [r[0] for r in live if "RED" in key_set(r[4])]
    assert found(search.find_by_tags(docs, None, ["red", "blue"], limit=1000)) == [r[0] for r in live if key_set(r[4]) & {"RED", "BLUE"}]
    for q in ({"alpha"}, {"alpha", "beta"}, {"red", "gamma"}):
        assert found(search.full_text_search(docs, " ".join(q), limit=1000)) == [r[0] for r in live if q <= token_set(r)]


def test_paths_of_many_parts(spark):
    from foliospark.functions import fields

    rows = spark.createDataFrame([('{"a":{"b.c":{"d":[{"e":{"f":{"g":"x"}}}]}},"n":{"n":{"n":{"n":{"n":{"n":7.5}}}}}}',), ('{"a":1}',), ("{",), (None,)], "j string")
    got = rows.select(fields.path_text(F.col("j"), "a.b.c.d[0].e.f.g").alias("t"), fields.path_number(F.col("j"), "n.n.n.n.n.n").alias("n")).collect()
    assert [tuple(r) for r in got] == [("x", 7.5)] + [(None, None)] * 3
