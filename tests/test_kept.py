import pytest

from foliospark.operators import search
from foliospark.operators.kept import DocumentIndex
from tests.conftest import DOC, ids


def scan(docs, what, *args, **kwargs):
    return ids(getattr(search, what)(docs, *args, **kwargs))


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    made = DocumentIndex(spark, str(tmp_path_factory.mktemp("index") / "i"), buckets=4)
    made.build(docs)
    return made


TEXTS = ("quick", "note quick", "deleted", "updated", "Quick FOX", "deep", "ёлка", "", "!", "nothing")
TAGS = ((["active"], ["blue"], []), (None, None, ["active"]), (["blue"], None, ["active"]), (["Active", " BLUE"], None, None), (None, ["blue", "x"], None), ([], None, None), (None, [], None), (["no"], None, None))
FIELDS = (({"type": "note"}, ("data.rating", None, None)), ({"data.city": "Moscow"}, None), (None, ("rating", 5, None)), ({"data.a[0].b": "deep", "type": "note"}, None), ({"data.flag": "true"}, None), ({"content": "quick silver"}, None), ({"tags[0]": "active"}, None), (None, ("data.rating", 5, 5)), ({"data.none": "x"}, None), (None, None))


def check(index, docs, most=3):
    for text in TEXTS[:most]:
        assert ids(index.full_text(text)) == scan(docs, "full_text_search", text), text
    for groups in TAGS[:most]:
        assert ids(index.by_tags(*groups)) == scan(docs, "find_by_tags", *groups), groups
    for equals, numeric in FIELDS[:most]:
        assert ids(index.by_fields(equals, numeric)) == scan(docs, "find_by_fields", equals, numeric, mode="data"), (equals, numeric)


def test_searches_equal_those_without_index(index, docs):
    check(index, docs, 10)
    assert [r.asDict() for r in index.fetch(index.full_text("quick")).collect()] == [r.asDict() for r in search.full_text_search(docs, "quick").collect()]
    assert index.fetch(index.full_text("nothing")).columns == docs.columns
    assert ids(index.full_text("quick", skip=1, limit=1)) == ["b"] and ids(index.full_text("quick", limit=0)) == []


def test_only_asked_buckets_are_read(index):
    read = index.full_text("quick fox").inputFiles()
    assert read and all("kind=token" in f for f in read) and len({f.split("bucket=")[1].split("/")[0] for f in read}) <= 2


def test_updates_deletions_and_compaction(spark, docs, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "i"), buckets=4)
    index.build(docs)
    numbers = {r.id: r.doc_num for r in index.documents(deleted=True).collect()}
    rows = [("a", "2-y", False, '{"type":"note","rating":9}', ["new"], "updated text"), ("b", "2-y", True, None, ["active"], "quick silver"), ("g", "1-z", False, None, ["blue"], "quick again"), ("d", "2-y", False, None, None, "quick back")]
    index.update(spark.createDataFrame(rows[:2], DOC))
    index.update(spark.createDataFrame(rows[2:], DOC))
    now = docs.where("id not in ('a', 'b', 'd')").union(spark.createDataFrame(rows, DOC))
    check(index, now)
    after = {r.id: r.doc_num for r in index.documents(deleted=True).collect()}
    assert after == numbers | {"g": 7} and ids(index.full_text("quick", order=("doc_num",))) == ["d", "g"]
    index.compact()
    check(index, now)
    assert {r.id: r.doc_num for r in index.documents(deleted=True).collect()} == after and ids(index.postings("updated")) == ["a"]


def test_an_empty_table(spark, docs, tmp_path):
    index = DocumentIndex(spark, str(tmp_path / "i"))
    index.build(docs.limit(0))
    assert ids(index.full_text("quick")) == ids(index.by_tags(["a"])) == ids(index.by_fields({"a": "b"})) == []
    index.update(docs)
    check(index, docs)
