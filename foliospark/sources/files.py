"""Documents from and to files: JSON and JSON lines, logs, snapshots with a manifest, columnar projections, generators."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from dataclasses import dataclass
from typing import Literal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import codecs, proto
from foliospark.functions.json_tree import _Number, _Object, parse, whole
from foliospark.sources.numbering import numbered
from foliospark.sources.schema import NEWS, WAL


@dataclass
class LoadStats:
    """What a load saw. ``skipped_bad_lines`` counts lines that are no JSON."""

    path: str
    size_bytes: int
    sha256: str
    parsed_documents: int
    skipped_bad_lines: int
    hit_max_docs: bool


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, place``: the non-blank lines of text files, in order."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("line"), F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_n"))
    return text.where(F.trim(F.regexp_replace("line", r"\s+", " ")) != "")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``json, _f, _n``: one JSON text for each record of a ``.json`` array or object, or for each line of other files."""
    if not path.lower().endswith(".json"):
        return _lines(spark, path).withColumnRenamed("line", "json")
    whole = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", "^\\ufeff", "")).alias("j"), F.col("_metadata.file_path").alias("_f"))
    parsed = F.try_parse_json("j")
    items = F.when(F.col("j").startswith("["), F.from_json("j", "array<variant>")).otherwise(F.array(parsed))
    return whole.where(F.col("j") != "").select(F.posexplode(items).alias("_n", "_v"), "_f").select(F.to_json("_v").alias("json"), "_f", F.col("_n").cast("long").alias("_n"))


def load_json(spark: SparkSession, path: str, max_docs: int | None = None) -> tuple[DataFrame, LoadStats]:
    """(documents, statistics) of a JSON or JSON-lines file.

    Ids are ``ds-000000`` and so on by the place of the good records; null properties are dropped, tags and content are
    null. Blank lines are ignored, bad lines skipped and counted. ``max_docs`` stops the load, as asked for.
    """
    records = _records(spark, path).withColumn("_ok", F.try_parse_json("json").isNotNull())
    good = records.where("_ok").select("json", "_f", "_n")
    if max_docs is not None:
        good = good.orderBy("_f", "_n").limit(max_docs)
    rows = numbered(good, ["_f", "_n"], "_i")
    data = F.when(F.ltrim("json").startswith("{"), drop_null_properties(F.col("json"))).otherwise("{}")
    docs = rows.select(
        F.concat(F.lit("ds-"), F.lpad(F.col("_i").cast("string"), 6, "0")).alias("id"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"),
        data.alias("data_json"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("content"),
    )
    size, digest = _digest(spark, path)
    n, bad = docs.count(), records.where(~F.col("_ok")).count()
    return docs, LoadStats(path, size, digest, n, bad, max_docs is not None and n >= max_docs)


#: Bytes of a file up to which its digest is computed by a task of its own; larger ones pass through the driver.
DIGESTED = 1 << 30


def _digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """(size, SHA-256 in upper case) of a file; of several, the digest of their digests in the order of their names."""
    fs, at = _fs(spark, path), _path(spark, path)
    found = [s for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    sums = {}
    if small := [s.getPath().toString() for s in found if s.getLen() <= DIGESTED]:
        rows = spark.read.format("binaryFile").load(small).select(F.col("_metadata.file_name").alias("name"), F.upper(F.sha2("content", 256)).alias("sha"))
        sums = {r.name: r.sha for r in rows.collect()}
    for s in found:
        if s.getLen() > DIGESTED:
            own, stream = hashlib.sha256(), fs.open(s.getPath())
            while piece := bytes(stream.readNBytes(1 << 20)):
                own.update(piece)
            stream.close()
            sums[s.getPath().getName()] = own.hexdigest().upper()
    digests = [sums[n] for n in sorted(sums)]
    return sum(s.getLen() for s in found), digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest().upper()


def _without_nulls(value) -> str:
    if isinstance(value, _Object):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_without_nulls(v)}" for k, v in value if v is not None) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_without_nulls, value)) + "]"
    return str(value) if isinstance(value, _Number) else json.dumps(value, ensure_ascii=False)


def _drop_nulls(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else whole(_without_nulls(parse(t))))


def drop_null_properties(data_json: Column) -> Column:
    """A JSON text without null properties at any depth; nulls in lists and the text of numbers stay."""
    return F.pandas_udf(_drop_nulls, "string")(data_json)


def to_json_array(lines: DataFrame) -> DataFrame:
    """Good JSON lines (column ``line``) as the text lines of one JSON array, in order: brackets and commas added."""
    good = lines.where(F.try_parse_json("line").isNotNull())
    rows = numbered(good.select("line", F.monotonically_increasing_id().alias("_m")), ["_m"], "_i")
    body = rows.select(F.concat(F.when(F.col("_i") == 0, "[").otherwise(","), F.col("line")).alias("value"), "_i")
    end = rows.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") == 0, "[]").otherwise("]").alias("value"), F.col("_n").alias("_i"))
    return body.union(end).orderBy("_i").select("value")


def salvage(lines: DataFrame) -> DataFrame:
    """``item``: the JSON object in each line, from its first ``{`` to its last ``}``; lines without a good one are left out."""
    found = F.regexp_extract(F.trim("line"), r"(?s)(\{.*\})", 1)
    return lines.select(found.alias("item")).where((F.col("item") != "") & F.try_parse_json("item").isNotNull())


def to_documents(items: DataFrame) -> DataFrame:
    """Documents from raw items (JSON texts): data, the category as tag, headline or title and description as content."""

    def field(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.get_json_object("item", f"$.{n}"), F.lit("")) for n in names))

    basis = F.coalesce(F.get_json_object("item", "$.link"), F.concat_ws("|", F.coalesce(F.get_json_object("item", "$.headline"), F.lit("")), F.coalesce(F.get_json_object("item", "$.date"), F.lit(""))))
    content = F.nullif(F.concat_ws(" ", field("headline", "title"), field("short_description", "summary")), F.lit(""))
    category = field("category")
    return items.select(
        F.concat(F.lit("news-"), F.substring(F.sha1(basis.cast("binary")), 1, 16)).alias("id"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"),
        F.col("item").alias("data_json"), F.when(category.isNotNull(), F.array(category)).alias("tags"), content.alias("content"),
    )


def news_projection(docs: DataFrame) -> DataFrame:
    """The columnar form: counts and the typed fields of the data. A null list of tags counts -1."""
    typed = docs.select("id", F.coalesce(F.size("tags"), F.lit(-1)).alias("tags_count"), F.length("content").alias("content_len"), F.from_json("data_json", NEWS).alias("_d"))
    return typed.select("id", "tags_count", "content_len", "_d.*")


def read_binary_documents(spark: SparkSession, path: str, form: Literal["binary", "proto"] = "binary") -> DataFrame:
    """Documents of files that hold one each, in the tagged binary form or as messages."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    return codecs.from_binary(raw, "content") if form == "binary" else proto.from_proto(raw, "content")


def write_binary_documents(docs: DataFrame, folder: str, form: Literal["binary", "proto"] = "binary") -> None:
    """Documents as rows ``id, binary`` of Parquet files: files of their own for each would not scale."""
    (codecs.to_binary(docs) if form == "binary" else proto.to_proto(docs, "binary")).write.mode("overwrite").parquet(folder)


def write_columnar(docs: DataFrame, folder: str) -> None:
    """The columnar form as Parquet and as ORC, replacing what is there."""
    projected = news_projection(docs)
    projected.write.mode("overwrite").parquet(f"{folder}/parquet")
    projected.write.mode("overwrite").orc(f"{folder}/orc")


def append_metrics(metrics: DataFrame, folder: str) -> None:
    """Metric rows as CSV with a header, added to what is there."""
    metrics.write.mode("append").option("header", True).csv(folder)


def append_log(rows: DataFrame, folder: str, epoch: int = 0) -> None:
    """Log rows as JSON lines, added to the segment of an epoch; committed when the job is."""
    rows.write.mode("append").option("ignoreNullFields", False).json(f"{folder}/epoch={epoch}")


def _named(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _either(fields: Column, name: str) -> Column:
    return F.coalesce(_named(fields, name[0].lower() + name[1:]), _named(fields, name))


def parse_log(lines: DataFrame) -> DataFrame:
    """Log rows of JSON lines (column ``value``) with names in either case; blank and bad lines are left out.

    A line is parsed once to its fields and the document in it once more; nothing else looks at the text.
    """
    fields = "map<string,string>"
    rows = lines.where(F.ltrim("value").startswith("{")).select(F.from_json("value", fields).alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.select("v", F.from_json(_either(F.col("v"), "Doc"), fields).alias("d"))
    v, d = F.col("v"), F.col("d")
    body = F.when(d.isNotNull(), F.struct(
        _either(d, "Id").alias("id"), _either(d, "Rev").alias("rev"), F.coalesce(_either(d, "Deleted").cast("boolean"), F.lit(False)).alias("deleted"),
        F.coalesce(_named(d, "data_json"), _either(d, "Data")).alias("data_json"), F.from_json(_either(d, "Tags"), "array<string>").alias("tags"), _either(d, "Content").alias("content"),
    ))
    return rows.select(_either(v, "Op").alias("op"), _either(v, "Id").alias("id"), _either(v, "Rev").alias("rev"), _either(v, "Seq").try_cast("long").alias("seq"), body.alias("doc"), _either(v, "Ts").try_cast("timestamp").alias("ts"))


def read_log(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """The segments of a log from an epoch on; an absent log is empty. Segments before it aren't opened."""
    names = [s.getPath().getName() for s in _fs(spark, folder).listStatus(_path(spark, folder))] if _exists(spark, folder) else []
    wanted = [n for n in names if (int(n[6:]) if n.startswith("epoch=") else 0) >= since and not n.startswith((".", "_"))]
    return parse_log(spark.read.text([f"{folder}/{n}" for n in wanted])) if wanted else spark.createDataFrame([], WAL)


def log_bytes(spark: SparkSession, folder: str) -> int:
    """The size of a log's files."""
    return _fs(spark, folder).getContentSummary(_path(spark, folder)).getLength() if _exists(spark, folder) else 0


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside and renamed, so that readers see the old or the new one."""
    fs, fresh = _fs(spark, path), _path(spark, path + ".new")
    stream = fs.create(fresh, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, _path(spark, path), over)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it is absent."""
    if not _exists(spark, path):
        return None
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode("utf-8-sig")
    finally:
        stream.close()


def create_snapshot(docs: DataFrame, folder: str, last_seq: int) -> str:
    """Heads as a snapshot named by ``last_seq``, then the manifest that makes it the active one. Gives its name."""
    name = f"snapshot-{last_seq:012d}"
    docs.write.mode("overwrite").parquet(f"{folder}/{name}")
    manifest = {"LastSeq": last_seq, "ActiveSnapshot": name, "SnapshotTimeUtc": dt.datetime.now(dt.UTC).isoformat()}
    write_text(docs.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, indent=1))
    return name


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest, None if it is absent or broken."""
    text = read_text(spark, f"{folder}/manifest.json")
    try:
        manifest = json.loads(text) if text else None
    except ValueError:
        return None
    return manifest if isinstance(manifest, dict) and "LastSeq" in manifest else None


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """(documents, last seq) of the active snapshot; (None, 0) without one. JSON-lines snapshots are read as well."""
    manifest = read_manifest(spark, folder)
    if manifest is None or not manifest.get("ActiveSnapshot"):
        return None, 0
    path = f"{folder}/{manifest['ActiveSnapshot']}"
    if not _exists(spark, path):
        return None, 0
    if path.endswith((".jsonl", ".json")):
        lines = spark.read.text(path).select(F.regexp_replace("value", "^\\ufeff", "").alias("value"))
        wrapped = lines.select(F.concat(F.lit('{"doc":'), F.col("value"), F.lit("}")).alias("value"))
        return parse_log(wrapped).select("doc.*"), int(manifest["LastSeq"])
    return spark.read.parquet(path), int(manifest["LastSeq"])


def synthetic(spark: SparkSession, n: int, seed: int = 123, prefix: str = "syn", tags: tuple[str, str] = ("kaggle", "bench"), content: bool = True) -> DataFrame:
    """n generated documents with nested data; the same for the same seed, on any number of partitions."""
    i = F.col("i")
    number = F.concat(F.lit(f"{prefix}-"), F.lpad(i.cast("string"), 6, "0"))

    def random(k: int, below: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), i), F.lit(below))

    data = F.to_json(F.struct(
        F.concat(F.lit("user_"), i).alias("name"), (18 + i % 60).alias("age"), (random(1, 10**9) / 10**7).alias("score"), (i % 3 == 0).alias("active"),
        F.array(*(F.lit(t) for t in tags), F.when(i % 2 == 0, "even").otherwise("odd")).alias("tags"),
        F.struct(random(2, 1000).alias("x"), (random(3, 10**9) / 10**9).alias("y"), F.struct(F.lit("v").alias("k")).alias("z")).alias("nested"),
    ))
    text = F.array_join(F.array_repeat(F.lit("lorem ipsum"), (2 + i % 5).cast("int")), " ") if content else F.lit(None).cast("string")
    own = F.array(F.lit("synthetic")) if content else F.lit(None).cast("array<string>")
    return spark.range(n).select(F.col("id").alias("i")).select(number.alias("id"), F.lit(None).cast("string").alias("rev"), F.lit(False).alias("deleted"), data.alias("data_json"), own.alias("tags"), text.alias("content"))


def bench_documents(spark: SparkSession, n: int, seed: int = 123) -> DataFrame:
    """The generated documents of the insert-and-read benchmark: data only."""
    return synthetic(spark, n, seed, "bench", ("bench", "synthetic"), content=False)


def tokenised_documents(spark: SparkSession, n: int, per_doc: int, vocabulary: int, seed: int = 42) -> DataFrame:
    """``id, tokens``: for each document ``per_doc`` different words of a vocabulary, chosen by a seeded order."""
    words = F.transform(F.sequence(F.lit(0), F.lit(vocabulary - 1)), lambda w: F.struct(F.xxhash64(F.lit(seed), F.col("i"), w).alias("o"), F.concat(F.lit("word"), w).alias("w")))
    chosen = F.transform(F.slice(F.array_sort(words), 1, per_doc), lambda s: s["w"])
    return spark.range(n).select(F.col("id").alias("i")).select(F.concat(F.lit("doc-"), F.col("i")).alias("id"), chosen.alias("tokens"))
