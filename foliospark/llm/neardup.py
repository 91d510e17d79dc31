"""Near-duplicate texts (problem 3): banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts with the same set of words form a class, and only classes are compared. A class gets MinHash bands, by which
candidates meet in an equi-join, and a signature of one-bit MinHashes in batches of 64. In the join's condition the
batches are compared one after another, and a candidate is dropped as soon as the posterior probability that its
similarity reaches the threshold falls under the chosen miss probability. Survivors are verified on the word sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import words
from foliospark.sources.tables import stage

#: Least similarity (distinct words in both over distinct words in either) and least number of distinct words.
THRESHOLD = 0.6
MIN_WORDS = 16
#: Bands and MinHashes in a band: a pair at 0.6 shares a band with probability 0.994, one at 0.65 with 0.9996.
BANDS = 64
ROWS = 5
#: Batches of 64 one-bit MinHashes, and the miss probability at which a candidate is given up.
BATCHES = 4
MISS = 1e-4
#: Batches that travel with the bands, to prune where candidates meet.
EARLY = 2
SEED = 20_250_101

_CHUNK = 4_096  # words hashed at a time
_NAMES = [f"s{i}" for i in range(BATCHES)]


def _family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n hash functions on 64-bit values."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minhashes(flat: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHashes (sets x functions) of sets of 64-bit values laid end to end; no set may be empty."""
    out = np.empty((len(starts), len(a)), np.uint32)
    ends = np.append(starts[1:], len(flat))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, "right")))
        if hi - lo == 1:  # one set, maybe a very large one
            cuts = range(starts[lo], ends[lo], _CHUNK)
            out[lo] = np.min([_hashed(flat[c : min(c + _CHUNK, ends[lo])], a, b).min(axis=0) for c in cuts], axis=0)
        else:
            used, local = np.unique(flat[starts[lo] : ends[hi - 1]], return_inverse=True)
            out[lo:hi] = np.minimum.reduceat(_hashed(used, a, b)[local], starts[lo:hi] - starts[lo], axis=0)
        lo = hi
    return out


def _hashed(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((values[:, None] ^ b) * a) >> np.uint64(32)).astype(np.uint32)


def _of_sets(batch: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sets = batch.column("hashes")
    offsets = sets.offsets.to_numpy().astype(np.int64)
    flat = sets.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    return minhashes(flat, offsets[:-1] - offsets[0], a, b)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the batches of one-bit MinHashes; all other columns pass through."""
    a, b = (x[BANDS * ROWS :] for x in _family(BANDS * ROWS + BATCHES * 64))
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        if batch.num_rows:
            bits = (_of_sets(batch, a, b) & np.uint32(1)).astype(np.uint64).reshape(-1, BATCHES, 64)
            signed = (bits * bit).sum(axis=2, dtype=np.uint64).view(np.int64)
            kept = [n for n in batch.schema.names if n != "hashes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *(pa.array(signed[:, i]) for i in range(BATCHES))], [*kept, *_NAMES])


def _band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each band of each class. The table's salt is part of the band, so tables never meet."""
    a, b = (x[: BANDS * ROWS] for x in _family(BANDS * ROWS + BATCHES * 64))
    mixers = _family(BANDS * ROWS, SEED + 1)[0].reshape(BANDS, ROWS)
    for batch in batches:
        if batch.num_rows:
            banded = _of_sets(batch, a, b).reshape(-1, BANDS, ROWS).astype(np.uint64)
            salt = batch.column("salt").to_numpy().view(np.uint64)[:, None]
            keys = ((banded * mixers).sum(axis=2, dtype=np.uint64) ^ mixers[:, 0]) + salt
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            place = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            carried = ["cid", *_NAMES[:EARLY]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *(batch.column(n).take(place) for n in carried)], ["band", *carried])


def least_matches(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The fewest matches among n one-bit MinHashes at which P(similarity >= threshold) is still ``miss`` or more.

    A one-bit MinHash matches with probability (1 + similarity) / 2; the prior of the similarity is uniform.
    """
    s = (1 + (np.arange(20_000) + 0.5) / 20_000) / 2
    far = s >= (1 + threshold) / 2
    for m in range(n + 1):
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        weight = np.exp(log - log.max())
        if weight[far].sum() >= miss * weight.sum():
            return m
    return n


def word_sets(texts: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``tab, id, h, words``: the distinct words of each text, sorted, and a hash of 128 bits of table and words."""
    rows = texts.select("tab", "id", F.array_sort(F.array_distinct(words(F.col("text")))).alias("words")).where(F.col("id").isNotNull() & (F.size("words") >= least))
    return rows.select("tab", "id", F.unhex(F.md5(F.concat(F.coalesce("tab", F.lit("\x00")), F.lit("\x1f"), F.array_join("words", " ")))).alias("h"), "words")


def classes(texts: DataFrame, least: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, classes), both staged: ``tab, id, cid``, and ``cid, tab, words`` with the signature of each class.

    Texts of a table with the same words are one class; texts without a table are a table of their own. Numbers of classes are unique and fixed by staging.
    """
    sets = stage(word_sets(texts, least), "sets")
    reps = sets.groupBy("h").agg(F.first("tab").alias("tab"), F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("cid"), "tab", "h", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    signed = stage(reps.mapInArrow(_sign, "cid long, tab string, h binary, words array<string>, " + ", ".join(f"{n} long" for n in _NAMES)), "classes")
    member = sets.select("tab", "id", "h").distinct().join(signed.select("h", "cid").hint("merge"), "h")
    return stage(member.select("tab", "id", "cid"), "members"), signed.drop("h")


def _similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def similar_classes(signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``tab, cid_a, cid_b``: pairs of different classes of one table that are at least so similar.

    The first batches of each signature travel with the bands and prune where candidates meet, so a band that many
    classes share emits no more than what passes; the other batches, then the words are fetched for the pairs left. All
    joins are merge joins by hint: sizes behind Python functions can't be estimated, so none is left to an estimate.
    """
    salted = signed.select("cid", *_NAMES[:EARLY], F.xxhash64("tab").alias("salt"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    banded = salted.mapInArrow(_band, "band long, cid long" + "".join(f", {n} long" for n in _NAMES[:EARLY]))

    def tests(names: list[str], x: str, y: str) -> list[Column]:
        agreed, out = F.lit(0), []
        for i, name in enumerate(names, 1):
            agreed = agreed + 64 - F.bit_count(F.col(x + name).bitwiseXOR(F.col(y + name)))
            out.append(agreed >= least_matches(64 * i, threshold))
        return out

    met = banded.alias("a").join(banded.alias("b").hint("merge"), reduce(and_, [F.col("a.band") == F.col("b.band"), F.col("a.cid") < F.col("b.cid"), *tests(_NAMES[:EARLY], "a.", "b.")]))
    pairs = met.select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b")).distinct()

    def fetch(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(signed.select(F.col("cid").alias(f"cid_{side}"), *(F.col(c).alias(f"{side}_{c}") for c in columns)).hint("merge"), f"cid_{side}")
        return pairs

    kept = fetch(pairs, *_NAMES).where(reduce(and_, tests(_NAMES, "a_", "b_"))).select("cid_a", "cid_b")
    words_of = fetch(kept, "words", "tab")
    return words_of.where(_similarity(F.col("a_words"), F.col("b_words")) >= threshold).select(F.col("a_tab").alias("tab"), "cid_a", "cid_b")


def similar_pairs(texts: DataFrame, threshold: float = THRESHOLD, least: int = MIN_WORDS) -> DataFrame:
    """Distinct ``tab, id_a, id_b`` (``id_a < id_b``): ids of one table whose texts are at least so similar.

    ``texts`` has ``tab, id, text``. Texts with fewer than ``least`` distinct words, null ids and null texts take no
    part; repeated rows count once. Pairs of classes are found first; only the last step writes them out for all their
    members, and pairs between copies. :func:`groups` is the form that stays small where copies abound.
    """
    member, signed = classes(texts, least)
    m, n = member.select(F.col("id").alias("x"), F.col("cid").alias("cid_a")), member.select(F.col("id").alias("y"), F.col("cid").alias("cid_b"))
    near = similar_classes(signed, threshold).join(m.hint("merge"), "cid_a").join(n.hint("merge"), "cid_b").select("tab", "x", "y")
    crowded = member.groupBy("cid").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    shared = member.join(crowded.hint("merge"), "cid")
    same = shared.select("cid", "tab", F.col("id").alias("x")).join(shared.select("cid", F.col("id").alias("y")).hint("merge"), "cid").where(F.col("x") < F.col("y")).select("tab", "x", "y")
    both = near.union(same).where(F.col("x") != F.col("y"))
    return both.select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the connected components of edges ``u, v`` (long), named by their least node.

    Alternating star contraction until nothing changes: only edges are kept, never the list of a node's neighbours, and
    each round is staged.
    """
    edges = stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        two_way = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = two_way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two_way.where(F.col("v") > F.col("u")).join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        fresh = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        fresh = stage(fresh, "edges")
        if not fresh.exceptAll(edges).take(1) and not edges.exceptAll(fresh).take(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = fresh


def groups(texts: DataFrame, threshold: float = THRESHOLD, least: int = MIN_WORDS) -> DataFrame:
    """``tab, id, class_id, links, group_id``: a row for each document that takes part.

    Texts with the same words are a class, named by the least id in it; ``links`` is the number of other classes similar
    to it, and ``group_id`` is the least id of all documents that chains of similar pairs connect.
    """
    member, signed = classes(texts, least)
    pairs = stage(similar_classes(signed, threshold).select("cid_a", "cid_b"), "pairs")
    links = pairs.select(F.col("cid_a").alias("cid")).union(pairs.select("cid_b")).groupBy("cid").agg(F.count("*").alias("links"))
    root = components(pairs.select(F.col("cid_a").alias("u"), F.col("cid_b").alias("v"))).withColumnRenamed("node", "cid")
    own = member.groupBy("cid").agg(F.min("id").alias("class_id"))
    own = own.join(links.hint("merge"), "cid", "left").join(root.hint("merge"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = own.groupBy("root").agg(F.min("class_id").alias("group_id"))
    own = stage(own.join(named.hint("merge"), "root").select("cid", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id"), "groups")
    return member.join(own.hint("merge"), "cid").select("tab", "id", "class_id", "links", "group_id")
