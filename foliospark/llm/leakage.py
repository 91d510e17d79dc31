"""Evaluation passages in training texts (problem 9): size-partitioned MinHash containment search, exactly verified.

What is sought is a window of 12 consecutive words of a passage that lies within a document. A window is the set of its
five 8-word shingles; a document is cut into blocks of 17 words, six apart, so that every window of it lies within one
block. If a block contains a window, a MinHash of the two agrees with probability 5 / (shingles of the block): the block's
least shingle must be one of the window's. Documents are partitioned by size, short ones being one smaller block, and
each partition has the number of hash functions that keeps the miss probability, for a single window, at one in a
million; longer leaks have more windows to be found by. Candidates are then verified on their 12-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import words
from foliospark.sources.tables import stage

#: Consecutive words that make a leak.
WINDOW = 12
SHINGLE = 8
BLOCK = 17
MISS = 1e-6
#: Words of passages whose index goes to every task; beyond that it is a table that the documents' keys are joined with.
PASS_WORDS = 1_000_000
#: Words in one piece of a passage.
PIECE = 4_096
#: Bits of the filter that keeps keys in no passage out of that join.
FILTER_BITS = 1 << 26

_rng = np.random.default_rng(9)
_COEFFICIENTS = _rng.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INNER = WINDOW - SHINGLE + 1


def functions_for(block: int) -> int:
    """Hash functions for documents whose blocks have so many words (at least WINDOW, at most BLOCK)."""
    miss = 1 - _INNER / (block - SHINGLE + 1)
    return 1 if miss <= 0 else ceil(log(MISS) / log(miss))


_MOST = functions_for(BLOCK)
_A = _rng.integers(0, 2**63, _MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, _MOST, dtype=np.uint64)
_SALT = _rng.integers(0, 2**63, _MOST, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of so many words in a row of word hashes (runs over document borders are not to be used)."""
    n = max(len(hashes) - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out += hashes[j : j + n] * _COEFFICIENTS[j]
    return _mix(out)


def _permuted(values: np.ndarray, i: int) -> np.ndarray:
    return (values ^ _B[i]) * _A[i]


def _bucket(values: np.ndarray, i: int) -> np.ndarray:
    """MinHashes of function i as keys that no other function shares."""
    return _mix(values + _SALT[i])


@dataclass
class Index:
    """Buckets of window MinHashes, and all windows themselves, of the passages of one pass."""

    words: np.ndarray  # word hashes of all pieces, end to end
    items: np.ndarray  # item ids by number
    keys: np.ndarray  # sorted bucket keys, with the item number of each entry
    owners: np.ndarray
    seen: np.ndarray  # which upper 20 bits occur among the keys
    windows: np.ndarray  # sorted hashes of (window, item), with the item and the place in words
    places: np.ndarray


def _tied(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
    return _mix(hashes + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def window_keys(short: np.ndarray) -> np.ndarray:
    """The keys of all windows' MinHashes, from a passage's inner shingles."""
    return np.concatenate([_bucket(np.unique(np.lib.stride_tricks.sliding_window_view(_permuted(short, i), _INNER).min(axis=1)), i) for i in range(_MOST)])


def build(pieces: list[tuple[int, list[int]]]) -> Index:
    """The index of passage pieces (item id, word hashes). Pieces shorter than a window are in no window."""
    pieces = [(i, w) for i, w in pieces if len(w) >= WINDOW]
    items = np.array(sorted({i for i, _ in pieces}), np.int64)
    flat = np.array([h for _, w in pieces for h in w], np.int64).view(np.uint64)
    entries, windows, at = [], [], 0
    for item, piece in pieces:
        number = np.searchsorted(items, item)
        own = flat[at : at + len(piece)]
        short = shingles(own, SHINGLE)
        n = len(own) - WINDOW + 1
        keys = window_keys(short)
        entries.append(np.stack([keys, np.full(len(keys), number, np.uint64)]))
        number = np.full(n, number, np.int64)
        windows.append((_tied(shingles(own, WINDOW), number), np.arange(at, at + n)))
        at += len(piece)
    if not entries:
        none = np.empty(0, np.uint64)
        return Index(none, items, none, np.empty(0, np.int64), np.zeros(1 << 20, bool), none, np.empty(0, np.int64))
    both = np.unique(np.concatenate(entries, axis=1), axis=1)
    tied, places = (np.concatenate(c) for c in zip(*windows))
    order = np.argsort(tied, kind="stable")
    seen = np.zeros(1 << 20, bool)
    seen[both[0] >> np.uint64(44)] = True
    return Index(flat, items, both[0], both[1].astype(np.int64), seen, tied[order], places[order])


def block_keys(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document number, key) of the MinHashes of all blocks, for one function and size class at a time."""
    short = shingles(flat, SHINGLE)
    for block in range(WINDOW, BLOCK + 1):
        (of,) = np.nonzero(sizes == block if block < BLOCK else sizes >= block)
        if not len(of):
            continue
        step = block - WINDOW + 1
        counts = (sizes[of] - block + step - 1) // step + 1
        owner = np.repeat(of, counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        first = starts[owner] + np.minimum(nth * step, sizes[owner] - block)
        inside = first[:, None] + np.arange(block - SHINGLE + 1)
        for i in range(functions_for(block)):
            yield owner, _bucket(_permuted(short, i)[inside].min(axis=1), i)


def candidates(index: Index, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, item number): pairs of which a block and a window share a bucket."""
    docs, items = [], []
    for owner, key in block_keys(flat, starts, sizes):
        (maybe,) = np.nonzero(index.seen[key >> np.uint64(44)])
        lo, hi = np.searchsorted(index.keys, key[maybe], "left"), np.searchsorted(index.keys, key[maybe], "right")
        n = hi - lo
        docs.append(np.repeat(owner[maybe], n))
        items.append(index.owners[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.concatenate(docs) * max(len(index.items), 1) + np.concatenate(items))
    return pairs // max(len(index.items), 1), pairs % max(len(index.items), 1)


def verified(index: Index, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Which candidates share a window, word by word."""
    long = shingles(flat, WINDOW)
    ok = np.zeros(len(docs), bool)
    cells = 2_000_000
    counts = sizes[docs] - WINDOW + 1
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(docs):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + cells, "right")))
        n = counts[lo:hi]
        pair = np.repeat(np.arange(lo, hi), n)
        place = starts[docs[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        tied = _tied(long[place], items[pair])
        at = np.minimum(np.searchsorted(index.windows, tied), max(len(index.windows) - 1, 0))
        (hit,) = np.nonzero(index.windows[at] == tied)
        span = np.arange(WINDOW)
        same = (index.words[index.places[at[hit]][:, None] + span] == flat[place[hit][:, None] + span]).all(axis=1)
        ok[pair[hit[same]]] = True
        lo = hi
    return ok


def _pieces(items: DataFrame) -> DataFrame:
    """``item_id, s, w``: the passages' word hashes in overlapping pieces of bounded length."""
    hashed = F.transform(words(F.col("passage")), lambda w: F.xxhash64(w))
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long"), hashed.alias("w")).where(F.size("w") >= WINDOW).distinct()
    starts = F.sequence(F.lit(1), F.size("w") - WINDOW + 1, F.lit(PIECE - WINDOW + 1))
    return rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", "s", F.slice("w", F.col("s"), F.lit(PIECE)).alias("w"))


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Bounded parts of the batches, with the lists of a column laid end to end, their starts and sizes."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1_000):
            batch = whole.slice(at, 1_000)
            lists = batch.column(column)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            yield batch, lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets[:-1] - offsets[0], np.diff(offsets)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``doc_id, item_id`` of documents with at least 12 consecutive words of the item's passage.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, passage``. Texts and passages that are null or shorter take
    no part. The passages, as a stated query set, go to the tasks as an index if they are within a bounded number of
    words (long ones in overlapping pieces); larger sets are a table of their own, see :func:`_joined`. The documents
    are read once for candidates, and only what is found is shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= WINDOW)
    pieces = stage(_pieces(items), "pieces")
    if pieces.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0] > PASS_WORDS:
        return _joined(rows, pieces)
    shared = spark.sparkContext.broadcast(build([(r.item_id, r.w) for r in pieces.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch, flat, starts, sizes in _parts(batches, "w"):
            d, i = candidates(index, flat, starts, sizes)
            ok = verified(index, flat, starts, sizes, d, i)
            if ok.any():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d[ok])), pa.array(index.items[i[ok]])], ["doc_id", "item_id"])

    return rows.mapInArrow(run, f"doc_id {kind}, item_id long").distinct()


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, flat, starts, sizes in _parts(batches, "w"):
        keys = [window_keys(shingles(flat[a : a + n], SHINGLE)) for a, n in zip(starts, sizes)]
        place = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column("item_id").take(pa.array(place)), batch.column("s").take(pa.array(place))], ["key", "item_id", "s"])


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose words ``w`` and ``p`` share a window, word by word."""
    for batch in batches:
        keep = []
        for own, other in zip(batch.column("w"), batch.column("p")):
            a, b = (x.values.to_numpy().view(np.uint64) for x in (own, other))
            one, two = shingles(a, WINDOW), shingles(b, WINDOW)
            order = np.argsort(two, kind="stable")
            at = np.minimum(np.searchsorted(two, one, sorter=order), len(two) - 1)
            (hit,) = np.nonzero(two[order[at]] == one)
            span = np.arange(WINDOW)
            keep.append(bool((a[hit[:, None] + span] == b[order[at[hit]][:, None] + span]).all(axis=1).any()))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["doc_id", "item_id"])


def _joined(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """:func:`leaks` for passages of any number: both sides' keys meet in a join, built and filtered on the executors.

    A filter of fixed size, its words set by an aggregation over the passages' keys, keeps most keys of documents out of
    the join. Candidates fetch their words for the verification.
    """
    spark = rows.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    entries = stage(pieces.mapInArrow(_item_keys, "key long, item_id long, s int").distinct(), "entries")
    bit = F.shiftrightunsigned("key", 64 - FILTER_BITS.bit_length() + 1)
    set_ = entries.select(F.floor(bit / 64).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    cells = np.zeros(FILTER_BITS // 64, np.uint64)
    known = set_.toArrow()
    cells[known.column("at").to_numpy()] = known.column("b").to_numpy().view(np.uint64)
    shared, shift = spark.sparkContext.broadcast(cells), np.uint64(64 - FILTER_BITS.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, flat, starts, sizes in _parts(batches, "w"):
            for owner, key in block_keys(flat, starts, sizes):
                place = key >> shift
                (maybe,) = np.nonzero((shared.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1))
                if len(maybe):
                    yield pa.RecordBatch.from_arrays([pa.array(key[maybe].view(np.int64)), batch.column("doc_id").take(pa.array(owner[maybe]))], ["key", "doc_id"])

    keys = rows.mapInArrow(run, f"key long, doc_id {kind}")
    pairs = keys.join(entries.hint("merge"), "key").select("doc_id", "item_id", "s").distinct()
    both = pairs.join(pieces.withColumnRenamed("w", "p").hint("merge"), ["item_id", "s"]).join(rows.hint("merge"), "doc_id")
    return both.select("doc_id", "item_id", "w", "p").mapInArrow(_sharing, f"doc_id {kind}, item_id long").distinct()
