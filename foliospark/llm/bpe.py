"""Encoding texts with a public byte-level BPE vocabulary (problem 8), in numpy.

A text is cut into pieces by the vocabulary's pattern. The distinct pieces of a batch that are not known yet are laid,
by length, into padded matrices with one piece a row; each round every row merges its leftmost pair of least rank, found
through a hash table of pairs, and is compacted. Rows without a pair left to merge leave the matrix.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; the operators take another folder as a parameter.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which the vocabulary's authors cut texts into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes in one matrix; longer pieces than LONG are merged one by one; pieces kept known by a worker.
CELLS = 1 << 20
LONG = 512
KNOWN = 200_000
#: Rows and characters encoded at a time.
PART_ROWS, PART_CHARS = 2_000, 4_000_000

_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of byte sequences, and for pairs of ids a hash table to the id of their union."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # Any two entries that make up a third are a pair to merge at the third's rank.
        pairs = {(ranks[whole[:i]], ranks[whole[i:]]): rank for whole, rank in ranks.items() for i in range(1, len(whole)) if whole[:i] in ranks and whole[i:] in ranks}
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32)
        size = 1 << int(4 * len(keys) - 1).bit_length()
        self.shift, self.mask = np.uint64(64 - size.bit_length() + 1), np.uint64(size - 1)
        self.keys, self.values = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(size, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):  # linear probing, all keys at once: of those that want one free slot the last written gets it
            self.probes += 1
            free = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[slot[left[free]]] = keys[left[free]]
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which pairs merge, or the largest int32."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], np.int32(_NONE))
        (miss,) = np.nonzero((at != keys) & (at != np.uint64(0xFFFFFFFFFFFFFFFF)))
        for _ in range(self.probes - 1):
            if not len(miss):
                break
            slot[miss] = (slot[miss] + np.uint64(1)) & self.mask
            at = self.keys[slot[miss]]
            hit = at == keys[miss]
            out[miss[hit]] = self.values[slot[miss[hit]]]
            miss = miss[~hit & (at != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out

    def merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """The ids of each row: bytes' ids padded on the right, ``lengths`` of them in use."""
        done: list[np.ndarray] = [None] * len(rows)  # type: ignore[list-item]
        index = np.arange(len(rows))
        rows, lengths = rows.copy(), lengths.copy()
        column = np.arange(rows.shape[1])
        ranks = np.full((len(rows), max(rows.shape[1] - 1, 1)), _NONE, np.int32)
        if rows.shape[1] > 1:
            live = column[None, :-1] < lengths[:, None] - 1
            ranks[live] = self.rank(rows[:, :-1][live], rows[:, 1:][live])
        while len(index):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[np.arange(len(rows)), at]
            ended = least == _NONE
            if ended.any():
                for i in np.nonzero(ended)[0]:
                    done[index[i]] = rows[i, : lengths[i]].copy()
                go = ~ended
                index, rows, lengths, ranks, at, least = index[go], rows[go], lengths[go], ranks[go], at[go], least[go]
                if not len(index):
                    break
                width = int(lengths.max())
                rows, ranks = rows[:, :width], ranks[:, : max(width - 1, 1)]
            r = np.arange(len(rows))
            # Compaction: what lies right of the merged pair moves one place to the left.
            keep = np.arange(rows.shape[1] - 1)
            source = keep + (keep[None, :] > at[:, None])
            rows = np.take_along_axis(rows, source, axis=1)
            rows[r, at] = least
            lengths = lengths - 1
            if rows.shape[1] == 1:
                ranks = np.full((len(rows), 1), _NONE, np.int32)
                continue
            keep = keep[:-1]
            ranks = np.take_along_axis(ranks, keep + (keep[None, :] > at[:, None]), axis=1)
            for side in (at - 1, at):  # only the pairs beside the merged place are new
                ok = (side >= 0) & (side < ranks.shape[1])
                inside = ok & (side < lengths - 1)
                ranks[r[ok & ~inside], side[ok & ~inside]] = _NONE
                ranks[r[inside], side[inside]] = self.rank(rows[r[inside], side[inside]], rows[r[inside], side[inside] + 1])
        return done

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, with a heap of pairs over a linked list: no quadratic work."""
        import heapq

        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := self.pairs.get((rank, ids[after[i]]))) is not None:
                    heapq.heappush(heap, (k, i, rank, ids[after[i]]))
            if (h := before[i]) >= 0 and (k := self.pairs.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (k, h, ids[h], rank))
        return np.array([x for x, dead in zip(ids, gone) if not dead], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; a piece that is an entry itself has that id alone."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        todo = []
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = np.array([rank], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        lo = 0
        while lo < len(todo):
            # One bucket: lengths within a quarter of each other, in a matrix of bounded size.
            shortest = len(pieces[todo[lo]])
            hi = lo
            while hi < len(todo) and len(pieces[todo[hi]]) <= shortest + shortest // 4 and (hi + 1 - lo) * len(pieces[todo[hi]]) <= CELLS:
                hi += 1
            rows = todo[lo:hi]
            lengths = np.array([len(pieces[i]) for i in rows])
            cells = np.zeros((len(rows), lengths.max()), np.uint8)
            cells[np.arange(cells.shape[1])[None, :] < lengths[:, None]] = np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)
            for i, ids in zip(rows, self.merge_rows(self.bytes[cells], lengths)):
                out[i] = ids
            lo = hi
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_EMPTY = np.empty(0, np.int32)
_known: dict[str, dict[str, np.ndarray]] = {}


def encode_texts(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of the texts; null and empty texts have no ids."""
    vocab, known = vocabulary(path), _known.setdefault(path, {})
    cut = regex.compile(PATTERN).findall
    pieces = [cut(t) if t else [] for t in texts]
    fresh = list({p for row in pieces for p in row if p not in known})
    if len(known) + len(fresh) > KNOWN:
        known.clear()
        fresh = list({p for row in pieces for p in row})
    known.update(zip(fresh, vocab.encode_pieces([p.encode("utf-8", "replace") for p in fresh])))
    flat = [known[p] for row in pieces for p in row]
    sizes = np.array([sum(map(len, map(known.__getitem__, row))) for row in pieces], np.int64)
    return (np.concatenate(flat) if flat else _EMPTY), np.concatenate([[0], np.cumsum(sizes)])


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``key, ids array<int>``: the ids of every text by a vocabulary, without special tokens.

    Null and empty texts get an empty list; strings that look like special tokens are ordinary text. Other columns are
    ignored, repeated rows repeat. Rows are handled where they are: nothing is shuffled.
    """
    path = os.path.join(folder, f"{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = np.cumsum(pa.compute.fill_null(pa.compute.utf8_length(batch.column(1)), 0).to_numpy()) // PART_CHARS
            cuts = np.unique([*range(0, batch.num_rows, PART_ROWS), *np.nonzero(np.diff(filled))[0] + 1, batch.num_rows])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                flat, offsets = encode_texts(part.column(1).to_pylist(), path)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.make_valid_utf8(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
