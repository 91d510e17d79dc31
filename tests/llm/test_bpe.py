import base64
import os
import random

import pytest

from foliospark.llm import bpe

PATH = f"{bpe.FOLDER}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cases():
    rnd = random.Random(2)
    signs = "ab \n\t’s'é漢字0123😀<|endoftext|>the ing"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 80))) for _ in range(2000)] + ["a" * 700 + "bcd" * 900, " " * 3000, "漢字" * 900, "the" * 5000, "<|endoftext|>", "x", ""]


def test_ids_against_a_library(reference):
    texts = cases()
    flat, at = bpe.encode_texts(texts, PATH)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == reference(t), t[:60]


def test_long_pieces_by_both_ways(reference):
    v = bpe.vocabulary(PATH)
    for piece in (b"abc" * 400, "né".encode() * 300, b"\xff" * 600):
        import numpy as np

        row = v.bytes[np.frombuffer(piece, np.uint8)][None, :]
        assert v.merge_rows(row, np.array([len(piece)]))[0].tolist() == v.merge_long(piece).tolist()


def test_table(spark, reference):
    rows = [(1, "Hello world", "x"), (2, "", None), (3, None, "y"), (1, "Hello world", "z")] + [(i, t, "") for i, t in enumerate(cases()[:300], 10)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((i, tuple(reference(t) if t else ())) for i, t, _ in rows)
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_small_cache_gives_the_same(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    texts = cases()[:200]
    for lo in range(0, 200, 20):
        flat, at = bpe.encode_texts(texts[lo : lo + 20], PATH)
        assert [flat[at[i] : at[i + 1]].tolist() for i in range(20)] == [reference(t) for t in texts[lo : lo + 20]]
