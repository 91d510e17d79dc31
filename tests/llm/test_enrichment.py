from fractions import Fraction
from math import comb, inf, lgamma, log

import numpy as np
import pytest

from foliospark.llm import enrichment


def exact(k, n, K, N):
    p = sum(Fraction(comb(K, x) * comb(N - K, n - x), comb(N, n)) for x in range(k, min(n, K) + 1) if n - x <= N - K)
    return -inf if p == 0 else log(p.numerator) - log(p.denominator)


def test_log_gamma():
    x = np.array([0.5, 1, 2, 3.7, 8, 50, 1e4, 1e9])
    assert np.allclose(enrichment.log_gamma(x), [lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_upper_tail_against_exact_sums():
    cases = [(k, n, K, N) for N in (5, 30, 200) for K in (1, 3, N // 2, N) for n in (1, 4, N // 3 + 1, N) for k in range(0, min(n, K) + 2)]
    got = enrichment.log_upper_tail(*map(np.array, zip(*cases)))
    for c, g in zip(cases, got):
        assert g == pytest.approx(exact(*c), rel=1e-7, abs=1e-9), c


DOCS = "id string, content string, tags array<string>, tf int, p_log string"


def frame(spark):
    rows = [("a", "Zebra zebra zebra the the", ["T1", " t1 ", "x"]), ("b", "the the the cat", ["t1", ""]), ("c", "the dog", None), ("d", None, [None, "solo"]), ("e", "", [])]
    return spark.createDataFrame([(*r, 1, "clash") for r in rows * 2], DOCS)


def test_scores_and_adjustment(spark):
    got = {(r.field, r.id, r.term): r for r in enrichment.distinctive(frame(spark)).collect()}
    z = got["content", "a", "zebra"]
    assert (z.tf, z.df, z.cf) == (3, 1, 3) and z.score > got["content", "a", "the"].score
    content = [r for (f, *_), r in got.items() if f == "content"]
    total = sum(r.tf for r in content)
    n = {i: sum(r.tf for r in content if r.id == i) for i in "abc"}
    for r in content:
        assert r.p_log == pytest.approx(exact(r.tf, n[r.id], r.cf, total), abs=1e-9)
    # The plain form of the adjustment.
    logs = sorted(r.p_log for r in content)
    q = {}
    for r in content:
        q[r.id, r.term] = min(min(0.0, p + log(len(logs) / max(i for i, x in enumerate(logs, 1) if x == p))) for p in logs if p >= r.p_log)
    assert {(r.id, r.term): pytest.approx(r.q_log, abs=1e-9) for r in content} == q
    assert ("tags", "a", "t1") in got and got["tags", "b", "t1"].df == 2 and ("tags", "b", "") not in got and ("tags", "d", "solo") in got


def test_rows_of_one_id_are_records_of_their_own(spark):
    rows = [("a", "red red red blue", None), ("a", "red green", ["x"]), ("b", "green", ["X "])]
    got = {(r.field, r.id, r.term, r.tf): (r.df, r.cf) for r in enrichment.distinctive(spark.createDataFrame(rows, "id string, content string, tags array<string>")).collect()}
    assert got["content", "a", "red", 3] == got["content", "a", "red", 1] == (2, 4) and got["tags", "b", "x", 1] == (2, 2) and len(got) == 7


def test_a_very_long_text(spark):
    rows = [("long", " ".join(f"w{i % 50_000}" for i in range(200_000)), None), ("short", "w1 w1", [])]
    got = enrichment.distinctive(spark.createDataFrame(rows, "id string, content string, tags array<string>"))
    assert got.count() == 50_001 and got.where("id = 'short'").first().cf == 6


def test_empty(spark):
    assert enrichment.distinctive(frame(spark).limit(0)).count() == 0
