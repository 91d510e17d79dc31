import random
from collections import Counter

import numpy as np
import pytest

from foliospark.llm import sampling

TARGETS = "category string, target_permille int, min_rows int, sample_rows int"


@pytest.fixture(params=[40, 8192])
def bucket(request, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", request.param)
    monkeypatch.setattr(sampling, "FAN_IN", 4)


def test_balance_minimum_and_report(spark, bucket):
    rnd = random.Random(1)
    rows = [(f"n{i}", rnd.choice([" Big", "big ", "BIG", "Mid  dle", " middle", "other", None, " "]) if i > 6 else "tiny", 1) for i in range(700)]
    df = spark.createDataFrame(rows + rows[:200] + [(None, "big", 1)], "id string, category string, psi int")
    targets = spark.createDataFrame([("BIG", 500, 10, 101), ("Middle", 300, 5, 101), ("TINY", 10, 20, 101), ("GONE", 190, 0, 101), (None, 5, 5, 101)], TARGETS)
    sample, report = sampling.cube_sample(df, targets)
    got = {r.category: (r.needed, r.available, r.sampled, r.shortfall, r.residual) for r in report.collect()}
    have = Counter(" ".join(c.split()).upper() for i, c, _ in rows if c and c.strip())
    middle = have["MIDDLE"]
    assert middle > 31
    assert got == {"BIG": (51, have["BIG"], 51, 0, 0), "Middle": (31, middle, 31, 0, 0), "TINY": (20, 7, 7, 13, -13), "GONE": (20, 0, 0, 20, -20)}
    picked = [(r.id, r.category) for r in sample.collect()]
    assert len(picked) == len(set(picked)) == sum(v[2] for v in got.values())
    spelled = {i: c for i, c, _ in rows}
    assert all(" ".join(spelled[i].split()).upper() == c.upper() for i, c in picked)


def test_same_rows_give_the_same_sample(spark, bucket):
    df = spark.range(500).selectExpr("concat('n', id) as id", "'c' as category")
    targets = spark.createDataFrame([("c", 1000, 0, 37)], TARGETS)
    one = {r.id for r in sampling.cube_sample(df, targets)[0].collect()}
    assert len(one) == 37 and one == {r.id for r in sampling.cube_sample(df.repartition(7), targets)[0].collect()}
    assert one != {r.id for r in sampling.cube_sample(df, targets, seed=1)[0].collect()}


def test_empty_tables(spark):
    targets = spark.createDataFrame([("c", 1000, 3, 10)], TARGETS)
    sample, report = sampling.cube_sample(spark.createDataFrame([], "id string, category string"), targets)
    assert sample.count() == 0 and tuple(report.first()) == ("c", 10, 0, 0, 10, -10)
    df = spark.createDataFrame([("a", "c")], "id string, category string")
    assert sampling.cube_sample(df, targets.limit(0))[1].count() == 0


def test_steps_keep_the_sum_and_the_probabilities():
    rnd = random.Random(3)
    for _ in range(500):
        size = rnd.randint(2, 50)
        a, b = rnd.randint(1, size - 1), rnd.randint(1, size - 1)
        x, y = map(int, sampling.flight_step(a, b, size, rnd.random()))
        assert x + y == a + b and 0 <= min(x, y) and max(x, y) <= size and {x, y} & {0, size}
    mean = sum(sampling.flight_step(30, 20, 100, (i + 0.5) / 10_000)[0] for i in range(10_000)) / 10_000
    assert abs(mean - 30) < 0.1


def test_groups_fly_apart():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 40, 1000))
    size = np.full(1000, 97)
    psi = rng.integers(0, 98, 1000)
    out = sampling.fly(psi, size, group, rng.integers(-(2**63), 2**63, 1000))
    for g in range(40):
        own = group == g
        assert out[own].sum() == psi[own].sum() and ((out[own] > 0) & (out[own] < 97)).sum() <= 1


def test_every_article_is_as_likely(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sampling, "FAN_IN", 2)
    hits = Counter()
    for seed in range(300):
        draw, place = zip(*sorted((((i * 7919 + seed * 104729) % 1009, i) for i in range(20))))
        psi = sampling.fly(np.full(20, 5), np.full(20, 20), np.zeros(20, np.int64), np.array(draw))
        assert psi.sum() == 100 and set(psi.tolist()) == {0, 20}
        hits.update(i for i, p in zip(place, psi) if p == 20)
    assert min(hits[i] for i in range(20)) > 40 and max(hits.values()) < 115  # 75 expected
