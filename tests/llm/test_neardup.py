import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import neardup


def brute(texts, threshold=0.6, least=16):
    import re

    sets = {(t, i): frozenset(re.findall(r"[^\W_]{2,}", (x or "").lower())) for t, i, x in texts}
    keys = sorted(k for k, s in sets.items() if len(s) >= least)
    return {(a[0], a[1], b[1]) for n, a in enumerate(keys) for b in keys[n + 1 :] if a[0] == b[0] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(600)]
    out = []
    for n in range(60):
        base = rnd.sample(vocabulary, 30)
        for k in range(4):
            words = base[:]
            for _ in range(k * 2):
                words[rnd.randrange(30)] = rnd.choice(vocabulary)
            rnd.shuffle(words)
            out.append((rnd.choice(["news", "docs"]), f"{n}-{k}", " ".join(words).title() + "!"))
    hot = " ".join(vocabulary[:20])
    out += [("news", f"hot{i}", hot) for i in range(80)]  # a group of copies with a quarter of all rows
    out += [("news", "null", None), ("news", "empty", ""), ("news", "short", "only a few words"), ("docs", "long", " ".join(f"x{i}" for i in range(50_000)))]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "tab string, id string, text string").withColumn("words", F.lit(1)).withColumn("cid", F.lit("clash"))


def test_pairs_against_brute_force(spark, texts):
    got = {tuple(r) for r in neardup.similar_pairs(frame(spark, texts + texts[:50])).collect()}
    want = brute(texts)
    assert got <= want and len(got) >= 0.995 * len(want)
    assert {p for p in want if p[1].startswith("hot")} <= got
    assert neardup.similar_pairs(frame(spark, texts).limit(0)).count() == 0


def test_texts_without_a_table_and_ties(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(None, "a", text), (None, "b", text + " x1 x2"), ("t", "a", text), ("t", "a", text), ("t", "a", text + " more"), ("t", None, text), (None, "c", text[::-1])]
    assert {tuple(r) for r in neardup.similar_pairs(frame(spark, rows)).collect()} == {(None, "a", "b")}
    got = sorted((str(r.tab), r.id, r.class_id, r.links, r.group_id) for r in neardup.groups(frame(spark, rows)).collect())
    assert got == [("None", "a", "a", 1, "a"), ("None", "b", "b", 1, "a"), ("None", "c", "c", 0, "c"), ("t", "a", "a", 1, "a"), ("t", "a", "a", 1, "a")]


def test_groups_hold_every_link(spark, texts):
    rows = {(r.tab, r.id): r for r in neardup.groups(frame(spark, texts)).collect()}
    pairs = {tuple(r) for r in neardup.similar_pairs(frame(spark, texts)).collect()}
    assert ("news", "short") not in rows and ("docs", "long") in rows
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t, a, b in pairs:
        parent[root((t, a))] = root((t, b))
    by_root, by_group = {}, {}
    for k in rows:
        by_root.setdefault(root(k), set()).add(k)
        by_group.setdefault(rows[k].group_id, set()).add(k)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))
    assert len({rows["news", f"hot{i}"].class_id for i in range(80)}) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(5, i) for i in range(6, 40)] + [(7, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(101, 165)} | {i: 5 for i in range(6, 40)}
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_minhashes_estimate_similarity():
    rng = np.random.default_rng(0)
    a, b = neardup._family(4096)
    x = rng.integers(0, 2**63, 40, dtype=np.uint64)
    y = np.concatenate([x[:30], rng.integers(0, 2**63, 10, dtype=np.uint64)])
    m = neardup.minhashes(np.concatenate([x, y]), np.array([0, 40]), a, b)
    assert abs((m[0] == m[1]).mean() - 0.6) < 0.03
    bits = m & 1
    assert abs((bits[0] == bits[1]).mean() - 0.8) < 0.03
    # Large inputs are hashed in chunks with the same result.
    many = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    starts = np.sort(np.concatenate([[0], rng.choice(np.arange(1, 50_000), 900, replace=False)]))
    parts = np.split(many, starts[1:])
    a, b = a[:8], b[:8]
    whole = neardup.minhashes(many, starts, a, b)
    assert all((whole[i] == neardup.minhashes(p, np.array([0]), a, b)[0]).all() for i, p in enumerate(parts))


def test_pruning_bounds():
    for n in (64, 128, 192, 256):
        m = neardup.least_matches(n)
        missed = np.random.default_rng(1).binomial(n, 0.8, 1_000_000)
        assert (missed < m).mean() < 1e-3 and n / 2 < m < 0.8 * n
