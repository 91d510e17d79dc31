import random
import re

from foliospark.llm import leakage


def brute(docs, items):
    def runs(t):
        words = re.findall(r"[^\W_]{2,}", (t or "").lower())
        return {tuple(words[i : i + 12]) for i in range(len(words) - 11)}

    held = [(i, runs(p)) for i, p in items]
    return {(d, i) for d, t in docs for own in [runs(t)] for i, r in held if r & own}


def make(seed, n_docs=400, vocabulary=60):
    rnd = random.Random(seed)
    pool = [f"word{i}" for i in range(vocabulary)]
    text = lambda n: rnd.choices(pool, k=n)
    items = [(i, " ".join(text(rnd.randint(8, 60)))) for i in range(40)] + [(90, None), (91, "")]
    docs = []
    for d in range(n_docs):
        own = text(rnd.choice([5, 12, 14, 16, 17, 18, 40, 200]))
        if rnd.random() < 0.6:
            passage = rnd.choice(items[:40])[1].split()
            n = rnd.randint(10, 14)
            cut = passage[(s := rnd.randint(0, max(0, len(passage) - n))) : s + n]
            own[(p := rnd.randint(0, len(own))) : p] = cut
        docs.append((d, rnd.choice([" ", "\n", " - ", ". "]).join(own).upper() if rnd.random() < 0.3 else " ".join(own)))
    return docs + [(5000, None), (5001, ""), (5002, " ".join(text(30_000)) + " " + items[0][1] + " " + items[1][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


def test_leaks_against_brute_force(spark):
    for seed in range(3):
        docs, items = make(seed)
        a, b = frames(spark, docs + docs[:30], items + items[:5])
        assert {tuple(r) for r in leakage.leaks(a, b).collect()} == brute(docs, items)


def test_passages_beyond_the_bound_and_long_ones(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PASS_WORDS", 300)
    monkeypatch.setattr(leakage, "PIECE", 20)
    docs, items = make(9, 150)
    a, b = frames(spark, docs + docs[:9], items + items[:3])
    assert {tuple(r) for r in leakage.leaks(a, b).collect()} == brute(docs, items)


def test_no_passages_or_documents(spark):
    docs, items = make(1, 10)
    a, b = frames(spark, docs, items)
    assert leakage.leaks(a, b.limit(0)).count() == 0 and leakage.leaks(a.limit(0), b).count() == 0


def test_functions_reach_the_miss_probability():
    for block in range(leakage.WINDOW, leakage.BLOCK + 1):
        assert (1 - 5 / (block - 7)) ** leakage.functions_for(block) <= leakage.MISS * 1.0000001
