import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusq.llm import common, dartminhash, neardup
from corpusq.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(sets))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (102, 101), (7, 7), (0, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}


def test_classes_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([3, 8, 60, 120]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 2, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            texts.append(" ".join(copy))
    texts += ["", "  \n", None, "one two", "One  two", "x " * 500, "x " * 490, "long " + " ".join(vocab * 30)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node int").repartition(6)
    assert sorted(map(tuple, neardup.classes(docs).collect())) == brute(rows)
    kept = neardup.unique_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in brute(rows)})
    assert neardup.classes(docs.limit(0)).collect() == []


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(5)
    elements = r.integers(0, 2**63, 60).astype(np.uint64)
    a, b = r.uniform(0.1, 6, 60), r.uniform(0.1, 6, 60)
    b[:40] = a[:40]
    heavy = np.array([40_000.0, 3.0])
    for x, y in ((a, b), (a, a * 1.25), (np.ones(60), np.full(60, 3.0)), (a, a)):
        k = 3000
        s, t = (dartminhash.signatures(elements, w, np.array([60]), k)[0] for w in (x, y))
        want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
        assert abs((s == t).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5 + 1e-12
    together = dartminhash.signatures(np.concatenate([elements, elements[:2]]), np.concatenate([a, heavy]), np.array([60, 2]), 64)
    assert (together[0] == dartminhash.signatures(elements, a, np.array([60]), 64)[0]).all()
    assert (together[1] == dartminhash.signatures(elements[:2], heavy, np.array([2]), 64)[0]).all()


def test_what_is_apart_is_compared(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 30)
    monkeypatch.setattr(neardup, "TOGETHER", 13)
    r = random.Random(6)
    base, nodes = [r.randrange(1 << 40) for _ in range(40)], []
    for i in range(60):
        cell = set(base)
        for _ in range(r.choice([0, 2, 5, 9])):
            cell.discard(r.choice(base))
            cell.add(r.randrange(1 << 40))
        nodes.append((7, i, i % 3, sorted(cell)))
    sigs = dartminhash.signatures(np.concatenate([np.array(x, np.uint64) for *_, x in nodes]), np.ones(sum(len(x) for *_, x in nodes)), np.array([len(x) for *_, x in nodes]), neardup.BANDS * neardup.ROWS)
    sketches = (sigs & np.uint64(255)).astype(np.uint8).view(np.int8).tolist()
    rows = [(b, i, root, len(x), len(x), x, s) for (b, i, root, x), s in zip(nodes, sketches)]
    live = spark.createDataFrame(rows, "band long, node long, root long, size int, common int, cells array<long>, sketch array<tinyint>")
    pairs = neardup._apart(live, spark.createDataFrame([(7, 0)], "band long, major long"), 0.8, common.hot_keys(spark.createDataFrame([(7, 60)], "band long, n long"), ["band"]))
    got = {tuple(x) for x in neardup._verified(pairs, live.select("node", "cells"), 0.8).collect()}
    sets = {i: (root, set(x)) for _, i, root, x in nodes}
    assert got == {(i, j) for i, (p, a) in sets.items() for j, (q, b) in sets.items() if i > j and p != q and len(a & b) >= 0.8 * len(a | b)} and len(got) > 30


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 20)
    monkeypatch.setattr(common, "PART", 7)
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long").repartition(4)
    facts = rows.groupBy("k").agg(F.max("v").alias("m"))
    got = common.spread_join(rows, facts, ["k"], ["v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts, "k").collect()))
    assert common.hot_keys(rows.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()[0]["_parts"] == 29


def test_null_and_repeated_ids(spark):
    t = "a b c d e f g h i j"
    docs = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other words here entirely now"), (None, "z y x w v u")], "doc_id long, text string")
    got = Counter(map(tuple, neardup.classes(docs).collect()))
    assert got == Counter({(None, 5): 1, (5, 5): 3, (None, None): 1})


def test_unique_documents_decides_each_row(spark):
    t, other = "a b c d e f g h i j", "z y x w v u"
    rows = [(None, t), (5, t), (None, other), (7, t), (7, "only seven has these words"), (8, "k l m n o p"), (7, "k l m n o p"), (None, None), (None, "twice without any id"), (None, "twice  without any id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(map(tuple, neardup.unique_documents(docs).collect()))
    gone = {(None, t), (7, t), (8, "k l m n o p")}
    assert got == Counter(x for x in rows if x not in gone)


def template_family(n, template, passage, stock=40, take=3, seed=1):
    """Distinct texts of one template, each with ``take`` of ``stock`` passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(template)]
    passages = [[r.choice(words) for _ in range(passage)] for _ in range(stock)]
    texts = [" ".join(base + sum((passages[j] for j in r.sample(range(stock), take)), [])) for _ in range(n)]
    return list(enumerate(dict.fromkeys(texts)))


def test_template_families_against_brute_force(spark):
    # two of three passages in common are a link in the first family, in the second hardly any
    rows = template_family(250, 160, 20) + [(1000 + i, t) for i, t in template_family(120, 140, 20, seed=2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(map(tuple, neardup.classes(docs).collect())) == brute(rows)
