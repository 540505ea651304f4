"""Line dedup, filter audit and dataset manifest against brute force on small tables."""

import random
from collections import Counter
from hashlib import sha256
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import filter_audit, line_dedup, merkle

SPACES = " \t\n\x0b\x0c\r"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=400), st.integers(0, 2**64 - 1))
def test_perfect_hash_is_minimal(keys, other):
    h1, h2 = (np.array([k[i] for k in sorted(keys)], np.uint64) for i in (0, 1))
    sizes, bits = line_dedup.perfect_hash(h1, h2)
    assert sorted(line_dedup.places(sizes, bits, h1, h2).tolist()) == list(range(len(keys)))
    stranger = line_dedup.places(sizes, bits, np.array([other], np.uint64), np.array([7], np.uint64))[0]
    assert -1 <= stranger < max(1, len(keys))


def lower(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def without_frequent(texts, min_docs, min_chars):
    keys = [[lower(x) for x in (t or "").split("\n")] for t in texts]
    docs = Counter(k for of in keys for k in set(of) if len(k) >= min_chars)
    out = []
    for t, of in zip(texts, keys):
        kept = [x for x, k in zip((t or "").split("\n"), of) if docs[k] < min_docs]
        out.append((None if t is None else "\n".join(kept), len(of), len(of) - len(kept)))
    return out


def lines_table():
    r = random.Random(5)
    odd = ["", " ", "\r", "Éa", "éa", "\xa0x", "x", " X\t", "x\r", " ", "naïve Line", "NAÏVE line", "naïve line\x0b", "\x85", "a\x00b", "日本"]
    rows = [(i, "\n".join(r.choice([*odd, f"own {i}", f"pair {i // 2}", f"twelve {i % 5}"]) for _ in range(r.randrange(12)))) for i in range(60)]
    rows += [(200 + i, "the same text\nin many rows\nx") for i in range(300)] + [(7, "one id\nx"), (7, "one id\nx"), (None, None), (None, "x\n" * 40), (901, ""), (902, "y\n" * 5000 + "z" * 20000)]
    return rows


@pytest.mark.parametrize("min_docs, min_chars, shard_keys, probes", [(10, 1, 1 << 17, 1 << 20), (10, 1, 7, 20), (300, 3, 40, 50), (2, 0, 1, 1 << 20), (1, 1, 1 << 17, 1)])
def test_line_dedup(spark, monkeypatch, min_docs, min_chars, shard_keys, probes):
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    rows = lines_table()
    docs = spark.createDataFrame([(i, t, "own", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_lines string, k int").repartition(3)
    got = line_dedup.dedup_lines(docs, min_docs, min_chars, shard_keys)
    assert got.columns == ["doc_id", "text", "n_lines", "k", "n_lines_", "n_dropped"]
    want = without_frequent([t for _, t in rows], min_docs, min_chars)
    assert {r.k: (r.doc_id, r.text, r.n_lines, r.n_lines_, r.n_dropped) for r in got.collect()} == {k: (rows[k][0], w[0], "own", *w[1:]) for k, w in enumerate(want)}


def test_index_is_sharded_and_small(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('line of ', id, '\nshared ', id % 100) AS text")
    index, shards = line_dedup.build_index(line_dedup.line_counts(docs), shard_keys=500)
    rows = index.collect()
    assert shards == 9 and len(rows) == 9 and sum(r["keys"] for r in rows) == 4100 and sum(r.probes for r in rows) == 8000
    assert sum(len(r.bits) + len(r.fingerprints) + len(r.counts) for r in rows) < 4100 * 5.7
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows])
    assert Counter(counts.tolist()) == {1: 4000, 40: 100}


def fails(text):
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text)}


def test_filter_audit(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]

    def text():
        body = " ".join(r.sample(words, 110) if r.random() < 0.5 else [r.choice(words[:60]) for _ in range(r.choice([20, 120]))])
        return r.choice(["", "É\x85 ", " \n"]) + (body.upper() if r.random() < 0.3 else body) + r.choice(["", " #", "|", " \x0b"])

    texts = [text() for _ in range(40)] + [None, "", " ", "A"]
    docs = [(r.choice([None, *range(90)]), r.choice(texts), r.choice(["en", "de", None, "", "fr"])) for _ in range(300)] + [(1000 + i, texts[0], "en") for i in range(300)] + [(5, texts[1], "de")] * 3
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 1200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = filter_audit.audit(
        spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, lang string, part string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    failed = [fails(t or "") | {"E": i is not None and i > smallest[t or ""]} for i, t, _ in docs]
    parts = sorted({lang or "" for _, _, lang in docs})
    want, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = [k for k, d in enumerate(docs) if (d[2] or "") == part]
            gone = []
            for step, f in enumerate(order, 1):
                out = [k for k in left if failed[k][f]]
                unique = sum(failed[k][f] and sum(failed[k].values()) == 1 for k in left + gone)
                redundant = sum(failed[k][f] for k in gone)
                left, gone = [k for k in left if not failed[k][f]], gone + out
                shapley[part, f] += len(out)
                want[part, order, step] = [len(left), len(out), redundant, unique, sum(docs[k][0] in good for k in out), sum(docs[k][0] in toxic for k in out)]
    rows = got.collect()
    assert {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in rows} == {
        k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}
    assert len(rows) == 600 * len(parts)


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root, and for each leaf its proof, level by level."""
    nodes, proofs = [(h, [i]) for i, h in enumerate(leaves)], [""] * len(leaves)
    while len(nodes) > 1:
        up = []
        for a in range(0, len(nodes), arity):
            run = nodes[a: a + arity]
            for k, (_, under) in enumerate(run):
                for i in under:
                    proofs[i] += "".join(h for j, (h, _) in enumerate(run) if j != k)
            up.append((H(*[h for h, _ in run]), [i for _, under in run for i in under]))
        nodes = up
    return nodes[0][0], proofs


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def manifest_rows(sizes):
    r = random.Random(7)
    rows = [(r.choice([None, *range(4 * n)]), lang, r.choice(["é", "", None, "x" * 30]), r.choice(["s", None, ""]), r.choice([None, 3])) for lang, n in sizes.items() for _ in range(n)]
    return rows + rows[:5] * 3


@pytest.mark.parametrize("arity, chunk, lift, sizes", [
    (2, 2, 1, {"en": 150, None: 9, "": 1, "é": 2, "de": 33}), (3, 1, 2, {"a": 82, "b": 27, "c": 4}), (2, 12, 10, {"en": 300, "de": 7}), (5, 2, 1, {"only": 130}), (2, 1, 3, {f"l{i:02}": 1 + i % 3 for i in range(40)}),
])
def test_manifest(spark, arity, chunk, lift, sizes):
    rows = manifest_rows(sizes)
    docs = spark.createDataFrame([(*x, "own", k) for k, x in enumerate(rows)], "doc_id long, lang string, text string, source string, n_chars long, leaf string, k int").repartition(6)
    from pyspark.sql import functions as F

    got = merkle.manifest(docs, arity, chunk, lift, k=F.col("k"))
    shown = got.withColumn("folded", merkle.folded(arity)("leaf", "place", "leaves", "tree", "trees", "proof")).collect()
    assert sorted(x.k for x in shown) == list(range(len(rows)))
    langs = sorted({x[1] for x in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        leaves = sorted(((x[0] is not None, x[0] or 0, plain_leaf(x[0], x[3], x[1], x[4], x[2])) for x in rows if x[1] == lang))
        trees[lang] = ([x[2] for x in leaves], *plain_tree([x[2] for x in leaves], arity))
    root, above = plain_tree([trees[lang][1] for lang in langs], arity)
    for x in shown:
        leaves, subroot, proofs = trees[x.lang]
        doc = rows[x.k]
        assert x.leaf == plain_leaf(doc[0], doc[3], doc[1], doc[4], doc[2]) == leaves[x.place] and x.leaves == len(leaves)
        assert (x.subroot, x.root, x.tree, x.trees) == (subroot, root, langs.index(x.lang), len(langs))
        assert x.proof == proofs[x.place] + above[x.tree] and x.folded == root
    assert {(x.lang, x.place) for x in shown} == {(lang, i) for lang in langs for i in range(len(trees[lang][0]))}


def test_tampering_shows(spark, tmp_path):
    spark.createDataFrame([(i, "t", "en", "s", None if i % 3 == 0 else i) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from zlib import crc32

    for x in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect():
        tampered = crc32(str(x.doc_id).encode()) % 7 == 0 and x.doc_id % 3 != 0
        assert x.verified == (not tampered) == (x.folded_root == x.root)


def test_sums_of_matrices():
    m = filter_audit.MATRICES
    assert all(x.shape == (32, 600) and x.dtype == np.int64 for x in m.values())
    # a document is kept or removed once in each order
    assert ((m["removed"].reshape(32, 120, 5).sum(axis=2) + m["kept"].reshape(32, 120, 5)[:, :, -1]) == 1).all()
