import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusq.llm import quality

GOOD = "the cat sat on a mat and looked at birds that flew over the quiet garden wall "


def rows():
    r = np.random.default_rng(1)
    words = GOOD.split()
    out = []
    for i in range(240):
        w = [words[k] for k in r.integers(0, len(words), int(r.integers(5, 300)))]
        bad = i % 3 == 0
        if bad:
            k = max(5, len(w) // 2)
            w[:k] = [x.upper() + "!!" for x in w[:k]] if i % 2 else [x + "***" for x in w[:k]]
        out.append((i, " ".join(w), 0 if bad else 1))
    return out


def test_features_do_not_depend_on_neighbours():
    texts = ["a b c", "", "  lead ** !! X|Y 12 é", GOOD * 30, " \n ", "same same same"]
    together = [(x, n) for x, n in quality.bags(pa.array(texts))]
    x, n = np.concatenate([t[0] for t in together]), np.concatenate([t[1] for t in together])
    edge = 0
    for text, k in zip(texts, n):
        (alone, count), = quality.bags(pa.array([text]))
        assert count.tolist() == [k]
        assert np.array_equal(alone, x[edge: edge + k])
        edge += k
    assert n[3] == -(-len(GOOD.split()) * 30 // quality.PASSAGE_WORDS)


def plain_features(text):
    """The features of each passage, written out word by word."""
    kinds = lambda ch: 1 if ch in range(97, 123) else 2 if ch in range(65, 91) else 3 if ch in range(48, 58) else 4 if chr(ch) in "*$#%&@^~<>{}\\" else 5 if chr(ch) == "!" else 6 if chr(ch) == "|" else 8 if ch >= 128 else 7
    words, word = [], []
    for ch in [*text.encode(), 32]:
        if ch <= 32:
            if word:
                words.append(bytes(word))
            word = []
        else:
            word.append(ch)
    out = []
    for at in range(0, len(words), quality.PASSAGE_WORDS):
        part = words[at: at + quality.PASSAGE_WORDS]
        chars = [kinds(ch) for w in part for ch in w]
        again = [i > 0 and words[i] == words[i - 1] for i in range(at, at + len(part))]
        mean = lambda x: sum(x) / len(part)
        out.append([chars.count(k) / len(chars) for k in range(1, 9)] + [mean([len(w) / 10 for w in part]), mean(again), mean([len(w) == 1 for w in part]), mean([kinds(w[-1]) == 4 for w in part]), math.log1p(len(part)) / 5])
    return out or [[0.0] * quality.N_FEATURES]


def plain_score(p, text):
    """Attention over the passages, written out."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    codes, weights = [], []
    for x in plain_features(text):
        x = [(a - m) / s for a, m, s in zip(x, p["mean"], p["scale"])]
        h = [math.tanh(sum(a * w for a, w in zip(x, col)) + b) for col, b in zip(p["W"].T, p["b"])]
        gate = [math.tanh(sum(a * w for a, w in zip(h, v))) * sig(sum(a * w for a, w in zip(h, u))) for v, u in zip(p["V"].T, p["U"].T)]
        codes.append(h)
        weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
    z = [sum(w * h[j] for w, h in zip(weights, codes)) / sum(weights) for j in range(quality.HIDDEN)]
    return sig(sum(a * c for a, c in zip(z, p["c"])) + p["d"][0])


def test_scores_against_brute_force(spark):
    data = rows()
    texts = [t for _, t, _ in data[:40]] + ["", None, "a b c", "  lead ** !! X|Y 12 é ü", "same same same", GOOD * 300]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted int").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data[:40]], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, labels)
    assert got.columns == ["doc_id", "text", "score", "predicted", "held_out", "score_", "predicted_"]
    for r in got.collect():
        assert r.score_ == pytest.approx(plain_score(model.p, r.text or ""), abs=1e-9) and (r.score, r.predicted) == (1.0, 2)


def test_long_texts_are_trained_on_whole(spark):
    # what is bad stands in one passage of 400, anywhere
    r = np.random.default_rng(3)
    texts = []
    for i in range(60):
        w = (GOOD * 1600).split()[: 64 * 400]
        if i % 2:
            at = int(r.integers(0, 399)) * 64
            w[at: at + 64] = ["XX!!"] * 64
        texts.append((i, " ".join(w), 1 - i % 2))
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert sum(x.predicted == 1 - x.doc_id % 2 for x in got if x.held_out) >= 0.9 * sum(x.held_out for x in got)


def test_gradient():
    r = np.random.default_rng(0)
    counts = np.array([1, 3, 2, 4])
    x, y = r.normal(size=(10, quality.N_FEATURES)), np.array([0.0, 1, 1, 0])
    model = quality.AttentionMIL().fit(x, counts, y, steps=3)
    loss = lambda: float(np.mean([-np.log(s if t else 1 - s) for s, t in zip(model.score(x, counts), y)]))
    for k, grad in model.gradients(x, counts, y).items():
        for at in list(np.ndindex(grad.shape))[:6]:
            kept = model.p[k][at]
            sides = []
            for d in (1e-5, -1e-5):
                model.p[k][at] = kept + d
                sides.append(loss())
            model.p[k][at] = kept
            assert grad[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7), (k, at)
    fitted = quality.AttentionMIL().fit(x, counts, y, steps=400)
    assert ((fitted.score(x, counts) > 0.5) == (y > 0.5)).all()


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t, _ in data] + [(900, None, 1.0), (901, "", 1.0), (None, GOOD, 1.0), (0, GOOD, 1.0)], "doc_id long, text string, y double").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(data) + 4
    truth = {i: q for i, _, q in data}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (1 if r.score >= 0.3 else 0)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in got if r.held_out and r.doc_id in truth and r.text != GOOD]
    assert len(unseen) > 20 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.scored(docs, none).first().score == pytest.approx(0.5)
    assert quality.scored(docs.limit(0), none).count() == 0
