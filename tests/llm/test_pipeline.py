import random
import zlib

import numpy as np

import corpus_pipeline
from corpusq.llm import mix, quality, tokens
from tests.llm.test_neardup import brute


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(9)
    vocab = ["w" + "".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    item = [r.choice(vocab) for _ in range(20)]
    rows, labels = [], []
    for i in range(160):
        w = [r.choice(vocab) for _ in range(r.randint(30, 120))]
        if i % 4 == 3:
            w = [x.upper() + "!!" for x in w]
        if i % 10 == 1:
            w[5:5] = item
        if i % 10 == 2 and rows:
            w = list(rows[-2][1].split())
            w[3] = "changed"
        rows.append((i, " ".join(w), "en", f"src{min(i % 7, 2)}", 0))
        labels.append((i, 0 if i % 4 == 3 else 1, 0))
    rows += [(900, None, "en", None, 0), (901, "", None, "src0", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    accepted, unique, clean, mixed, files = kept
    assert {x.doc_id for x in accepted if x.doc_id < 900} == {i for i in range(160) if i % 4 != 3}
    assert sorted(x.doc_id for x in unique) == sorted({c for _, c in brute([(x.doc_id, x.text) for x in accepted if x.text])} | {x.doc_id for x in accepted if not x.text})
    assert {x.doc_id for x in unique} - {x.doc_id for x in clean} == {x.doc_id for x in unique if x.text and " ".join(item) in x.text}
    size = {}
    for x in clean:
        size[x.source] = size.get(x.source, 0) + len((x.text or "").split())
    got = {}
    for x in mixed:
        got[x.source] = got.get(x.source, 0) + len((x.text or "").split())
    assert set(size) <= {"src0", "src1", "src2", None}
    total, targets = sum(size.values()), dict(zip([*sorted(s for s in size if s), None], (5, 2, 1, 5)))
    level, capped = total, set()
    want = {}
    while True:
        open_ = {s: w for s, w in targets.items() if s not in capped}
        level = (total - sum(3 * size.get(s, 0) for s in capped)) / (sum(open_.values()))
        over = {s for s, w in open_.items() if level * w > 3 * size.get(s, 0)}
        if not over:
            break
        capped |= over
    for s, w in targets.items():
        want[s] = 3 * size.get(s, 0) if s in capped else level * w
        assert abs(got.get(s, 0) - want[s]) <= 240, (s, got, want)
    enc = tokens.Encoder(tokens.tokenizer_path())
    expect, at = [], 0
    for x in sorted(mixed, key=lambda x: (x.doc_id, x.text or "")):
        ids = enc(x.text or "") + [1]
        expect.append((x.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, files), key=lambda x: x[1]) == expect
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(files)
