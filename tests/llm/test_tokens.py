import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusq.llm import pfor, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=400), max_size=8), st.integers(0, 99))
def test_file_round_trip(docs, percentile):
    writer = pfor.Writer(percentile, hold=256)
    for i, ids in enumerate(docs):
        writer.add(np.array([i]), np.array([i % 3 == 0]), np.array([len(ids)]), np.array(ids, np.uint32))
    file = pfor.Reader(b"".join(writer.chunks()))
    flat = [x for ids in docs for x in ids]
    assert file.ids(0, file.n_ids).tolist() == flat
    assert file.lengths.tolist() == [len(x) for x in docs]
    for a in range(0, len(flat), 97):
        assert file.ids(a, min(len(flat), a + 131)).tolist() == flat[a: a + 131]


def test_outliers_become_exceptions():
    ids = np.array([5] * 120 + [60000] * 8, np.uint32)
    got = pfor.encode_blocks(ids)
    assert got.widths.tolist() == [0] and len(got.exc_high) == 8 and len(got.payload) == 0


ODD = ["", " ", "It's l'été's don'T THEY'LL 12½ a_b-c!!??", "ÀÉÎß straße ÿ 'sam ''s", "日本 café\u0301", "x<|endoftext|>y", "a\x1cb", "tab\tnew\nline\r\n", "a" * 3000, "\xa0nb\xa0sp", "ªº¹²³ ×÷", "e \u0301 e\u0301 \u2003x", "ΣΑΣ ΣΑΣ.", "İI ǅ", "<|startoftext|> <|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_agree_with_the_whole_encoding(text):
    enc = tokens.encoder(tokens.tokenizer_path())
    assert enc.by_word
    for t in (text, *ODD):
        assert enc(t) == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_pieces_of_a_batch_are_encoded_once(monkeypatch):
    """Words that differ in case and signs alone share their pieces, and pieces of the last batch are known to the next, however many came before."""
    enc = tokens.Encoder(tokens.tokenizer_path())
    asked, by_model = [], enc.by_model
    monkeypatch.setattr(enc, "by_model", lambda piece: asked.append(piece) or by_model(piece))
    texts = ["Straße, straße! (STRASSE) It's it's", "", "日本 straße", "no <|endoftext|> here", " 12½ it's\n"]
    want = [[*enc.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    for _ in range(3):
        ids, lengths = enc.batch(texts, 1)
        assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))
        assert len(asked) == len(set(asked))
        asked.clear()
    monkeypatch.setattr(tokens, "REMEMBERED", 24)
    enc.clear()
    enc.batch([" ".join(f"old{'x' * i}" for i in range(20)) + " straße it's"], 1)
    enc.batch([" ".join(f"new{'y' * i}" for i in range(4)) + " straße it's"], 1)
    asked.clear()
    enc.batch(["Straße, It's newy"], 1)
    assert asked == [","]


def test_other_tokenizers_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"Hello": 2, "World": 4, "hello": 3, "world": 0, "[U]": 5}, unk_token="[U]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(f"{tmp_path}/own.json")
    enc = tokens.Encoder(f"{tmp_path}/own.json")
    assert not enc.by_word and enc("Hello World") == [2, 4] and enc.batch(["Hello", "", "world x"], 1)[0].tolist() == [2, 1, 1, 0, 5, 1]
    byte = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert not byte.by_word
    for t in ODD:
        assert byte(t) == byte.tokenizer.encode(t, add_special_tokens=False).ids


def test_one_id_is_dealt_to_several_files(spark, tmp_path):
    docs = spark.createDataFrame([(None, f"text number {i} of many " * 3) for i in range(400)] + [(1, "x")], "doc_id long, text string").repartition(5)
    manifest = tokens.write_tokens(docs, f"file://{tmp_path}/files", tokens.tokenizer_path(), file_ids=500)
    assert manifest.count() > 8
    got = sorted(tokens.read_tokens(spark, f"file://{tmp_path}/files", manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 400 + [1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(401)]


def test_token_table_against_brute_force(spark):
    texts = ["b c", None, "", "Long text " * 2000, "b c", "é à", "same"]
    rows = [(i * 3 % 7, t, "extra") for i, t in enumerate(texts)] + [(5, "zz", "extra"), (None, "null id", "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    enc = tokens.Encoder(tokens.tokenizer_path())
    want, at = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokens.token_table(docs).collect()
    got = sorted(map(tuple, got), key=lambda r: r[1])
    # rows of one doc_id are in order of a digest
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))] and [r[0] for r in got] == [w[0] for w in want]
    assert sorted((r[0], *r[2:]) for r in got if r[0] is not None) == sorted((w[0], *w[2:]) for w in want if w[0] is not None)
    assert tokens.token_table(docs.limit(0)).collect() == []
