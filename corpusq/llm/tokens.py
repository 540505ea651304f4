"""Token ids of whole texts, written as files of patched frame-of-reference blocks.

``write_tokens`` deals documents out by ranges of doc_id, so that file after
file holds ascending ids; every task encodes its range and writes one file
(``pfor`` describes it) under a temporary name, then renames it, so that a
task that runs again replaces its file by an equal one.  ``read_tokens``
reads the files back.

Defined cases: a null text is empty and gets the end id alone; a null doc_id
comes first; rows with one doc_id are kept, in order of a digest of their texts, and may be
in several tasks; a task's file is closed at ``FILE_IDS`` ids and a further one begun; a table
without rows writes no file and reads as no rows; other columns are ignored.

Speed: under the settings of the tokenizer used here a text is split at once into words, numbers
and signs, each encoded by itself.  For texts of printable ASCII and Latin-1 that split is
made by one regular expression and each distinct piece is encoded by the tokenizer's model once
and remembered; any other text, any that may hold a special token, and all texts under a
tokenizer of other settings go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import give_back, shared_dir, table, text_batches
from corpusq.llm.pfor import Reader, Writer

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
REMEMBERED = 250_000
FILE_IDS = 1 << 24
DECODE_IDS = 1 << 20
SLICE = 1 << 22


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The settings that splitting texts here is written for.
SETTINGS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None,
}


class Encoder(dict):
    """Texts to ids; remembers the ids of lower-cased pieces of words as little-endian u16."""

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*").fullmatch
    PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        self.by_word = all(settings.get(k) == v for k, v in SETTINGS.items()) and not settings["model"].get("dropout") and self.tokenizer.get_vocab_size() <= 1 << 16
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes as the letters that a byte-level vocabulary has for them: visible ones stand for themselves
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = iter(range(256, 512))
        self.letters = {b: b if b in visible else next(others) for b in range(256)}
        probe = ("word", "'s", "7", "é", "!?", "straße", "½")
        self.direct = self.by_word and all(self.by_model(x) == self.whole(x) for x in probe)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def by_model(self, piece: str) -> bytes:
        """A piece by the tokenizer's model alone, without normalising and splitting it again."""
        ids = [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}H", *ids)

    def __missing__(self, piece: str) -> bytes:
        got = self[piece] = self.by_model(piece) if self.direct else self.whole(piece)
        return got

    def words(self, words: pa.Array) -> pa.Array:
        """The ids of each word as bytes.

        Words are lower-cased and, unless of letters alone, cut into pieces in Arrow, and each distinct piece is looked up once.
        """
        import pyarrow.compute as pc

        low = pc.utf8_lower(words)
        mixed = pc.invert(pc.utf8_is_alpha(low))
        cut = pc.utf8_split_whitespace(pc.replace_with_mask(low, mixed, pc.replace_substring_regex(low.filter(mixed), self.PIECES, r"\1 ")))
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        known = pa.array([self[p] for p in pieces], pa.large_binary())
        self.forget(pieces)
        laid = known.take(coded.indices)
        bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(_offsets(laid)[bounds]), laid.buffers()[2]])

    def batch(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the number of ids of each.

        Words are made distinct in Arrow first, so that each is cut into pieces once a
        batch; ids are then laid out by taking the bytes of word after word.
        """
        import pyarrow.compute as pc

        if not self.by_word:
            got = [np.array([*x.ids, end_id], np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *got]), np.array([len(x) for x in got], np.int64)
        plain = [self.PLAIN(t) is not None and not any(s in t for s in self.specials) for t in texts]
        words = pc.utf8_split_whitespace(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.string()))
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = words.flatten().dictionary_encode()
        of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # a text that goes to the tokenizer whole is one word, the empty one, whose place it takes; then comes the end id of every text
        others = [i for i, p in enumerate(plain) if not p]
        n = len(coded.dictionary)
        of[bounds[others]] = n + 1 + np.arange(len(others))
        known = pa.concat_arrays([self.words(coded.dictionary), pa.array([struct.pack("<H", end_id), *[self.whole(texts[i]) for i in others]], pa.large_binary())])
        laid = known.take(pa.array(np.insert(of, bounds[1:], n)))
        upto = _offsets(laid)[bounds + np.arange(len(bounds))] // 2
        return np.frombuffer(laid.buffers()[2], "<u2", upto[-1]), np.diff(upto)

    def __call__(self, text: str) -> list[int]:
        """Ids of one text, without end id."""
        return self.batch([text], 0)[0][:-1].tolist()

    def forget(self, pieces: list[str]) -> None:
        """With too many remembered, only ``pieces``, those of the last batch, are kept, as far as they are not too many themselves."""
        if len(self) > REMEMBERED:
            last = {p: self[p] for p in pieces[:REMEMBERED // 2]}
            self.clear()
            self.update(last)


def _offsets(x: pa.LargeBinaryArray) -> np.ndarray:
    """Where in its bytes each value begins, and where the last one ends; ``x`` is no slice."""
    return np.frombuffer(x.buffers()[1], np.int64, len(x) + 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder; it serves one task after the other."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in column 1 of each have about ``size`` bytes, one row at least."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(1, batch.column(1).nbytes)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        give_back()


def _write_file(base: str, name: str, writer: Writer) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(base)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        for x in writer.chunks():
            out.write(x)
    store.move(temporary, f"{path}/{name}")


def write_tokens(docs: DataFrame, base: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the token files; return file, n_docs, n_ids, one row a file, in order of file.

    ``base`` is the URI of a folder that all executors share and pyarrow can
    write (a local or mounted folder, HDFS, or an object store).
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenize, writer, nth = encoder(tokenizer), Writer(), 0

        def close() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():06d}-{nth:04d}.pfor"
            n_docs, n_ids = sum(map(len, writer.lengths)), writer.n_ids
            _write_file(base, name, writer)
            return pa.RecordBatch.from_pylist([{"file": name, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in slices(batches, min(SLICE, 4 * file_ids)):
            ids = batch.column(0)
            got, lengths = tokenize.batch([t or "" for t in batch.column(1).to_pylist()], end_id)
            writer.add(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), lengths, got)
            if writer.n_ids >= file_ids:
                yield close()
                writer, nth = Writer(), nth + 1
        if writer.lengths:
            yield close()

    text_batches(docs.sparkSession)
    # rows of one doc_id are dealt out by their texts' digests
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    ordered = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").select("doc_id", "text")
    manifest = ordered.mapInArrow(encode, "file string, n_docs long, n_ids long").collect()  # one short row a file
    return docs.sparkSession.createDataFrame(sorted(map(tuple, manifest)), "file string, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, base: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, one row a document.

    ``start`` counts the ids of all documents before it.
    """
    rows = manifest.orderBy("file").collect()  # one short row a file
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts, total = {}, 0
    for r in rows:
        starts[r["file"]] = total
        total += r["n_ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                file = Reader(content.as_buffer())
                bounds = np.concatenate([[0], np.cumsum(file.lengths.astype(np.int64))])
                sums = np.empty(len(file.lengths), np.int64)
                at = 0
                while at < len(sums):
                    to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + DECODE_IDS, "right")) - 1)
                    ids, low = file.ids(int(bounds[at]), int(bounds[to])).astype("<u4"), bounds[at]
                    for i in range(at, to):
                        sums[i] = zlib.crc32(ids[bounds[i] - low: bounds[i + 1] - low])
                    at = to
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=file.nulls.astype(bool)), pa.array(bounds[:-1] + starts[path.as_py().rsplit("/", 1)[-1]]), pa.array(file.lengths.astype(np.int64)), pa.array(sums)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
                del file
            give_back()

    files = spark.read.format("binaryFile").load([f"{base}/{r['file']}" for r in rows]).select("path", "content")
    return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and read them back."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(spark, base, write_tokens(docs, base, tokenizer or tokenizer_path()))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"))
