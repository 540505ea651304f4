"""Dropping lines that many documents share, by a sharded minimal perfect hash of all distinct lines.

A line's key (the line stripped and lower-cased) is hashed to 128 bits.  Distinct hashes and the
number of documents that have each are dealt out to shards of about ``SHARD_KEYS``, and each shard
becomes one row of arrays: a minimal perfect hash gives every one of its hashes a place of its
own, where a fingerprint and a count are stored, some 5.5 bytes a line in place of the line.  Documents are not
joined with lines.  They send packed batches of hashes to the shards, each batch probes the
arrays as a whole, and only the numbers of lines to drop come back, to documents that have any.

The perfect hash is a cascade of bit arrays: each level places the hashes that have a bit to
themselves, and the others go on to the next level; the place is the rank of the bit
(``perfect_hash``, ``places``).  Hashes that are in the index are always answered right; for
documents other than those indexed, a line not in it is taken for another one with a chance of
1 in 2**32, by the fingerprint.

Defined cases: a null or empty text is one empty line; an empty key is never dropped; a line that repeats in one document counts
once; rows are documents, also where they share a doc_id or a text; a text whose lines are
all dropped becomes empty; a null text stays null; an empty table gives an empty result; all other columns are kept.

Scale: lines are counted in each batch, then by Spark, before they meet, so a line in every
document is no hot key; a shard that gets more than ``PROBES`` hashes is copied to as many parts as
it needs; texts of which there are many copies are dealt out too.  A task holds one shard and the
hashes that probe it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.llm.common import cut, free_name, hot_keys, packed, spread_join, table, text_batches, text_key
from corpusq.llm.tokens import slices

MIN_CHARS = 1
MIN_DOCS = 10
SPACES = " \t\n\x0b\f\r"
SHARD_KEYS = 1 << 17
#: Hashes that one task probes at most, about, 40 bytes each.
PROBES = 1 << 20
#: Bits of a level for each hash that comes to it.
GAMMA = 1.5
_ENTRY = np.dtype([("t1", "<i8"), ("t2", "<i8"), ("h1", "<u8"), ("h2", "<u8"), ("line", "<i8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (_mixed(h1 ^ _mixed(h2 + seed)) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, one after the other, for distinct hashes (h1, h2)."""
    sizes, bits = [], []
    while len(h1):
        size = int(len(h1) * GAMMA) + 1
        at = _bit(h1, h2, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        again = ~alone[at]
        h1, h2 = h1[again], h2[again]
    return sizes, np.concatenate([np.zeros(0, bool), *bits])


def places(sizes: list[int], bits: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The place of each hash, 0 to the number of hashes in the index; -1 for one that has none, which is surely not in it."""
    rank = np.cumsum(bits) - 1
    out, left, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = start + _bit(h1[left], h2[left], level, size)
        found = bits[at]
        out[left[found]] = rank[at[found]]
        left = left[~found]
        start += size
    return out


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(h1) % np.uint64(shards)).astype(np.int32)


def _keyed_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2) of the distinct keys of a batch; which of them each line is (-1: too short), and how many lines each text has."""
    import xxhash

    lines = pc.split_pattern(texts.fill_null("") if texts.null_count else texts, "\n")
    keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=SPACES)).dictionary_encode()
    known = keys.dictionary
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k.as_buffer()) for k in known.cast(pa.large_binary())]), "<u8").reshape(-1, 2)
    of = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    long_enough = pc.utf8_length(known).to_numpy(zero_copy_only=False) >= min_chars
    return digests[:, 0], digests[:, 1], np.where(long_enough[of], of, -1), pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def _asked(texts: pa.Array, min_chars: int):
    """h1, h2 of the distinct keys; and for each key of each text once: which key, which text and its first line there."""
    h1, h2, of, n_lines = _keyed_lines(texts, min_chars)
    text = np.repeat(np.arange(len(texts)), n_lines)
    line = np.arange(len(of)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    used = np.flatnonzero(of >= 0)
    _, first = np.unique(text[used] * max(1, len(h1)) + of[used], return_index=True)
    at = used[first]
    return h1, h2, of[at], text[at], line[at]


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n: the distinct keys of all lines and the number of documents with each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1, h2, of, _, _ = _asked(batch.column(1), min_chars)
            n = np.bincount(of, minlength=len(h1))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(h1[some].view(np.int64)), pa.array(h2[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["h1", "h2", "n"])

    text_batches(docs.sparkSession)
    return docs.select(F.lit(0).alias("_"), "text").mapInArrow(count, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The index of ``line_counts`` and its number of shards.

    One row a shard: shard, keys, probes (documents' lines in it), sizes and bits of
    the perfect hash, fingerprints (4 bytes each) and counts (cut off at what fits the
    fewest bytes that hold ``min_docs``).
    """
    counts = cut(counts)
    shards = max(1, -(-counts.count() // shard_keys))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min_docs <= np.iinfo(k).max)
    out = pa.schema([("shard", pa.int32()), ("keys", pa.int64()), ("probes", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = _shard_of(batch.column(0).to_numpy().view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], [*batch.schema.names, "shard"])

    def build(rows: pa.Table) -> pa.Table:
        h1, h2, n = (rows.column(c).to_numpy() for c in ("h1", "h2", "n"))
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        sizes, bits = perfect_hash(h1, h2)
        at = places(sizes, bits, h1, h2)
        fingerprints, stored = np.empty(len(at), "<u4"), np.empty(len(at), kind)
        fingerprints[at] = _fingerprint(h2)
        stored[at] = np.minimum(n, np.iinfo(kind).max)
        return pa.Table.from_pylist([{
            "shard": rows.column("shard")[0].as_py(), "keys": len(at), "probes": int(n.sum()), "sizes": sizes,
            "bits": np.packbits(bits).tobytes(), "fingerprints": fingerprints.tobytes(), "counts": stored.tobytes()}], out)

    dealt = counts.mapInArrow(deal, "h1 long, h2 long, n long, shard int")
    index = dealt.groupBy("shard").applyInArrow(build, "shard int, keys long, probes long, sizes array<long>, bits binary, fingerprints binary, counts binary")
    return cut(index), shards


def _fingerprint(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype("<u4")


def _requests(docs: DataFrame, shards: int, min_chars: int) -> DataFrame:
    """shard, probes: the keys of the texts of a batch that are one shard's, packed (text, hash, line)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h1, h2, of, text, line = _asked(batch.column(1), min_chars)
            if not len(of):
                continue
            t1, t2 = (batch.column(i).to_numpy() for i in (0, 2))
            # equal texts of a batch ask once
            _, first = np.unique(np.stack([t1, t2], axis=1), axis=0, return_index=True)
            once = np.zeros(batch.num_rows, bool)
            once[first] = True
            ask = once[text]
            of, text, line = of[ask], text[ask], line[ask]
            entries = np.empty(len(of), _ENTRY)
            entries["t1"], entries["t2"], entries["h1"], entries["h2"], entries["line"] = t1[text], t2[text], h1[of], h2[of], line
            shard = _shard_of(entries["h1"], shards)
            order = np.argsort(shard, kind="stable")
            entries, shard = entries[order], shard[order]
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            packs = [x.tobytes() for x in np.split(entries, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[starts]), pa.array(packs, pa.binary())], ["shard", "probes"])

    text_batches(docs.sparkSession)
    return docs.select("_t1", "text", "_t2").mapInArrow(pack, "shard int, probes binary")


def frequent_lines(docs: DataFrame, index: DataFrame, shards: int, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """_t1, _t2, lines: for each text (_t1, _t2, text) with lines that at least ``min_docs`` documents have, the numbers from 0 of the lines where each such key is first."""
    total = index.agg(F.coalesce(F.sum("probes"), F.lit(0))).first()[0]
    # at most 100,000 shards are dealt out in parts, so their list is small
    each = max(PROBES, total // 100_000)
    hot = F.broadcast(index.filter(F.col("probes") > each).select("shard", F.ceil(F.col("probes") / each).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    asked = _requests(docs, shards, min_chars).join(hot, "shard", "left").select("shard", F.pmod(F.xxhash64("probes"), parts).cast("int").alias("part"), "probes")
    arrays = index.drop("keys", "probes").join(hot, "shard", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    out = pa.schema([("_t1", pa.int64()), ("_t2", pa.int64()), ("lines", pa.list_(pa.int64()))])

    def probe(asking: pa.Table, found: pa.Table) -> pa.Table:
        if not asking.num_rows or not found.num_rows:
            return out.empty_table()
        row = found.slice(0, 1).to_pylist()[0]
        entries = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in asking.column("probes")])
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(row["sizes"])).astype(bool)
        fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        counts = np.frombuffer(row["counts"], f"<u{len(row['counts']) // len(fingerprints)}")
        at = places(row["sizes"], bits, entries["h1"], entries["h2"])
        many = (at >= 0) & (fingerprints[at] == _fingerprint(entries["h2"])) & (counts[at] >= min_docs)
        entries = np.unique(entries[many][["t1", "t2", "line"]])
        starts = np.flatnonzero(np.r_[True, (entries["t1"][1:] != entries["t1"][:-1]) | (entries["t2"][1:] != entries["t2"][:-1])]) if len(entries) else np.zeros(0, np.int64)
        lines = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(entries)].astype(np.int32)), pa.array(np.ascontiguousarray(entries["line"])))
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(entries["t1"][starts])), pa.array(np.ascontiguousarray(entries["t2"][starts])), lines], schema=out)

    answers = asked.groupBy("shard", "part").cogroup(arrays.groupBy("shard", "part")).applyInArrow(probe, "_t1 long, _t2 long, lines array<long>")
    # copies of one text get equal answers
    return answers.groupBy("_t1", "_t2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("lines"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
def _without(text: pd.Series, lines: pd.Series) -> pd.DataFrame:
    """The text without all lines whose key is that of one of ``lines``, and how many those are; null where there are none."""

    def drop(text: str | None, first) -> tuple[str | None, int]:
        if first is None:
            return None, 0
        all_ = (text or "").split("\n")
        keys = [x.encode().strip(SPACES.encode()).lower() for x in all_]  # bytes: letters of ASCII alone are lowered
        gone = {keys[i] for i in first}
        kept = [x for x, key in zip(all_, keys) if key not in gone]
        return None if text is None else "\n".join(kept), len(all_) - len(kept)

    made = [drop(*x) for x in zip(text, lines)]
    return pd.DataFrame({"text": pd.Series([x[0] for x in made], dtype=object), "n": pd.Series([x[1] for x in made], dtype="int64")})


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with the lines dropped from its texts, and n_lines and n_dropped (with ``_`` after a name that the input has already)."""
    index, shards = build_index(line_counts(docs, min_chars), min_docs, shard_keys)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(*text_key(text), "text", F.monotonically_increasing_id().alias("_n"))
    answers = cut(frequent_lines(keyed, index, shards, min_docs, min_chars))
    texts = packed(docs, text=F.col("text"), n=F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, key=F.monotonically_increasing_id()).select("*", *text_key(text))
    copies = hot_keys(keyed.groupBy("_t1", "_t2").agg(F.count("*").alias("n")), ["_t1", "_t2"])
    joined = spread_join(texts, answers, ["_t1", "_t2"], ["key"], copies, "left")
    kept = _without(F.when(F.col("lines").isNotNull(), F.col("text")), F.col("lines"))
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    made = joined.select("_row", "n", "text", kept.alias("_kept"))
    own = [F.coalesce("_kept.text", "text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return made.select(*own, F.col("n").cast("long").alias(n_lines), F.col("_kept.n").alias(n_dropped))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
  SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM keyed WHERE key NOT IN (SELECT key FROM frequent) GROUP BY r
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""
