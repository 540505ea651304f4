"""A dataset manifest: a Merkle tree for each language, and one over their roots, with a proof for every row.

Rows become digests of their fields, are sorted by ranges of (language, doc_id) over the whole
table, and get their place in their language's tree from the counts of the partitions before
them; only the first and last language of a partition can go on in another, so the driver
holds four numbers a partition.  A task walks its rows in chunks of ``arity ** CHUNK``
places and builds every subtree that lies whole within them.  What is left at the ragged ends of partitions, a
few nodes each, is shuffled by its coordinates (level and index): one task gets the nodes under one node at the height of
a chunk and finishes the subtree; each round after goes ``LIFT`` levels further up, until the highest tree is done.  Going back
down the rounds, every node gets its siblings up to the root, and a last pass over the chunks
joins them with the siblings within the chunk: that is the proof of a row.

``manifest`` returns each row's leaf, roots and proof; ``fold`` computes the root that a leaf and its proof
lead to, which is how one row is checked without the others, and ``folded`` does so for rows of a kept manifest.

A node above the leaves is the digest of the digests of ``arity`` consecutive nodes below it, joined as lowercase
hexadecimal; the last run of a level may be shorter, even one node.  A tree of one leaf is that leaf.

Defined cases: a null field is hashed as ``-``, so it differs from an empty text; null
lang is a language of its own, first; null doc_ids come first; rows of one doc_id are
ordered by leaf, and equal rows are leaves of their own; an empty table has no rows, no root; other
columns are ignored.  In the query a row without doc_id is not tampered with, nor is one without n_chars
or at the largest n_chars that fits.

Scale: a task holds one chunk, or the nodes under one node of a round; a language may have any share of the rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import BROADCAST_ROWS, cut, give_back, small, spread_join, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
#: A chunk has ``arity ** CHUNK`` leaves; a round goes ``LIFT`` levels up.
CHUNK = 12
LIFT = 10
HEX = 64


def digest(text: bytes) -> bytes:
    return sha256(text).hexdigest().encode()


def leaf(**fields: Column) -> Column:
    """The digest of ``FIELDS``, each ``-`` if null or else its length in bytes, a colon and the value."""
    texts = [fields[f].cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Nodes at each level of a tree of ``n`` leaves, up to its root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


def fold(leaf: bytes, place: int, n: int, siblings: bytes, arity: int = ARITY, at: int = 0) -> tuple[bytes, int]:
    """The root that ``leaf`` at ``place`` of ``n`` leads to with the ``siblings``, and where in them its tree's end."""
    while n > 1:
        q, own = divmod(place, arity)
        others = min(arity, n - q * arity) - 1
        before, after = at + own * HEX, at + others * HEX
        leaf = digest(siblings[at:before] + leaf + siblings[before:after])
        at, place, n = after, q, -(-n // arity)
    return leaf, at


def build(given: dict[int, dict[int, bytes]], sizes: list[int], top: int, arity: int) -> list[dict[int, bytes]]:
    """All nodes up to level ``top`` that those ``given`` (level, index) make: one is made where all below it are there."""
    levels = [dict(given.get(level, {})) for level in range(top + 1)]
    for level in range(top):
        here, up = levels[level], levels[level + 1]
        for q in sorted({i // arity for i in here}):
            run = range(q * arity, min((q + 1) * arity, sizes[level]))
            if all(i in here for i in run):
                up[q] = digest(b"".join([here[i] for i in run]))
    return levels


def climb(levels: list[dict[int, bytes]], sizes: list[int], level: int, index: int, arity: int) -> tuple[bytes, int, int]:
    """From a node up as far as ``levels`` reach: the siblings on the way, and the node that it ends at."""
    out = []
    while level + 1 < len(levels) and index // arity in levels[level + 1]:
        here, q = levels[level], index // arity
        for i in range(q * arity, min((q + 1) * arity, sizes[level])):
            if i != index:
                out.append(here[i])
        level, index = level + 1, q
    return b"".join(out), level, index


def open_nodes(levels: list[dict[int, bytes]], arity: int) -> Iterator[tuple[int, int, bytes]]:
    """The nodes whose parent is not known: all that the rest of the tree needs of these."""
    for level, nodes in enumerate(levels):
        for i, h in nodes.items():
            if level + 1 == len(levels) or i // arity not in levels[level + 1]:
                yield level, i, h


def _runs(groups: pa.Array) -> list[tuple[str, int]]:
    """The groups of sorted rows, and how many rows each has."""
    runs = pc.run_end_encode(groups)
    return list(zip(runs.values.to_pylist(), np.diff(np.r_[0, runs.run_ends.to_numpy()]).tolist()))


def _ends(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition of the sorted ``rows``: how many rows of its first group are before it, and how many rows its last group has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        n_first = n_last = 0
        for batch in batches:
            for g, n in _runs(batch.column(0)):
                first = g if first is None else first
                n_last = n if g != last else n_last + n
                n_first, last = n_last if g == first else n_first, g
        if last is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first], "n_first": [n_first], "last": [last], "n_last": [n_last]})

    found = sorted(map(tuple, rows.select("g").mapInArrow(count, "p int, first string, n_first long, last string, n_last long").collect()))  # one row a partition
    total: Counter[str] = Counter()
    before = {}
    for p, first, n_first, last, n_last in found:
        before[p] = total[first]
        total[first] += n_first
        if last != first:
            total[last] += n_last
    return {p: (before[p], total[last]) for p, _, _, last, _ in found}


def _chunks(rows: DataFrame, arity: int, chunk: int) -> DataFrame:
    """g, start, rows, nodes: leaves of one chunk of places and one partition, and the open nodes that they make.

    ``rows`` has g, leaf and what goes with a leaf, each partition in the order of its trees.
    """
    ends = rows.sparkSession.sparkContext.broadcast(_ends(rows))
    width = arity**chunk
    node = pa.struct([("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group, place, held = None, 0, []

        def piece(n: int) -> pa.RecordBatch:
            """What is held, as a row; ``n`` is the size of the group, or any that ends with this chunk."""
            some = pa.concat_arrays(held)
            held.clear()
            start, sizes = place - len(some), level_sizes(n, arity)
            leaves = some.field("leaf").cast(pa.binary()).to_pylist()
            levels = build({0: dict(enumerate(leaves, start))}, sizes, min(chunk, len(sizes) - 1), arity)
            nodes = [{"level": level, "index": i, "hash": h.decode()} for level, i, h in open_nodes(levels, arity)]
            packed = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
            return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([start]), packed, pa.array([nodes], pa.list_(node))], ["g", "start", "rows", "nodes"])

        for batch in batches:
            structs, at = batch.select(batch.schema.names[1:]).to_struct_array(), 0
            for g, n in _runs(batch.column(0)):
                if g != group:
                    if held:
                        yield piece(place)  # a group that another one follows ends here
                    place = ends.value[TaskContext.get().partitionId()][0] if group is None else 0
                    group = g
                while n:
                    some = min(n, width - place % width)
                    held.append(structs.slice(at, some))
                    at, place, n = at + some, place + some, n - some
                    if place % width == 0:
                        yield piece(place)
        if held:
            yield piece(ends.value[TaskContext.get().partitionId()][1])

    names = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(walk, f"g string, start long, rows array<struct<{names}>>, nodes array<struct<level:int,index:long,hash:string>>")


def _round(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The nodes of each subtree of ``height`` levels with ``path``, their siblings within it, and ``up``, the subtree; and its root, with a hash."""
    out = pa.schema([("g", pa.string()), ("n", pa.int64()), ("start", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("hash", pa.string()), ("up", pa.int64()), ("path", pa.string())])

    def finish(key: tuple, rows: pa.Table) -> pa.Table:
        g, up = (k.as_py() for k in key)
        n = rows.column("n")[0].as_py()
        sizes = level_sizes(n, arity)
        given: dict[int, dict[int, bytes]] = {}
        listed = [rows.column(c).to_pylist() for c in ("level", "index", "hash", "start")]
        for level, i, h, _ in zip(*listed):
            given.setdefault(level, {})[i] = h.encode()
        levels = build(given, sizes, min(height, len(sizes) - 1), arity)
        made = [(g, n, start, level, i, None, up, climb(levels, sizes, level, i, arity)[0].decode()) for level, i, _, start in zip(*listed)]
        top = len(levels) - 1
        made.append((g, n, None, top, up, levels[top][up].decode(), None, None))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*made), out)], schema=out)

    keyed = nodes.withColumn("up", F.floor(F.col("index") / F.lit(float(arity)) ** (F.lit(height) - F.col("level"))).cast("long"))
    return cut(keyed.groupBy("g", "up").applyInArrow(finish, "g string, n long, start long, level int, index long, hash string, up long, path string"))


def _leaf_counts(rows: DataFrame) -> DataFrame:
    return small(rows.groupBy("g").agg(F.count("*").alias("n")))


def trees(rows: DataFrame, arity: int = ARITY, chunk: int = CHUNK, lift: int = LIFT) -> tuple[DataFrame, DataFrame]:
    """A tree for each group ``g``: (g, start, n, rows, paths), one row a chunk; and (g, n, root).

    ``rows``: see ``_chunks``.  ``paths`` has, for each open node of the chunk, the siblings from there to the root.
    """
    chunks = cut(_chunks(rows, arity, chunk))
    sizes = _leaf_counts(rows)
    nodes = spread_join(chunks.select("g", "start", F.inline("nodes")), sizes, ["g"], ["start", "level", "index"], None if sizes.count() <= BROADCAST_ROWS else True)
    most = sizes.agg(F.max("n")).first()[0] or 0
    rounds, height, highest = [], chunk, len(level_sizes(max(1, most), arity)) - 1
    roots = None
    while True:
        done = _round(nodes, arity, height)
        rounds.append(done.filter("hash is null").drop("hash"))
        made = done.filter("hash is not null").select("g", "n", F.lit(0).cast("long").alias("start"), "level", "index", "hash")
        alone = made.filter("index = 0").withColumn("whole", F.col("n") <= F.lit(float(arity)) ** F.col("level"))
        whole = alone.filter("whole").select("g", "n", F.col("hash").alias("root"))
        roots = whole if roots is None else roots.unionByName(whole)
        nodes = made.join(alone.filter("whole").select("g"), "g", "left_anti")
        if height >= highest:
            break
        height += lift
    above = None
    for done in reversed(rounds):
        if above is not None:
            above = above.select("g", F.col("index").alias("up"), F.col("path").alias("rest"))
            done = done.join(above, ["g", "up"], "left").withColumn("path", F.concat("path", F.coalesce("rest", F.lit("")))).drop("rest")
        above = done
    paths = above.groupBy("g", "start").agg(F.any_value("n").alias("n"), F.collect_list(F.struct("level", "index", "path")).alias("paths"))
    return chunks.drop("nodes").join(paths, ["g", "start"]), roots


def _proofs(chunks: DataFrame, arity: int, chunk: int) -> DataFrame:
    """One row a leaf: g, place, n, proof and what else a chunk has.

    With ``rest``, the proof goes on by it, from the group's root to that of the whole, and where rows have ``shown``,
    ``folded`` is the root that leads from it (or from the leaf, where it is null) by the proof.
    """
    struct = chunks.schema["rows"].dataType.elementType
    own = [f"{f.name} {f.dataType.simpleString()}" for f in struct.fields]
    same = [f for f in chunks.schema.fields if f.name not in ("g", "start", "n", "rows", "paths", "rest")]
    folds = "shown" in struct.names
    out = ["g string", "place long", "n long", "proof string", *own, *[f"{f.name} {f.dataType.simpleString()}" for f in same], *["folded string"] * folds]
    names = [c.split()[0] for c in out]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c not in ("rows", "paths")}
                g, start, n, end = row["g"], row["start"], row["n"], (row.get("rest") or "").encode()
                some = batch.column("rows")[k].values
                rest = {(x["level"], x["index"]): x["path"].encode() + end for x in batch.column("paths")[k].as_py()}
                leaves = some.field("leaf").cast(pa.binary()).to_pylist()
                sizes = level_sizes(n, arity)
                levels = build({0: dict(enumerate(leaves, start))}, sizes, min(chunk, len(sizes) - 1), arity)
                for first in range(0, len(leaves), 1024):
                    part = some.slice(first, 1024)
                    m = len(part)
                    proofs, roots = [], []
                    shown = part.field("shown").to_pylist() if folds else [None] * m
                    for i, other in enumerate(shown, first):
                        path, level, at = climb(levels, sizes, 0, start + i, arity)
                        path += rest[level, at]
                        proofs.append(path.decode())
                        if folds:
                            sub, used = fold(other.encode() if other else leaves[i], start + i, n, path, arity)
                            roots.append(fold(sub, row["tree"], row["trees"], path, arity, used)[0].decode())
                    places = pa.array(np.arange(start + first, start + first + m))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g] * m), places, pa.array(np.full(m, n)), pa.array(proofs), *[part.field(c) for c in struct.names], *[pa.array([row[f.name]] * m) for f in same], *[pa.array(roots)] * folds], names)
            give_back()

    return chunks.mapInArrow(prove, ", ".join(out))


def manifest(docs: DataFrame, arity: int = ARITY, chunk: int = CHUNK, lift: int = LIFT, shown: Column | None = None, **carried: Column) -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang, leaf, place, leaves, subroot, tree, trees, root, proof and ``carried``.

    ``place`` of ``leaves`` is the leaf's place in its language's tree; ``tree`` of ``trees`` that of the
    language's root, ``subroot``, in the tree of the whole; ``proof`` is the siblings on the way to ``root``, joined.
    With ``shown``, a leaf that is to be checked in place of the row's own where not null, ``folded`` is the root that it leads to.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before any language, and apart from the empty one
    more = carried | ({} if shown is None else {"shown": shown})
    digests = docs.select(named.alias("g"), leaf(**{f: F.col(f) for f in FIELDS}).alias("leaf"), F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(name) for name, c in more.items()])
    order = ["g", "doc_id", "leaf", "tie"]
    rows = digests.withColumn("tie", F.monotonically_increasing_id())  # deals out equal rows
    chunks, roots = trees(cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")), arity, chunk, lift)
    roots = cut(roots)
    named = roots.select(F.lit("").alias("g"), F.col("root").alias("leaf"), F.col("g").alias("name"))
    top, whole = trees(cut(named.repartitionByRange("name").sortWithinPartitions("name")), arity, chunk, lift)
    tree = small(
        _proofs(top, arity, chunk).join(F.broadcast(whole.select("g", "root")), "g")
        .select(F.col("name").alias("g"), F.col("leaf").alias("subroot"), F.col("place").alias("tree"), F.col("n").alias("trees"), "root", F.col("proof").alias("rest")))
    found = _proofs(spread_join(chunks, tree, ["g"], ["start"], None if tree.count() <= BROADCAST_ROWS else True), arity, chunk)
    return found.select(
        "doc_id", F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("lang"), "leaf", "place", F.col("n").alias("leaves"),
        "subroot", "tree", "trees", "root", "proof", *carried, *["folded"] * (shown is not None))


def folded(arity: int = ARITY):
    """A function of leaf, place, leaves, tree, trees and proof: the root that they lead to."""

    @F.pandas_udf("string")
    def root(leaf: pd.Series, place: pd.Series, leaves: pd.Series, tree: pd.Series, trees_: pd.Series, proof: pd.Series) -> pd.Series:
        out = []
        for own, i, n, k, m, path in zip(leaf, place, leaves, tree, trees_, proof):
            path = path.encode()
            sub, at = fold(own.encode(), i, n, path, arity)
            out.append(fold(sub, k, m, path, arity, at)[0].decode())
        return pd.Series(out, dtype=object)

    return root


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {f: F.col(f) for f in FIELDS} | {"n_chars": F.try_add(F.col("n_chars"), F.lit(1).cast("long"))}
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & fields["n_chars"].isNotNull()
    made = manifest(docs, shown=F.when(chosen, leaf(**fields)))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: Unsigned crc32 of the decimal digits of doc_id: of each byte, then 8 shifts (marked 256).
_CRC = "xor(list_reduce(flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(s[i]) AS BIGINT)] || [256, 256, 256, 256, 256, 256, 256, 256])), lambda c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295)"
_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_DIGEST = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"
ORACLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN s IS NOT NULL AND {_CRC} % 7 = 0 THEN other ELSE leaf END AS shown,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS s, {_DIGEST('n_chars')} AS leaf, {_DIGEST('n_chars + 1')} AS other FROM documents)
), below AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY i) AS next FROM below WHERE n > 1) WHERE i % 2 = 0
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM below WHERE n = 1
), above AS (
  SELECT 0 AS level, i, n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(next, ''))
  FROM (SELECT *, lead(h) OVER (ORDER BY i) AS next FROM above WHERE n > 1) WHERE i % 2 = 0
), nodes AS (
  SELECT coalesce('=' || lang, '') AS g, level, i, n, h FROM below UNION ALL SELECT 'top', level, i, n, h FROM above
), start AS (
  SELECT row_number() OVER () AS r, coalesce('=' || l.lang, '') AS g, l.leaf, l.shown, l.doc_id, l.i, s.i AS tree FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
), walk AS (
  SELECT r, g, 0 AS level, i, tree, shown AS h, '' AS proof, false AS done FROM start
  UNION ALL
  SELECT w.r, CASE WHEN w.n = 1 THEN 'top' ELSE w.g END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN w.tree ELSE w.i // 2 END, w.tree,
         CASE WHEN w.n = 1 THEN w.h WHEN w.other IS NULL THEN sha256(w.h) WHEN w.i % 2 = 0 THEN sha256(w.h || w.other) ELSE sha256(w.other || w.h) END,
         w.proof || coalesce(w.other, ''), w.n = 1 AND w.g = 'top'
  FROM (SELECT walk.*, own.n, other.h AS other FROM walk
        JOIN nodes own ON walk.g = own.g AND walk.level = own.level AND walk.i = own.i
        LEFT JOIN nodes other ON own.n > 1 AND walk.g = other.g AND walk.level = other.level AND xor(walk.i, 1) = other.i
        WHERE NOT done) w
)
SELECT doc_id, leaf, sub.h AS subroot, whole.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = whole.h AS verified
FROM walk w JOIN start s USING (r) JOIN subroots sub ON coalesce('=' || sub.lang, '') = s.g JOIN above whole ON whole.n = 1
WHERE w.done
"""
