"""Sampling, budgets, batches and map-reduce over the chunks of files."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import basename, bigrams, tokens
from corpusq.operators import fulltext, outline
from corpusq.operators.search import exhaustive_search, keyword_search, vector_search_many
from corpusq.session import cut, kept

#: Fixed value: what stands for the chunks of a file beyond its budget.
OMITTED = "\n...(后续内容因长度限制省略)"
#: A section, and a whole outline, that no file matches.
NO_FILES = "（未找到相关文件）"
NOTHING = "未在知识库中找到与框架相关的文件内容。"
#: What follows the files shown where there are more, and the answer where the model gives none.
SHOWN = ("\n（共命中 ", " 个文件，此处展示最相关的 ", " 个）")
NOT_COMPARED = "对比分析未能完成，请重试。"
BROADCAST_ROWS = 1_000_000
#: Chunks of a file that are read at once for all sections that they answer.
BLOCK_CHUNKS = 1024


def _numbered(chunks: DataFrame) -> DataFrame:
    in_file = Window.partitionBy("source_file")
    return chunks.withColumn("rn", F.row_number().over(in_file.orderBy("chunk_index", "rowid"))).withColumn("n", F.count("*").over(in_file))


def first_chunks(chunks: DataFrame, n: int = 30, chars: int = 2000) -> DataFrame:
    """The first n chunks of every file, cut to ``chars``."""
    return _numbered(chunks).filter(F.col("rn") <= n).withColumn("text", F.substring("text", 1, chars)).drop("rn", "n")


def file_text(chunks: DataFrame, n: int = 30, chars: int = 2000, file_chars: int = 12000, marker: str = "\n...(truncated)") -> DataFrame:
    """source_file, content: first chunks joined; longer texts are cut and marked."""
    joined = first_chunks(chunks, n, chars).groupBy("source_file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "rowid", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    return joined.withColumn("content", F.when(F.length("content") > file_chars, F.concat(F.substring("content", 1, file_chars), F.lit(marker))).otherwise(F.col("content")))


def stratified_sample(chunks: DataFrame) -> DataFrame:
    """Of files with more than 50 chunks the first 15, the last 15 and every step-th between, step = (n - 30) / 20; others whole."""
    step = F.greatest(F.lit(1), F.floor((F.col("n") - 30) / 20))
    keep = (F.col("n") <= 50) | (F.col("rn") <= 15) | (F.col("rn") > F.col("n") - 15) | ((F.col("rn") - 16) % step == 0)
    return _numbered(chunks).filter(keep).drop("rn", "n")


def char_budget(chunks: DataFrame, chars: int = 4000, total: int = 60000) -> DataFrame:
    """Chunks of each file, cut to ``chars``, while their lengths sum to at most ``total``; adds ``used``, and ``more``: whether the file goes on after them."""
    upto = Window.partitionBy("source_file").orderBy("chunk_index", "rowid").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source_file")
    cut = chunks.withColumn("text", F.substring("text", 1, chars)).withColumn("used", F.sum(F.length("text")).over(upto))
    return cut.withColumn("more", F.max("used").over(whole) > total).filter(F.col("used") <= total)


def files_by_hits(hits: DataFrame) -> DataFrame:
    """source_file, hits: most hits first."""
    return hits.groupBy("source_file").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "source_file")


def batches(rows: DataFrame, order: list[str], size: int, group: list[str] | None = None) -> DataFrame:
    """Add ``batch``: consecutive slices of ``size`` in order, within group.

    A group (the chunks of one file) is numbered in one task.  Without group the rows are
    dealt out by ranges of ``order`` and numbered within each, after those of the ranges before.
    """
    if group:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("batch", F.floor((number - 1) / size).cast("long"))
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(before, "_range").withColumn("batch", F.floor((number - 1) / size).cast("long")).drop("_range", "_before")


def compare_context(hits: DataFrame, max_files: int = 40) -> DataFrame:
    """ord, source_file, content: sampled and budgeted text of the files with most hits."""
    top = files_by_hits(hits).limit(max_files)
    order = Window.orderBy(F.desc("hits"), "source_file")  # over max_files rows
    top = top.withColumn("ord", F.row_number().over(order).cast("long"))
    kept = char_budget(stratified_sample(hits.join(top.select("source_file"), "source_file", "left_semi")))
    page = F.get_json_object("metadata", "$.page") if "metadata" in kept.columns else F.lit(None).cast("string")
    tag = F.when(page.isNotNull() & (page != "0"), F.concat(F.lit(" [第"), page, F.lit("页]"))).otherwise("")
    part = F.concat(F.lit("--- Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), F.col("total_chunks").cast("string"), tag, F.lit(" ---\n"), "text")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "rowid", "part"))), lambda x: x["part"])
    texts = kept.withColumn("part", part).groupBy("source_file").agg(F.array_join(F.concat(parts, F.when(F.max("more"), F.array(F.lit(OMITTED))).otherwise(F.array().cast("array<string>"))), "\n\n").alias("content"))
    return top.join(texts, "source_file").select("ord", "source_file", F.concat(F.lit("===== "), basename(F.col("source_file")), F.lit(" =====\n"), "content").alias("content"))


def compare(chunks: DataFrame, task: str, generate: Callable[[str], str | None], max_files: int = 40) -> DataFrame:
    """answer, files, total_hit, sources: one row, the texts that match a task laid side by side before the model.

    All matching files are counted; the ``max_files`` with most hits are shown (``compare_context``), and the context says so where there are
    more.  Without any the answer is ``NOTHING``; where the model gives none it is ``NOT_COMPARED``.
    """
    hits = cut(exhaustive_search(chunks, task))
    total = hits.select("source_file").distinct().agg(F.count("*").alias("total_hit"))
    file = F.struct(basename(F.col("source_file")).alias("file"), F.col("source_file").alias("file_path"))
    shown = compare_context(hits, max_files).agg(F.sort_array(F.collect_list(F.struct("ord", "content", file.alias("f")))).alias("t"), F.count("*").alias("files"))  # max_files rows
    beyond = F.when(F.col("total_hit") > F.col("files"), F.array(F.concat(F.lit(SHOWN[0]), F.col("total_hit").cast("string"), F.lit(SHOWN[1]), F.col("files").cast("string"), F.lit(SHOWN[2])))).otherwise(F.array().cast("array<string>"))
    told = F.array_join(F.concat(F.transform("t", lambda x: x["content"]), beyond), "\n\n")
    one = cut(shown.crossJoin(total).select("files", "total_hit", F.transform("t", lambda x: x["f"]).alias("sources"), F.concat(F.lit(task + "\n\n"), told).alias("prompt")))  # one row by one row
    asked = generated(one.filter("files > 0"), "prompt", generate).withColumn("answer", F.coalesce(F.nullif("answer", F.lit("")), F.lit(NOT_COMPARED)))
    return asked.unionByName(one.filter("files = 0").withColumn("answer", F.lit(NOTHING))).select("answer", "files", "total_hit", "sources")


def generated(df: DataFrame, prompt: str, generate: Callable[[str], str | None], name: str = "answer") -> DataFrame:
    """Add the model's answer to each row's prompt; the model runs in the Python workers."""

    def each(prompts: pd.Series) -> pd.Series:
        return prompts.map(generate)

    return df.withColumn(name, F.pandas_udf(each, "string")(F.col(prompt)))


def _in_order(order: list[str], text: str):
    """The values of ``text`` of a group, in order, as an array."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text])


def _reduced(level: DataFrame, key: list[str], n: int, generate: Callable[[str], str | None], tree: int) -> DataFrame:
    """key, summary: ``level`` (key, part, summary), in batches of ``tree`` parts until each key has one.

    ``n`` is the largest number of parts of a key.  A single summary goes up as it is; where
    the model gives none, the summaries it was given stand.
    """
    while n > 1:
        joined = batches(level, ["part"], tree, key).groupBy(*key, "batch").agg(_in_order(["part"], "summary").alias("s"))
        asked = generated(joined.withColumn("prompt", F.array_join("s", "\n\n")), "prompt", generate, "made")
        summary = F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise(F.coalesce("made", "prompt"))
        level = asked.select(*key, F.col("batch").alias("part"), summary.alias("summary"))
        n = -(-n // tree)
    return level.select(*key, "summary")


def summarise(chunks: DataFrame, generate: Callable[[str], str | None], batch: int = 10, tree: int = 30) -> DataFrame:
    """source_file, summary: batches of chunks are summarised, then summaries in batches until one is left.

    Deterministic: parts are joined in order.  Each level is one DataFrame step; the number of levels is the
    logarithm of the largest file.
    """
    parts = batches(chunks, ["chunk_index", "rowid"], batch, ["source_file"]).groupBy("source_file", "batch").agg(F.array_join(_in_order(["chunk_index", "rowid"], "text"), "\n\n").alias("prompt"))
    level = generated(parts, "prompt", generate, "summary").select("source_file", F.col("batch").alias("part"), "summary")
    most = chunks.groupBy("source_file").count().agg(F.max("count")).first()[0] or 0
    return _reduced(level, ["source_file"], -(-most // batch), generate, tree)


def file_context(chunks: DataFrame, generate: Callable[[str], str | None], key: tuple[str, ...] = ("source_file",), n: int = 30, chars: int = 12000, part_chars: int = 15000, tree: int = 30) -> DataFrame:
    """key, content: what the model is told of each file, all of it read.

    A file of at most ``n`` chunks and ``chars`` characters is told whole.  Of others, batches of n
    chunks are summarised, a batch in several parts where it is over ``part_chars`` (a part ends
    with the chunk that reaches them), and the summaries reduced to one; a part without answer is "(failed)".
    """
    key = list(key)
    sized = _parts(chunks.withColumn("size", F.coalesce(F.length("text"), F.lit(0))), key, n, chars, part_chars)
    whole = sized.filter("whole").groupBy(*key).agg(F.array_join(_in_order(["rn"], "text"), "\n\n").alias("content"))

    parts = sized.filter("not whole").withColumn("told", F.concat("head", "text")).groupBy(*key, "batch", "within").agg(F.array_join(_in_order(["rn"], "told"), "\n\n").alias("prompt"))
    most = parts.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    level = generated(parts, "prompt", generate, "summary").select(*key, F.struct("batch", "within").alias("part"), F.coalesce("summary", F.lit("(failed)")).alias("summary"))
    return whole.unionByName(_reduced(level, key, most, generate, tree).withColumnRenamed("summary", "content"))


def _parts(chunks: DataFrame, key: list[str], n: int, chars: int, part_chars: int) -> DataFrame:
    """Adds rn, whole, batch, within, head: the part of its file to which a chunk of ``size`` characters goes, as ``file_context`` has them; no text is needed."""
    in_file = Window.partitionBy(*key)
    sized = chunks.withColumn("rn", F.row_number().over(in_file.orderBy("chunk_index", "rowid"))).withColumn("n", F.count("*").over(in_file)).withColumn("len", F.sum("size").over(in_file))
    earlier = Window.partitionBy(*key, "batch").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("total_chunks") if "total_chunks" in chunks.columns else F.col("n")
    head = F.concat(F.lit("[Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"), total.cast("string"), F.lit("]\n"))
    dealt = sized.withColumn("whole", (F.col("n") <= n) & (F.col("len") <= chars)).withColumn("batch", F.floor((F.col("rn") - 1) / n))
    return dealt.withColumn("within", F.floor(F.coalesce(F.sum("size").over(earlier), F.lit(0)) / part_chars)).withColumn("head", head).drop("n", "len")


def hits_context(hits: DataFrame, chunks: DataFrame, generate: Callable[[str], str | None], key: tuple[str, ...], n: int = 30, chars: int = 12000, part_chars: int = 15000, tree: int = 30, block: int = BLOCK_CHUNKS) -> DataFrame:
    """``file_context`` of hits (key, source_file, chunk_index, total_chunks, rowid, size) whose texts are in ``chunks``, one of which many keys may hit.

    The parts are made without texts.  Each text is then dealt out once, to its block of its file, and read there for
    all keys.  A part within one block is answered there; others are put together from their pieces of blocks.
    """
    key, group = list(key), [*key, "batch", "within"]
    block_of = F.coalesce(F.floor(F.col("chunk_index") / block), F.lit(-1)).cast("long").alias("block")
    parts = _parts(hits, key, n, chars, part_chars).select("*", block_of)
    parts = parts.withColumn("batch", F.when(F.col("whole"), -1).otherwise(F.col("batch")).cast("long")).withColumn("within", F.when(F.col("whole"), -1).otherwise(F.col("within")).cast("long"))
    in_part = Window.partitionBy(*group)
    parts = parts.withColumn("alone", F.min("block").over(in_part) == F.max("block").over(in_part))
    slot = F.coalesce("chunk_index", F.lit(-1)).alias("slot")
    given = parts.select(*group, *[c for c in ("source_file",) if c not in key], "block", "rn", "whole", "alone", F.when(~F.col("whole"), F.col("head")).alias("head"), slot, "rowid")
    given = kept(given)  # so that the shuffles of hits are gone when texts are dealt out
    texts = chunks.filter("source_file is not null").select(F.col("source_file").alias("file"), block_of, slot, F.col("rowid").alias("row"), "text")
    names = [*group, "block", "whole", "alone"]

    def read(of: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        text_at = dict(zip(zip(held["slot"], held["row"]), held["text"]))
        rows = sorted(zip(zip(*(of[c] for c in names)), of["rn"], of["head"], of["slot"], of["rowid"]), key=lambda x: x[:2])
        out = []
        for part, lines in groupby(rows, key=lambda x: x[0]):
            told = [(head or "") + text for _, _, head, slot, rowid in lines if (text := text_at[slot, rowid]) is not None]
            joined = "\n\n".join(told)
            whole, alone = part[-2:]
            out.append((*part, (joined if whole else generate(joined)) if alone else joined if told else None))
        return pd.DataFrame(out, columns=[*names, "made"])

    schema = given.select(*names).schema.add("made", "string")
    made = kept(given.groupBy("source_file", "block").cogroup(texts.groupBy("file", "block")).applyInPandas(read, schema))  # the model is not asked again
    joined = made.filter("not alone").groupBy(*group, "whole").agg(F.array_join(_in_order(["block"], "made"), "\n\n").alias("made"))
    whole = made.filter("whole and alone").select(*key, F.col("made").alias("content")).unionByName(joined.filter("whole").select(*key, F.col("made").alias("content")))
    put = generated(joined.filter("not whole"), "made", generate, "summary").select(*group, "summary")
    level = made.filter("not whole and alone").select(*group, F.col("made").alias("summary")).unionByName(put)
    level = kept(level.select(*key, F.struct("batch", "within").alias("part"), F.coalesce("summary", F.lit("(failed)")).alias("summary")))
    most = level.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    return whole.unionByName(_reduced(level, key, most, generate, tree).withColumnRenamed("summary", "content"))


def reduce_all(summaries: DataFrame, order: str, generate: Callable[[str], str | None], size: int = 30) -> DataFrame:
    """summary: one row, summaries of many files reduced in batches until one is left."""
    level = cut(summaries.select(F.col(order).cast("string").alias("part"), "summary"))  # the model is not asked again
    n = level.count()
    while n > 1:
        joined = batches(level, ["part"], size).groupBy("batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "summary"))), lambda x: x["summary"]), "\n\n").alias("prompt"))
        level = generated(joined, "prompt", generate, "summary").select(F.format_string("%012d", "batch").alias("part"), "summary")
        n = -(-n // size)
    return level.select("summary")


def _told(files: str):
    """Files (source_file, content) one after the other, each under its name."""
    return F.array_join(F.transform(files, lambda x: F.concat(F.lit("【"), basename(x["source_file"]), F.lit("】\n"), x["content"])), "\n\n")


def focus(chunks: DataFrame, task: str, generate: Callable[[str], str | None], size: int = 30) -> DataFrame:
    """batch, files, answer: files in order, in batches, each answered for ``task`` from the files' contexts; failures say so."""
    batch = batches(chunks.select("source_file").distinct(), ["source_file"], size)
    grouped = file_context(chunks, generate).join(batch, "source_file").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("source_file", "content"))).alias("f"))
    asked = grouped.select("batch", F.transform("f", lambda x: x["source_file"]).alias("files"), F.concat(F.lit(task + "\n\n"), _told("f")).alias("prompt"))
    return generated(asked, "prompt", generate).withColumn("answer", F.coalesce("answer", F.lit("(failed)"))).drop("prompt")


def focus_report(chunks: DataFrame, task: str, generate: Callable[[str], str | None], size: int = 30) -> DataFrame:
    """summary: one row, the answers of all batches of ``focus`` made one; no row without chunks."""
    answers = focus(chunks, task, generate, size).select(F.format_string("%012d", "batch").alias("part"), F.col("answer").alias("summary"))
    return reduce_all(answers, "part", generate)


def union_sources(batches_of_sources: DataFrame) -> DataFrame:
    """First occurrence of each file_path over batches, in order of (batch, pos)."""
    first = Window.partitionBy("file_path").orderBy("batch", "pos")
    return batches_of_sources.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").orderBy("batch", "pos")


def _section_bodies(sections: DataFrame, hits: DataFrame, context: DataFrame, generate: Callable[[str], str | None], size: int, key: list[str]) -> DataFrame:
    """key, files, body: the files that match a section, most hits first, answered in batches from their ``context`` and the answers made one.  No row for a section without files."""
    asks = F.concat_ws("\n", "title", F.nullif("detail", F.lit(""))) if "detail" in sections.columns else F.col("title")
    counted = hits.groupBy(*key, "source_file").agg(F.count("*").alias("hits")).withColumn("less", -F.col("hits"))
    placed = batches(counted, ["less", "source_file"], size, key)
    grouped = context.join(placed, [*key, "source_file"]).groupBy(*key, "batch").agg(F.count("*").alias("files"), F.sort_array(F.collect_list(F.struct("less", "source_file", "content"))).alias("f"))
    asked = grouped.join(sections.select(*key, asks.alias("asks")), key).withColumn("prompt", F.concat("asks", F.lit("\n\n"), _told("f")))
    answers = cut(generated(asked, "prompt", generate).select(*key, F.col("batch").alias("part"), "files", F.coalesce("answer", F.lit("(failed)")).alias("summary")))
    facts = answers.groupBy(*key).agg(F.sum("files").alias("files"), F.count("*").alias("n"))
    most = facts.agg(F.max("n")).first()[0] or 0
    body = _reduced(answers.drop("files"), key, most, generate, 30).withColumnRenamed("summary", "body")
    return facts.drop("n").join(body, key)


def scan_report(sections: DataFrame, hits: DataFrame, generate: Callable[[str], str | None], size: int = 30) -> DataFrame:
    """ord, title, files, report: for every section the files that match it, most hits first, answered in batches and the answers made one.

    ``hits`` has ord (of the section), source_file, chunk_index, rowid, text.  Of every file all hits are read.
    """
    told = sections.join(_section_bodies(sections, hits, file_context(hits, generate, ("ord", "source_file")), generate, size, ["ord"]), "ord", "left")
    return told.select("ord", "title", F.coalesce("files", F.lit(0)).alias("files"), F.concat(F.lit("## "), "title", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("report")).orderBy("ord")


def section_phrases(sections: DataFrame) -> DataFrame:
    """key, phrase, n, i, token: the words of the numbered phrases that title and detail of a section search for.

    As ``search.query_phrases`` has them, quotes being punctuation: pairs of a CJK run, and what stands between blanks,
    each the words in it.  A section without any searches for its words.
    """
    asked = F.concat_ws(" ", "title", "detail")
    runs = F.regexp_extract_all(asked, F.lit(r"([一-鿿]+|[^一-鿿\s]+)"), F.lit(1))
    parts = F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[一-鿿]"), bigrams(r)).otherwise(F.array(r))))
    split = F.filter(F.transform(parts, tokens), lambda w: F.size(w) > 0)
    phrases = F.array_distinct(F.when(F.size(split) > 0, split).otherwise(F.transform(tokens(asked), lambda t: F.array(t))))
    each = sections.select("id", "ord", F.explode(phrases).alias("words")).withColumn("phrase", F.monotonically_increasing_id())
    return each.select("id", "ord", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("i", "token"))


def section_hits(sections: DataFrame, postings: DataFrame) -> DataFrame:
    """id, ord, rowid: the chunks that hold any phrase of a section (id, ord, title, detail), for all sections in one pass over the postings.

    The sections' words meet the postings once, by token; a phrase is there where all of its words are at their places.
    The words are broadcast if there are a million at most.
    """
    words = cut(section_phrases(sections))
    few = F.broadcast if words.count() <= BROADCAST_ROWS else lambda df: df
    met = postings.join(few(words.select("phrase", "n", "i", "token")), "token")
    place = ["phrase", "rowid", "part", F.when(F.col("n") == 1, 0).otherwise(F.col("pos") - F.col("i")).alias("at")]
    whole = met.groupBy(*place).agg(F.count("*").alias("found")).join(few(words.select("id", "ord", "phrase", "n").distinct()), "phrase").filter("found >= n")
    return whole.select("id", "ord", "rowid").distinct()


def scan(outlines: DataFrame, chunks: DataFrame, generate: Callable[[str], str | None], postings: DataFrame | None = None, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """Outlines (id, text) filled in from the whole corpus: (id, ord, title, files, body) and (id, document, files, sources).

    Every section's title and detail are searched without limit, in stored ``postings`` if given; its files go to the model by ``hits_context`` in
    batches of ``size``, most hits first; a chunk without a file is in none.  ``sources`` are the files (file, file_path), those of earlier sections first; ``files`` counts them.
    """
    sections = cut(outline.flat_sections(outlines))
    found = kept(section_hits(sections, fulltext.postings(chunks) if postings is None else postings))
    facts = chunks.filter("source_file is not null").select("rowid", "source_file", "chunk_index", "total_chunks", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    hits = kept(found.join(facts, "rowid"))
    context = hits_context(hits, chunks, generate, ("id", "ord", "source_file"))
    bodies = cut(_section_bodies(sections, hits, context, generate, size, ["id", "ord"]))  # the model is not asked again
    told = sections.select("id", "ord", "title").join(bodies, ["id", "ord"], "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))
    told = told.withColumn("body", F.when(F.col("files") > 0, F.coalesce("body", F.lit(""))).otherwise(NO_FILES))
    per = hits.groupBy("id", "ord", "source_file").agg((-F.count("*")).alias("less"))
    first = per.groupBy("id", "source_file").agg(F.min(F.struct("ord", "less")).alias("at"))
    file = F.struct(basename(F.col("source_file")).alias("file"), F.col("source_file").alias("file_path"))
    sources = first.groupBy("id").agg(F.count("*").alias("files"), F.transform(F.sort_array(F.collect_list(F.struct("at", "source_file", file.alias("f")))), lambda x: x["f"]).alias("sources"))
    part = F.concat(F.lit("## "), "title", F.lit("\n\n"), "body", F.lit("\n"))
    written = told.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("document"))
    documents = written.join(sources, "id", "left").select(
        "id", F.when(F.col("files").isNull(), F.lit(NOTHING)).otherwise(F.col("document")).alias("document"), F.coalesce("files", F.lit(0).cast("long")).alias("files"), F.coalesce("sources", F.array().cast("array<struct<file:string,file_path:string>>")).alias("sources"))
    return told.select("id", "ord", "title", "files", "body"), documents


def material(sections: DataFrame, hits: DataFrame, generate: Callable[[str], str | None], chars: int = 1000) -> DataFrame:
    """id, ord, number, title, depth, content: for every top section of an outline a text made of its hits.

    ``sections`` is of ``outline.tree_sections``; ``hits`` has id, ord, rank and text of the search for each top section; with source_file each text is headed by its file.
    """
    head = F.concat(F.lit("[Source: "), basename(F.col("source_file")), F.lit("]\n")) if "source_file" in hits.columns else F.lit("")
    told = F.concat(head, F.substring("text", 1, chars))
    found = hits.groupBy("id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", told.alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    top = sections.filter("parent_ord is null").join(found, ["id", "ord"], "left")
    prompt = F.concat(F.col("number"), F.lit(" "), "title", F.lit("\n"), F.array_join("extra", "\n"), F.lit("\n\n"), F.coalesce("context", F.lit("")))
    return generated(top.withColumn("prompt", prompt), "prompt", generate, "content").select("id", "ord", "number", "title", "depth", F.coalesce("content", F.lit("(failed)")).alias("content"))


def written_material(outlines: DataFrame, chunks: DataFrame, embed: Callable[[str], list[float]], generate: Callable[[str], str | None], top_k: int = 50, polish: str = "Polish this document; return all of it.\n\n") -> tuple[DataFrame, DataFrame]:
    """The sections of ``material`` with their sources (file, file_path, score), and (id, document): from outlines (id, text) to polished documents.

    Every top section's title is searched by its vector, by words where ``embed`` fails, and all hits fetched are told.
    The titles, of outlines that people wrote, come to the driver.  Without an answer the unpolished document stands.
    """
    tree = cut(outline.tree_sections(outlines))
    top = tree.filter("parent_ord is null").select("id", "ord", "title").collect()
    vectors, found = {}, []
    for title in sorted({r["title"] for r in top}):
        try:
            vectors[title] = embed(title)
        except Exception:  # whatever the embedding service raises
            hits = keyword_search(chunks, title, top_k).select("source_file", "rowid", "text", "score")
            found.append(hits.select(F.lit(title).alias("title"), "source_file", "text", "score", F.row_number().over(Window.orderBy("rowid")).alias("rank")))  # the few hits fetched
    hits = vector_search_many(chunks, list(vectors.items()), top_k).select(F.col("point").alias("title"), "source_file", "text", "score", "rank")
    for more in found:
        hits = hits.unionByName(more)
    hits = cut(tree.filter("parent_ord is null").select("id", "ord", "title").join(hits, "title"))
    made = cut(material(tree, hits.select("id", "ord", "rank", "text", "source_file"), generate))  # the model is not asked again
    firsts = hits.groupBy("id", "ord", "source_file").agg(F.min_by(F.struct("rank", "score"), "rank").alias("h"))
    source = F.struct(F.col("h.rank").alias("rank"), basename(F.col("source_file")).alias("file"), F.col("source_file").alias("file_path"), F.round("h.score", 3).alias("score"))
    sources = firsts.groupBy("id", "ord").agg(F.transform(F.sort_array(F.collect_list(source)), lambda x: F.struct(x["file"].alias("file"), x["file_path"].alias("file_path"), x["score"].alias("score"))).alias("sources"))
    whole = outline.assemble(made).withColumn("prompt", F.concat(F.lit(polish), "document"))
    polished = generated(whole, "prompt", generate, "polished").select("id", F.coalesce(F.nullif("polished", F.lit("")), "document").alias("document"))
    return made.join(sources, ["id", "ord"], "left"), polished


def templates(named: dict[str, str], prefix: str | None = None) -> dict[str, str]:
    """Outline templates, those whose name starts with ``prefix`` if given."""
    return {k: v for k, v in named.items() if prefix is None or k.startswith(prefix)}
