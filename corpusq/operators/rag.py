"""Answering with sources: files named in a query, numbered sources, context, history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import basename, parent_name, place_label, stem
from corpusq.settings import HISTORY_TURNS

MAX_TARGETS = 10
GRAM = 6
#: What a source without file is called, and the start of its key.
UNKNOWN = "（来源未知）"
ORPHAN = "__orphan__"
#: Fixed value: the answer where the model gives none.
FAILED = "API 调用失败，请检查网络连接和 API 密钥。"
WITH_CONTEXT = "Answer from the numbered references below. Put the number of its reference after each fact, use no other numbers, and say so where the references do not tell.\n\n"
WITHOUT_CONTEXT = "Answer the question in view of the conversation."
LEGEND = "\n\nIn the last answer the numbers stood for:\n"
LEGEND_ENDS = "\nThey hold for the conversation so far; cite by the numbers of the references above."


def filename_targets(files: DataFrame, query: str) -> DataFrame:
    """source_file, ord: files whose name the query contains.

    A file matches by its whole stem of 6 or more characters, or by any 6
    characters of its name in a row.  In order of path, files that match by pieces alone
    count only while fewer than 10 are found.
    """
    q = F.lit(query.lower())
    name = F.lower(basename(F.col("source_file")))
    exact = (F.length(F.lower(stem(F.col("source_file")))) >= GRAM) & F.contains(q, F.lower(stem(F.col("source_file"))))
    pieces = F.when(F.length(name) >= GRAM, F.exists(F.transform(F.sequence(F.lit(1), F.length(name) - (GRAM - 1)), lambda i: F.substring(name, i, F.lit(GRAM))), lambda g: F.contains(q, g))).otherwise(False)
    found = files.select("source_file").distinct().withColumn("exact", exact).filter(F.col("exact") | pieces)
    by_path = Window.orderBy("source_file")  # over the files that the query names
    # files found before this one: the first ten in all, and then exact ones only
    return found.withColumn("ord", F.row_number().over(by_path)).filter(F.col("exact") | (F.col("ord") <= MAX_TARGETS)).select("source_file", "ord")


def targeted_injection(hits: DataFrame, chunks: DataFrame, targets: DataFrame, per_file: int = 5) -> DataFrame:
    """``hits`` and chunks spread over every target file (score 5, ``targeted``); best first.

    A file's chunks at every third of it are gone through in order; those not among the hits are added, until the file
    has ``per_file`` hits, which is looked at after each chunk: so the first one is always added.
    """
    in_file = Window.partitionBy("source_file").orderBy("chunk_index", "rowid")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy("source_file")) / 3))
    picked = (
        chunks.join(targets.select("source_file"), "source_file", "left_semi")
        .withColumn("nth", F.row_number().over(in_file) - 1).withColumn("step", step).filter(F.col("nth") % F.col("step") == 0)
    )
    have = hits.groupBy("source_file").agg(F.count("*").alias("have"))
    known = hits.select("rowid", F.lit(1).alias("known"))
    gone_through = picked.join(known, "rowid", "left").join(have, "source_file", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    earlier = Window.partitionBy("source_file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).over(earlier), F.lit(0))
    taken = gone_through.withColumn("before", before).filter(F.col("known").isNull() & ((F.col("nth") == 0) | (F.col("have") + F.col("before") < per_file)))
    names = [c for c in hits.columns if c in chunks.columns]
    added = taken.select(*names, F.lit(5.0).alias("score"), F.lit("targeted").alias("match_type"))
    return hits.select(*names, "score", "match_type").unionByName(added).orderBy(F.desc("score"), "rowid")


def _shown(path: Column, many: Column) -> Column:
    parent = parent_name(path)
    return F.when(path == "", F.lit(UNKNOWN)).when(many & (parent != ""), F.concat(parent, F.lit("/"), basename(path))).otherwise(basename(path))


def _source_key(id_col: str) -> Column:
    """A hit's file; a hit without file is a source of its own."""
    path = F.coalesce("source_file", F.lit(""))
    return F.when(path == "", F.concat(F.lit(ORPHAN), F.col(id_col).cast("string"))).otherwise(path)


def numbered_sources(hits: DataFrame, rank: str = "rank", id_col: str = "rowid") -> DataFrame:
    """number, file, file_path, snippet, score, source: one row a file or hit without file, by lower-cased name and path.

    Files of one name show their folder too; hits without file come first.  Snippet (200 characters) and score (3
    places) are of the source's first hit; ``source`` is what ``context`` joins on.
    """
    first = hits.groupBy(_source_key(id_col).alias("source")).agg(F.min_by(F.struct("text", "score"), rank).alias("hit"))
    path = F.when(F.col("source").startswith(ORPHAN), "").otherwise(F.col("source"))
    same_name = Window.partitionBy(basename(F.col("file_path")))
    order = Window.orderBy(F.lower(basename(F.col("file_path"))), F.lower("source"), "source")  # one row a source of the hits
    return first.withColumn("file_path", path).withColumn("many", F.count("*").over(same_name) > 1).select(
        F.row_number().over(order).cast("long").alias("number"), _shown(F.col("file_path"), F.col("many")).alias("file"), "file_path",
        F.substring("hit.text", 1, 200).alias("snippet"), F.round("hit.score", 3).alias("score"), "source")


def context(hits: DataFrame, sources: DataFrame, rank: str = "rank", page: str | None = None, chars: int = 3000, id_col: str = "rowid") -> DataFrame:
    """context: one row, the hits by source number and rank, each headed by its number, file and place."""
    p = F.col(page) if page else F.lit(None).cast("int")
    part = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] (Source: "), "file", place_label(p, F.col("chunk_index"), F.col("total_chunks")), F.lit(")\n"), F.substring("text", 1, chars))
    parts = hits.withColumn("source", _source_key(id_col)).join(sources.select("number", "file", "source"), "source").select("number", rank, part.alias("part"))
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", rank, "part"))), lambda x: x["part"]), "\n\n").alias("context"))


def recent_history(turns: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """Of each session's last n turns those of user and assistant, in order."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return turns.withColumn("_n", F.row_number().over(newest)).filter((F.col("_n") <= n) & F.col("role").isin("user", "assistant")).drop("_n").orderBy("session_id", "id")


def annotate_citations(content: Column, names: Column) -> Column:
    """``[n]`` becomes ``[n](指上轮「name」)`` where the map ``names`` (int to string) has n."""
    marks = F.regexp_extract_all(content, F.lit(r"(\[\d+\])"), F.lit(1))
    between = F.split(content, r"\[\d+\]")

    def shown(x: Column) -> Column:
        name = F.try_element_at(names, F.regexp_extract(x, r"^\[(\d+)\]$", 1).try_cast("int"))
        return F.when(name.isNotNull(), F.concat(x, F.lit("(指上轮「"), name, F.lit("」)"))).otherwise(x)

    return F.when(content.rlike(r"\[\d+\]"), F.array_join(F.zip_with(between, marks, lambda t, m: F.concat(t, F.coalesce(shown(m), F.lit("")))), "")).otherwise(content)


def last_sources(turns: DataFrame) -> DataFrame:
    """session_id, names: number to file name of the newest assistant turn that has sources."""
    given = turns.filter((F.col("role") == "assistant") & (F.size("sources") > 0))
    newest = given.groupBy("session_id").agg(F.max_by("sources", "id").alias("sources"))
    name = lambda s: basename(F.coalesce(F.nullif(s["file"], F.lit("")), s["file_path"]))
    return newest.select("session_id", F.map_from_arrays(F.sequence(F.lit(1), F.size("sources")), F.transform("sources", name)).alias("names"))


def prompt_messages(history: DataFrame, names: DataFrame, system: str, query: str) -> DataFrame:
    """session_id, messages: system, annotated history and the query, as (role, content)."""
    told = history.join(names, "session_id", "left").withColumn("content", F.when((F.col("role") == "user") & F.col("names").isNotNull(), annotate_citations(F.col("content"), F.col("names"))).otherwise(F.col("content")))
    turns = told.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "role", "content"))).alias("t"))
    one = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")))
    return turns.select("session_id", F.concat(one("system", system), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))), one("user", query)).alias("messages"))


def legend(names: Column) -> Column:
    """What the numbers of the last answer's sources stood for, as a part of the instructions; nothing without any."""
    listed = F.transform(F.array_sort(F.map_keys(names)), lambda n: F.concat(F.lit("  ["), n.cast("string"), F.lit("] → "), F.coalesce(F.element_at(names, n), F.lit(""))))
    told = F.concat(F.lit(LEGEND), F.array_join(listed, "\n"), F.lit(LEGEND_ENDS))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, told).otherwise("")


def conversations(questions: DataFrame, turns: DataFrame | None = None, n: int = HISTORY_TURNS) -> DataFrame:
    """session_id, messages: for each question (session_id, query, context) what a model is told, as (role, content).

    Instructions with the context, or those without, and the legend of the session's last sources; its last n turns, the
    citations of the user's explained by the same names; the question.
    """
    head = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(WITH_CONTEXT), F.col("context"))).otherwise(WITHOUT_CONTEXT)
    names_of, told = None, None
    if turns is not None:
        asked = turns.join(questions.select("session_id").distinct(), "session_id", "left_semi")
        names_of = last_sources(asked) if "sources" in turns.columns else None
        said = recent_history(asked, n)
        if names_of is not None:
            said = said.join(names_of, "session_id", "left").withColumn("content", F.when((F.col("role") == "user") & F.col("names").isNotNull(), annotate_citations(F.col("content"), F.col("names"))).otherwise(F.col("content")))
        told = said.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("id", "role", "content"))).alias("t"))  # n turns at most
    q = questions if told is None else questions.join(told, "session_id", "left")
    q = q if names_of is None else q.join(names_of, "session_id", "left")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    history = F.array() if told is None else F.coalesce(F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["content"], F.lit("")).alias("content"))), F.array())
    system = head if names_of is None else F.concat(head, legend(F.col("names")))
    kind = "array<struct<role:string,content:string>>"
    return q.select("session_id", F.concat(F.array(message("system", system)).cast(kind), history.cast(kind), F.array(message("user", F.col("query"))).cast(kind)).alias("messages"))


def answers(told: DataFrame, generate: Callable[[str], str | None]) -> DataFrame:
    """``conversations`` with ``answer``: the model gets the messages as JSON; where it gives nothing the answer says that it failed."""
    from corpusq.operators.analysis import generated

    asked = generated(told.withColumn("_prompt", F.to_json("messages")), "_prompt", generate)
    return asked.withColumn("answer", F.coalesce(F.nullif("answer", F.lit("")), F.lit(FAILED))).drop("_prompt")


def answer(hits: DataFrame, query: str, generate: Callable[[str], str | None], rank: str = "rank", given_context: str | None = None) -> dict:
    """Answer and sources, as an application wants them; ``generate`` is the model."""
    sources = numbered_sources(hits, rank)
    text = given_context or context(hits, sources, rank).first()["context"]
    reply = generate(f"{text}\n\n{query}" if text else query)
    return {"answer": reply or FAILED, "sources": [r.asDict() for r in sources.drop("source").orderBy("number").collect()]}


def ask(chunks: DataFrame, query: str, embed: Callable[[str], list[float]], generate: Callable[[str], str | None], top_k: int = 50, turns: DataFrame | None = None, session_id=None, given_context: str | None = None) -> dict:
    """A question from search to answer: hybrid search (keywords alone if ``embed`` fails), files that the query names,
    numbered sources, and a model told of them as ``conversations`` says.  answer and sources.
    """
    from corpusq.operators import search

    try:
        hits = search.hybrid_search(chunks, query, embed(query), top_k)
    except Exception:  # whatever the embedding service raises
        hits = search.keyword_search(chunks, query, top_k)
    hits = targeted_injection(hits, chunks, filename_targets(chunks, query))
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rowid")))  # a few times top_k rows
    sources = numbered_sources(ranked)
    about = F.lit(given_context) if given_context else F.col("context")
    key = F.lit(session_id) if turns is None else F.lit(session_id).cast(turns.schema["session_id"].dataType)
    question = context(ranked, sources).select(key.alias("session_id"), F.lit(query).alias("query"), about.alias("context"))
    row = answers(conversations(question, turns), generate).first()
    return {"answer": row["answer"], "sources": [r.asDict() for r in sources.drop("source").orderBy("number").collect()]}
