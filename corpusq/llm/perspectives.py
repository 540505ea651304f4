"""Chat formatting: multi-party dialogues from every participant's side (native).

For each participant of a conversation the dialogue is rendered with that
speaker as assistant and all others as named users; the mask lists the
character spans of the assistant's words, end marks included, which alone are trained on.
System turns are instructions: they stay system turns in every rendering and their
speaker takes no part.

A conversation may hold any share of the rows, so a rendering comes in slices of
``PART_TURNS`` turns, in order: put together they are the whole rendering of the whole dialogue,
and masks and ``start`` count from its beginning.  Conversations of fewer turns have one
slice; ``whole`` puts slices together.  Turns are numbered by running totals over ranges of
(conversation, turn), not in one task, a group that is collected is never larger than a
slice, and the slices of a long conversation meet its speakers in several parts.

Defined cases: null text is an empty message; turns are in order of turn, then speaker, then text,
nulls first, so equal turns are both kept; a null speaker is the speaker ``unknown``; a
null conversation id is a conversation of its own; a conversation of system turns only has no
rendering; ``<|`` in names and texts is written ``< |`` so that no text can forge a mark; empty input gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.common import cut, running_total, table

PART_TURNS = 256
SYSTEM = "system"
START, END = "<|start|>", "<|end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(speaker: Column | str) -> Column:
    return F.concat(F.lit("user name="), _plain(F.col(speaker) if isinstance(speaker, str) else speaker))


def _head(who: Column) -> Column:
    return F.concat(F.lit(START), who, F.lit("\n"))


def _body(text: Column) -> Column:
    return F.concat(_plain(text), F.lit(END))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, part, n_turns, start, rendered, masks.

    ``turns`` has conv_id, turn, speaker and text.  ``rendered`` is the slice ``part`` of
    the whole rendering and begins at character ``start`` of it; ``masks`` are (start,
    end) in the whole rendering, end exclusive.
    """
    speaker = F.coalesce("speaker", F.lit("unknown"))
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("one"), F.monotonically_increasing_id().alias("row"))
    # row only tells equal turns apart
    numbered = running_total(said, ["conv_id"], ["turn", "speaker", "text", "row"], "one", "upto").withColumn("part", F.floor((F.col("upto") - 1) / PART_TURNS))
    # characters of a turn that is not the perspective's own
    length = F.length(F.concat(_head(F.when(F.col("speaker") == SYSTEM, "system").otherwise(_name("speaker"))), _body(F.col("text"))))
    turns_ = F.sort_array(F.collect_list(F.struct("turn", "speaker", "text")))
    parts = cut(numbered.groupBy("conv_id", "part").agg(turns_.alias("turns"), F.sum(length).alias("chars")))
    # places are worked out without the texts
    placed = running_total(parts.select("conv_id", "part", "chars", F.transform("turns", lambda t: t["speaker"]).alias("speakers")), ["conv_id"], ["part"], "chars", "upto")
    people = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    # the slices of one conversation and its speakers meet in parts of 16 slices
    slices = parts.groupBy(F.col("conv_id").alias("_c")).agg(F.ceil(F.count("*") / 16).cast("int").alias("_parts"))
    people = people.join(slices, F.col("_conv").eqNullSafe(F.col("_c"))).select("_conv", "perspective", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_at"))
    views = (
        placed.withColumn("_slice", F.floor(F.col("part") / 16).cast("int")).join(people, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_slice") == F.col("_at")))
        .select("conv_id", "perspective", "part", (F.col("upto") - F.col("chars")).alias("before"), F.size(F.filter("speakers", lambda x: x == F.col("perspective"))).alias("own"))
    )
    views = running_total(views, ["conv_id", "perspective"], ["part"], "own", "own_upto").withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    views = parts.join(views, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    # an own turn says "assistant" in place of the name
    saved = F.length(_name("perspective")) - F.length(F.lit("assistant"))

    def message(t: Column) -> Column:
        who = F.when(t["speaker"] == SYSTEM, F.lit("system")).when(t["speaker"] == F.col("perspective"), F.lit("assistant")).otherwise(_name(t["speaker"]))
        return F.struct(_head(who).alias("head"), _body(t["text"]).alias("body"), (t["speaker"] == F.col("perspective")).alias("own"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        return F.struct(end.alias("at"), F.when(m["own"], F.concat(acc["masks"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["masks"]).alias("masks"))

    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("masks"))
    return (
        views.select("conv_id", "perspective", "part", F.size("turns").alias("n_turns"), (F.col("before") - (F.col("own_upto") - F.col("own")) * saved).alias("start"), F.transform("turns", message).alias("m"))
        .select(
            "conv_id", "perspective", "part", "n_turns", "start",
            F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["body"])), "").alias("rendered"),
            F.aggregate("m", zero, step)["masks"].alias("masks"),
        )
    )


def whole(views: DataFrame) -> DataFrame:
    """conv_id, perspective, rendered, masks: slices put together, for dialogues that fit one row."""
    slices = F.sort_array(F.collect_list(F.struct("part", "rendered", "masks")))
    return views.groupBy("conv_id", "perspective").agg(slices.alias("s")).select(
        "conv_id", "perspective", F.array_join(F.transform("s", lambda s: s["rendered"]), "").alias("rendered"), F.flatten(F.transform("s", lambda s: s["masks"])).alias("masks"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = perspectives(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text"))
    spans = F.array_join(F.transform("masks", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return got.select("conv_id", "perspective", F.col("part").cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "start", "rendered", spans.alias("masks"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS nth
  FROM conversations
), people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
m AS (
  SELECT t.conv_id, perspective, (nth - 1) // 256 AS part, nth, speaker = perspective AS own,
         '<|start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || replace(speaker, '<|', '< |') END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin, begin + length(head) AS start
  FROM m
)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, min(begin) AS start, string_agg(head || body, '' ORDER BY nth) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN start || ':' || (start + length(body)) END, ',' ORDER BY nth), '') AS masks
FROM placed GROUP BY conv_id, perspective, part
"""
