"""Outlines: lines of text to numbered sections, flat or as a tree, and back to a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.text import clean
from corpusq.settings import OUTLINE_HEADER, OUTLINE_NUMBERED, OUTLINE_WHOLE


def lines(outlines: DataFrame) -> DataFrame:
    """id, pos, line: the lines of (id, text) that are not blank, trimmed."""
    return outlines.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", clean(F.col("line"))).filter("line <> ''")


def flat_sections(outlines: DataFrame) -> DataFrame:
    """id, ord, title, detail: sections in order; lines before the first header are dropped.

    Without any header the text is one section.
    """
    so_far = Window.partitionBy("id").orderBy("pos")  # lines of one outline
    marked = lines(outlines).withColumn("head", F.col("line").rlike(OUTLINE_HEADER)).withColumn("ord", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(so_far))
    found = marked.filter("ord > 0").groupBy("id", "ord").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("detail"))
    none = outlines.join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit(1).cast("long").alias("ord"), F.lit(OUTLINE_WHOLE).alias("title"), clean(F.coalesce("text", F.lit(""))).alias("detail"))
    return found.select("id", F.col("ord").cast("long").alias("ord"), "title", "detail").unionByName(none)


def tree_sections(outlines: DataFrame) -> DataFrame:
    """id, ord, number, title, depth, parent_ord, extra: numbered lines; other lines are ``extra`` of the top section before them.

    A section of depth 2 belongs to the top section before it, a deeper one to the section of depth 2 since then;
    without such it is a top section itself.
    """
    so_far = Window.partitionBy("id").orderBy("pos")
    marked = lines(outlines).withColumn("number", F.regexp_extract("line", OUTLINE_NUMBERED, 1)).withColumn("depth", F.when(F.col("number") != "", F.size(F.split("number", r"\."))).otherwise(0))
    marked = marked.withColumn("ord", F.sum(F.when(F.col("depth") > 0, 1).otherwise(0)).over(so_far))
    # a top section: depth 1, or depth 2 before any top, or deeper without a section of depth 2 since the last top
    walk = F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.struct("ord", "depth"))))
    state = "struct<top:bigint,sub:bigint,out:array<struct<ord:bigint,parent:bigint,top:bigint>>>"

    def step(s: Column, x: Column) -> Column:
        is_sub = (x["depth"] == 2) & s["top"].isNotNull()
        is_leaf = (x["depth"] >= 3) & s["sub"].isNotNull()
        is_top = ~(is_sub | is_leaf)
        parent = F.when(is_sub, s["top"]).when(is_leaf, s["sub"])
        top = F.when(is_top, x["ord"]).otherwise(s["top"])
        sub = F.when(is_top, F.lit(None).cast("bigint")).when(is_sub, x["ord"]).otherwise(s["sub"])
        return F.struct(top.alias("top"), sub.alias("sub"), F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), parent.alias("parent"), top.alias("top")))).alias("out")).cast(state)

    zero = F.struct(F.lit(None).cast("bigint").alias("top"), F.lit(None).cast("bigint").alias("sub"), F.array().cast("array<struct<ord:bigint,parent:bigint,top:bigint>>").alias("out"))
    places = marked.groupBy("id").agg(walk.alias("w")).select("id", F.inline(F.aggregate("w", zero, step)["out"])).select("id", "ord", F.col("parent").alias("parent_ord"), "top")
    extra = (
        marked.filter("depth = 0 and ord > 0").join(places.select("id", "ord", "top"), ["id", "ord"])
        .groupBy("id", F.col("top").alias("ord")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("extra")))
    return (
        marked.filter("depth > 0").select("id", "ord", "number", clean(F.regexp_extract("line", OUTLINE_NUMBERED, 2)).alias("title"), "depth")
        .join(places.drop("top"), ["id", "ord"]).join(extra, ["id", "ord"], "left").withColumn("extra", F.coalesce("extra", F.array().cast("array<string>")))
    )


def section_paths(sections: DataFrame) -> DataFrame:
    """``tree_sections`` with ``path``, the titles from the top section down, and ``top_ord``.

    A chain has three sections at most, so parents are joined twice.
    """
    up = sections.select("id", F.col("ord").alias("parent_ord"), F.col("parent_ord").alias("_grand"), F.col("title").alias("_parent"))
    top = sections.select("id", F.col("ord").alias("_grand"), F.col("title").alias("_top"))
    joined = sections.join(up, ["id", "parent_ord"], "left").join(top, ["id", "_grand"], "left")
    path = F.array_compact(F.array("_top", "_parent", "title"))
    return joined.select(*sections.columns, path.alias("path"), F.coalesce("_grand", "parent_ord", "ord").alias("top_ord"))


def assemble(sections: DataFrame) -> DataFrame:
    """id, document: (id, ord, number, title, depth, content) as one Markdown text; headings at most 6 deep."""
    part = F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.least(F.col("depth") + 1, F.lit(6)).cast("int")), F.lit(" "), "number", F.lit(" "), "title", F.lit("\n\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    parts = sections.withColumn("part", part).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "part"))), lambda x: x["part"]).alias("p"))
    return parts.select("id", F.concat(F.lit("# 审核/核实材料\n\n"), F.array_join("p", "\n")).alias("document"))
