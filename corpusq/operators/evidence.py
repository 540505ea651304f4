"""Evidence matrix: audit points against files, by hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(hits: DataFrame) -> DataFrame:
    """point, source_file, score, chunks: best score of a file for a point, 0 at least, and its hits."""
    return hits.groupBy("point", "source_file").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.count("*").alias("chunks"))


def matrix(file_scores: DataFrame, points: DataFrame, files: DataFrame) -> DataFrame:
    """source_file, topics (point, score, chunks of every point in order), max_score; best files first.

    ``points`` has point and ord; both sides of the cross product are small lists by nature: audit
    points and files that were asked for.
    """
    grid = files.select("source_file").distinct().join(points, how="cross")
    filled = grid.join(file_scores, ["point", "source_file"], "left").select("source_file", "ord", "point", F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return (
        filled.groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("ord", "point", "score", "chunks"))).alias("topics"), F.max("score").alias("max_score"))
        .orderBy(F.desc("max_score"), "source_file")
    )


def coverage(file_scores: DataFrame, points: DataFrame, n_files: int) -> DataFrame:
    """point, files, total_files, avg_score, max_score: how well each point is covered; zeros without hits."""
    per = file_scores.groupBy("point").agg(F.count("*").alias("files"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"))
    return points.select("point").join(per, "point", "left").select(
        "point", F.coalesce("files", F.lit(0)).alias("files"), F.lit(n_files).cast("long").alias("total_files"),
        F.round(F.coalesce("avg_score", F.lit(0.0)), 4).alias("avg_score"), F.round(F.coalesce("max_score", F.lit(0.0)), 4).alias("max_score"))
