"""The chunk table made of ``documents`` and ``embeddings``, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusq.functions.text import file_type

_EXT = {"en": ".pdf", "fr": ".docx", "de": ".xlsx", "es": ".pptx"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, constant_ext: str | None = None, with_vector: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ext = F.lit(constant_ext) if constant_ext else F.when(F.col("lang") == "en", ".pdf").when(F.col("lang") == "fr", ".docx").when(F.col("lang") == "de", ".xlsx").when(F.col("lang") == "es", ".pptx")
    in_file = Window.partitionBy("source_file")
    out = (
        docs.select(F.col("doc_id").alias("rowid"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.concat(F.lit("/kb/"), "lang", F.lit("/"), "source", ext).alias("source_file"))
        .withColumn("file_type", file_type(F.col("source_file")))
        .withColumn("chunk_index", (F.row_number().over(in_file.orderBy("rowid")) - 1).cast("long"))
        .withColumn("total_chunks", F.count("*").over(in_file))
    )
    if not with_vector:
        return out
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    return out.join(vectors, F.col("rowid") == F.col("_v"), "left").drop("_v")


def chunks_sql(constant_ext: str | None = None) -> str:
    """SQL of the same table, as the body of a WITH entry."""
    ext = f"'{constant_ext}'" if constant_ext else "CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.docx' WHEN 'de' THEN '.xlsx' WHEN 'es' THEN '.pptx' END"
    kind = "'text'" if constant_ext else "CASE lang WHEN 'en' THEN 'pdf' WHEN 'fr' THEN 'word' WHEN 'de' THEN 'excel' WHEN 'es' THEN 'ppt' END"
    return f"""SELECT doc_id AS rowid, CAST(doc_id AS VARCHAR) AS chunk_id, text, '/kb/' || lang || '/' || source || {ext} AS source_file, {kind} AS file_type,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY lang, source) AS total_chunks, embedding AS vector
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""


#: SQL of ``functions.text.padded`` of a column.
PADDED_SQL = r"' ' || array_to_string(regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"
