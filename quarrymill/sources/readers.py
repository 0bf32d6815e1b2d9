"""Sources: document folders, JSON lines, chunk files and stored vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_corpus, title
from ..operators.lineage import checkpointed

CHUNK_SCHEMA = "chunk_id string, doc_id string, doc_title string, text string, char_start int, char_end int, sent_range array<int>"
GOLD_SCHEMA = "qid string, question string, is_answerable boolean, gold_answer string, gold_chunk_ids array<string>, bucket string, note string, split string"
TEXT_KINDS = ("txt", "md")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Windows-1252 where they are not valid UTF-8."""

    @F.pandas_udf("string")
    def western(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("cp1252", "replace"))

    text = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(text, western(F.when(text.isNull(), content)))


def numbered(keys: DataFrame, column: str) -> DataFrame:
    """keys with ``number``, from 1 in the order of the column, which holds no value twice.

    Keys are sorted in ranges; a row's number is its place in its range and what the
    ranges before it hold."""
    parts = checkpointed(keys.repartitionByRange(column).withColumn("__range", F.spark_partition_id()))
    sizes = parts.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = sizes.select("__range", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(column))
    return parts.join(F.broadcast(offsets), "__range").withColumn("number", (place + F.col("__before")).cast("bigint")).drop("__range", "__before")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, filename, title, text) of the text files of a folder, not of its
    subfolders: doc_id is S1, S2 ... by path over the files with text.

    Only files of the known kinds are read, and each is decoded once."""
    kinds = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in k) for k in TEXT_KINDS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", kinds).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    texts = checkpointed(files.select("path", name.alias("filename"), normalise_corpus(decoded(F.col("content"))).alias("text")).where("text <> ''"))
    ids = numbered(texts.select("path"), "path").select("path", F.concat(F.lit("S"), "number").alias("doc_id"))
    return texts.join(ids, "path").select("doc_id", "filename", title(F.col("text"), F.col("filename")).alias("title"), "text")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file with one JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_array(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """Rows of a file that holds one JSON array; no rows where there is no file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


RECORD_SCHEMA = "qid string, bucket string, is_answerable boolean, abstained boolean, gold_chunk_ids array<string>, gold_answer string, predicted_chunk_ids array<string>, answer_text string, context_injected array<string>"


def result_records(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """The records of one variant in a file of evaluation results."""
    fields = ",".join(f"{c.split(' ')[0]}:{c.split(' ')[1]}" for c in RECORD_SCHEMA.split(", "))
    schema = f"variants map<string,struct<records:array<struct<{fields}>>>>"
    whole = spark.read.schema(schema).option("multiLine", True).json(path)
    return whole.select(F.explode(F.element_at("variants", F.lit(variant))["records"]).alias("r")).select("r.*")


def checked_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors (chunk_id, vector), if chunks and vectors have the same ids; else an
    error that the store is out of date."""
    if not chunks.join(vectors, "chunk_id", "left_anti").isEmpty():
        raise RuntimeError("stored vectors are out of date: some chunks have none")
    if not vectors.join(chunks, "chunk_id", "left_anti").isEmpty():
        raise RuntimeError("stored vectors are out of date: some belong to no chunk")
    return vectors


def stored_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Postings and vectors as sinks.write_index wrote them."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vectors")
