"""A folder of documents to a corpus of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import chunking
from ..sources import readers, sinks


def ingest(spark: SparkSession, folder: str, out: str, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks and manifest of a folder's documents, written under out and read back; the
    index of the chunks lies beside them."""
    c = (config or Config()).chunk
    docs = readers.text_folder(spark, folder)
    made = chunking.chunks(docs, "doc_id", "text", c.target_tokens, c.overlap_sentences).join(docs.select("doc_id", "title"), "doc_id").withColumnRenamed("title", "doc_title")
    sinks.write_table(made, f"{out}/chunks")
    listed = chunking.manifest(docs, "doc_id", "text", made).join(docs.select("doc_id", "filename", "title"), "doc_id")
    sinks.write_lines(listed, f"{out}/manifest")
    sinks.write_index(spark.read.parquet(f"{out}/chunks"), f"{out}/index")
    return spark.read.parquet(f"{out}/chunks"), spark.read.json(f"{out}/manifest")
