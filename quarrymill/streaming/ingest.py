"""The same chunking for documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import Chunking
from ..operators import chunking


def chunk_stream(documents: DataFrame, key: str, text: str, out: str, checkpoint: str, settings: Chunking | None = None) -> StreamingQuery:
    """Chunks of a stream of documents, written to out as they come.

    Each micro-batch runs the batch plan; a batch that is tried again overwrites
    its own folder, so that no chunk comes out twice."""
    s = settings or Chunking()

    def write(batch: DataFrame, number: int) -> None:
        made = chunking.chunks(batch, key, text, s.target_tokens, s.overlap_sentences)
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
