"""Sinks: tables and indexes as Parquet, line files, results and traces as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.answers import upsert_cache
from ..operators.lineage import checkpointed

#: Folders that traces are spread over.
TRACE_FOLDERS = 64


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """df as Parquet in place of what lay there."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """df as JSON, one object a line."""
    df.write.mode("overwrite").json(path)


def write_index(passages: DataFrame, path: str) -> bool:
    """Postings (chunk_id, dl, term, tf) and hashed term vectors (chunk_id, vector) of the
    passages.  Without passages nothing is written and an old index stays."""
    if passages.isEmpty():
        return False
    write_table(retrieval.postings(passages), f"{path}/postings")
    write_table(passages.select("chunk_id", retrieval.term_vector(F.col("text")).alias("vector")), f"{path}/vectors")
    return True


def results_name(questions: str) -> str:
    """Name of the results of a set of questions: the plain one for the set named gold."""
    return "ablation_results" if questions == "gold" else f"ablation_results_{questions}"


def write_results(report: DataFrame, records: DataFrame, folder: str, questions: str = "gold") -> str:
    """Measures and records of the variants, under the name of the set of questions."""
    path = f"{folder}/{results_name(questions)}"
    write_lines(report, f"{path}/measures")
    write_lines(records, f"{path}/records")
    return path


def write_cache(cache: DataFrame | None, new: DataFrame, path: str) -> None:
    """The prompt cache (key, reply, written_at) with newer replies in place of older
    ones.  It is worked out in full before the old one is replaced."""
    write_table(checkpointed(new if cache is None else upsert_cache(cache, new)), path)


def write_traces(traces: DataFrame, path: str) -> None:
    """Traces (stem, trace) as JSON lines, spread over a set number of folders."""
    spread = F.format_string("%02d", F.pmod(F.xxhash64("stem"), F.lit(TRACE_FOLDERS)))
    traces.select("stem", "trace", spread.alias("part")).write.mode("overwrite").partitionBy("part").json(path)
