"""Queries pN_... of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, overlap, packing, pages, pairs, pieces, sentences, spans, visible

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of every chunk."""
    return sentences.sentence_units(_table(spark, folder, "chunks"))


@query
def p1_sent_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """sent_range put right."""
    ranges = sentences.sent_ranges(_table(spark, folder, "chunks"))
    return ranges.select("chunk_id", "doc_id", ranges.sent_range[0].alias("sent_first"), ranges.sent_range[1].alias("sent_last"))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes written with other characters than the passage they quote."""
    return visible.disguised_quotes(_table(spark, folder, "verifier_bench"), _table(spark, folder, "chunks"))


@query
def p3_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """chunks.text in one form."""
    return visible.normalised(_table(spark, folder, "chunks"), "chunk_id", "text")


@query
def p3_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """verifier_bench.quote in one form."""
    return visible.normalised(_table(spark, folder, "verifier_bench"), "vid", "quote")


SQL["p3_chunks"] = visible.visible_sql("chunks", "chunk_id", "text")
SQL["p3_quotes"] = visible.visible_sql("verifier_bench", "vid", "quote")


def _least_span(spark: SparkSession, folder: str) -> int:
    row = _table(spark, folder, "size_limits").where("limit_name = 'shared_span'").select("max_size").first()
    return row[0] if row else 240


def _span_records(spark: SparkSession, folder: str) -> DataFrame:
    return spans.records_of(_table(spark, folder, "chunks"), _table(spark, folder, "verifier_bench"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that share a long span with a record of another document."""
    return spans.sharing_records(_span_records(spark, folder), _least_span(spark, folder))


@query
def p4_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each record, how much is shared."""
    return spans.coverage(_span_records(spark, folder), _least_span(spark, folder))


@query
def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of records linked by shared spans."""
    return spans.clusters(_span_records(spark, folder), _least_span(spark, folder))


@query
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of keywords, links or tags instead of sentences."""
    return pages.spam_pages(_table(spark, folder, "documents")).select("doc_id").distinct()


@query
def p9_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every page by what kind of line they stand in."""
    docs = _table(spark, folder, "documents")
    return pages.scored(docs, pages.fit(docs))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Holdout questions that also stand in gold."""
    pairs = overlap.cross_split_pairs(_table(spark, folder, "holdout"), _table(spark, folder, "gold"))
    return pairs.select("qid_a", "qid_b")


@query
def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps with gold by split and source."""
    return overlap.report(_table(spark, folder, "holdout"), _table(spark, folder, "gold"))


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective responses and what is wrong with each."""
    return pairs.defective_pairs(_table(spark, folder, "human_grades")).select("grade_id", "defect").distinct()


@query
def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of the clause tags in each defective response."""
    return pairs.defective_pairs(_table(spark, folder, "human_grades"))


def _piece_limit(spark: SparkSession, folder: str) -> tuple[int, int]:
    row = _table(spark, folder, "size_limits").where("limit_name = 'piece'").select("max_size", "overlap").first()
    return (row[0], row[1]) if row else (1200, 120)


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limit, from their pieces."""
    limit, overlap = _piece_limit(spark, folder)
    return pieces.oversized_pieces(_table(spark, folder, "chunks"), limit, overlap).select("chunk_id").distinct()


@query
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the oversized chunks, with their units in the document."""
    chunks = _table(spark, folder, "chunks")
    limit, overlap = _piece_limit(spark, folder)
    out = pieces.with_document_units(pieces.oversized_pieces(chunks, limit, overlap), sentences.sent_ranges(chunks))
    return out.select("*", out.sent_range[0].alias("unit_first"), out.sent_range[1].alias("unit_last")).drop("sent_range")


SQL["p5_found"] = """
SELECT DISTINCT chunk_id FROM chunks
WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'piece')
"""


def _container_limits(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "size_limits").where("limit_name like 'container%'")


@query
def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return packing.containers(_table(spark, folder, "documents"), _container_limits(spark, folder))


@query
def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Unused room by capacity."""
    return packing.report(p7_containers(spark, folder))


@query
def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


@query
def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by the mix."""
    documents, targets = _table(spark, folder, "documents"), _table(spark, folder, "mix_targets")
    return mixing.report(documents, targets, mixing.mix(documents, targets))
