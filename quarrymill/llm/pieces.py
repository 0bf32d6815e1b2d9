"""Splitting oversized items at natural boundaries (problem 5): recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint, and
each half that is still over the limit less the overlap is cut again.  Then each
piece but the first is led by the end of the one before it.  Boundaries are, from
strong to weak: a blank line between units, any end of a unit, a line break, a
blank, any character.  A blank line far from the midpoint gives way to any end of a
unit near it; else a stronger kind is left for a weaker one only where the stretch
has no place of it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentences

#: How far from the midpoint, as a part of the stretch, a boundary counts as near.
NEAR = 0.3


def _nearest(places: list[int], low: int, high: int, middle: int) -> int | None:
    """The place in [low, high] nearest to the middle; of two, the earlier."""
    a, b = bisect_left(places, low), bisect_right(places, high)
    if a >= b:
        return None
    k = bisect_left(places, middle, a, b)
    return min(places[max(a, k - 1) : min(b, k + 1)], key=lambda p: (abs(p - middle), p))


def bisect(length: int, levels: list[list[int]], room: int) -> list[int]:
    """Ascending cuts, 0 and length included, that leave stretches of at most room.

    levels are the places of the boundaries, strong to weak, each sorted; the first are
    taken near the midpoint only, being among the second as well."""
    done, work = [0], [(0, length)]
    while work:
        a, b = work.pop()
        if b - a <= room:
            done.append(b)
            continue
        middle, reach = (a + b) // 2, int((b - a) * NEAR)
        cut = None
        for k, places in enumerate(levels):  # near the midpoint first, then anywhere, before a weaker kind
            cut = _nearest(places, max(a + 1, middle - reach), min(b - 1, middle + reach), middle)
            if cut is None and k:
                cut = _nearest(places, a + 1, b - 1, middle)
            if cut is not None:
                break
        cut = middle if cut is None else cut
        work += [(cut, b), (a, cut)]  # the left part is taken next
    return done


def split(text: str, units: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, each at most limit long and each but
    the first beginning with the last overlap characters of the one before."""
    if len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap, limit - 1))
    ends = [e for _, e in units[:-1]]
    starts = [s for s, _ in units[1:]]
    # a cut lies where the next unit begins, so that blanks stay with the piece before
    strong = [s for e, s in zip(ends, starts, strict=True) if text.count("\n", e, s) > 1]
    lines = [i + 1 for i, c in enumerate(text) if c == "\n"]
    blanks = [i + 1 for i, c in enumerate(text) if c.isspace()]
    cuts = bisect(len(text), [strong, starts, lines, blanks], limit - overlap)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def oversized_pieces(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(chunk_id, doc_id, piece, start, end, char_start, char_end, sent_first,
    sent_last, text) of every chunk whose text is over the limit.

    start and end count in the chunk's text, char_start and char_end in its
    document (null where the chunk's char_start is null); sent_first and
    sent_last are the first and last unit of the text that the piece touches,
    counted from 0 in the chunk.  Every piece is at most ``limit`` long and all
    but the first begin with the last ``overlap`` characters of the one before.

    Null and short texts give nothing; a chunk_id delivered again counts once; a
    text without blanks is cut between characters; texts of any length are cut
    whole; no rows give no rows."""
    schema = T.StructType(
        [
            chunks.schema["chunk_id"], chunks.schema["doc_id"],
            *(T.StructField(c, T.IntegerType()) for c in ("piece", "start", "end", "char_start", "char_end", "sent_first", "sent_last")),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, docs, texts, at = (batch.column(k).to_pylist() for k in range(4))
            counts, s, e = sentences.spans_of(texts)
            ends = np.cumsum(counts)
            rows = []
            for k, text in enumerate(texts):
                spans = list(zip(s[ends[k] - counts[k] : ends[k]].tolist(), e[ends[k] - counts[k] : ends[k]].tolist(), strict=True))
                unit_starts, unit_ends = [a for a, _ in spans], [b for _, b in spans]
                for n, (a, b) in enumerate(split(text, spans, limit, overlap)):
                    first, last = bisect_right(unit_ends, a), bisect_left(unit_starts, b) - 1
                    base = at[k]
                    rows.append((ids[k], docs[k], n, a, b, None if base is None else base + a, None if base is None else base + b, first if first <= last else None, last if first <= last else None, text[a:b]))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            types = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.int32()] * 7, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema.names)

    long = chunks.where(F.length("text") > limit).groupBy("chunk_id").agg(F.first(F.struct("doc_id", "text", "char_start")).alias("c"))
    return long.select("chunk_id", "c.doc_id", "c.text", "c.char_start").mapInArrow(run, schema)


def with_document_units(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pieces with sent_range, the first and last unit in the document.

    ranges holds chunk_id and sent_range, the document units of each chunk."""
    joined = pieces.join(ranges.select("chunk_id", F.col("sent_range").alias("__range")), "chunk_id", "left")
    first = F.col("__range")[0]
    found = F.when(F.col("sent_first").isNotNull() & first.isNotNull(), F.array(first + F.col("sent_first"), first + F.col("sent_last")))
    return joined.withColumn("sent_range", found).drop("__range")
