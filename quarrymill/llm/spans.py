"""Long exact spans shared between records (problem 4): paragraph MinHash banding.

A paragraph is any stretch of ``least`` characters of a record, the shortest
span that counts, so that a shared span always holds a whole paragraph however it
lies.  The signature of a paragraph are the least hashes of its shingles under
BANDS x ROWS hash functions, taken by sliding minima over the record; the rows of a
band make its key.  Paragraphs that follow one another mostly keep their minima, so
a record has few different keys.  ``layouts`` measures what share of altered
paragraphs a layout of bands finds, and how many keys it costs; paragraphs that agree
character by character collide under every layout.

Records whose paragraphs collide across documents are candidates.  Each of their
paragraphs is joined to one of another document with the same two 64-bit hashes,
never in pairs within a group, and both are compared as text.  The pairs that hold
link the records; the connected components are the clusters, of which all records
but the least one could be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components as cc

SLICE_CHARS = 400_000
#: Signature of a paragraph: bands, rows of a band, and the part of a paragraph that a shingle takes.
BANDS = 1
ROWS = 2
SHINGLE_PART = 4
#: Runs of colliding paragraphs, of some 50 bytes, up to which they are broadcast to the texts.
BROADCAST_RUNS = 400_000
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _prefix(codes: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums, from which the hash of any stretch follows."""
    base = ODD[which]
    inverse = pow(base, -1, 1 << 64)
    n = len(codes) + 1
    terms = _mix(codes.astype(np.uint64), which + 1) * _powers(inverse, n)[: n - 1]
    return np.append(np.uint64(0), np.cumsum(terms)), _powers(base, n)


def _stretch_hash(sums: np.ndarray, powers: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    return _mix((sums[start + length] - sums[start]) * powers[start], 7)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values (block prefix and suffix minima)."""
    n = len(x)
    pad = -n % w
    full = np.append(x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)).reshape(-1, w)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(lens) - lens, lens


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def signatures(texts: list[str], least: int, bands: int = BANDS, rows: int = ROWS, part: int = SHINGLE_PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, key): the paragraphs that start from first to last in a text
    have this key in one of the bands."""
    k = max(1, least // part)
    w = least - k + 1
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in _slices(texts):
        codes, base, lens = _joined(texts[a:b])
        if len(codes) < least:
            continue
        sums, powers = _prefix(codes, 0)
        shingles = _stretch_hash(sums, powers, np.arange(len(codes) - k + 1), k)
        owner = np.repeat(np.arange(b - a), lens)[: len(codes) - least + 1]
        at = np.flatnonzero(np.arange(len(owner)) + least <= (base + lens)[owner])
        for band in range(bands):
            key = np.full(len(at), 11 + band, np.uint64)
            for row in range(rows):
                key = _mix(key ^ _sliding_min(_mix(shingles, 101 + band * rows + row), w)[at], 13)
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            which = owner[at[first]]
            out.append((which + a, at[first] - base[which], at[last] - base[which], key[first]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def layouts(texts: list[str], least: int, choices: list[tuple[int, int, int]], altered: tuple[int, ...] = (0, 1, 3), seed: int = 3) -> dict[tuple[int, int, int], dict[str, float]]:
    """Of each layout (bands, rows, part): keys for 1,000 characters, and the share of
    paragraphs that still collide after so many of their characters are altered.
    Meant for a bounded sample of texts."""
    rng = np.random.default_rng(seed)
    long_enough = [t for t in texts if len(t) >= least]
    out = {}
    for bands, rows, part in choices:
        figures = {"keys": 1000 * len(signatures(long_enough, least, bands, rows, part)[0]) / max(1, sum(map(len, long_enough)))}
        for n in altered:
            found = 0
            for t in long_enough:
                start = int(rng.integers(len(t) - least + 1))
                one = t[start : start + least]
                other = list(one)
                for i in rng.choice(least, n, replace=False):
                    other[i] = chr(ord(other[i]) + 1)
                which, _, _, key = signatures([one, "".join(other)], least, bands, rows, part)
                found += bool(set(key[which == 0].tolist()) & set(key[which == 1].tolist()))
            figures[f"found_{n}"] = found / max(1, len(long_enough))
        out[bands, rows, part] = figures
    return out


def records_of(chunks: DataFrame, bench: DataFrame) -> DataFrame:
    """(field, rec_id, doc, text) of chunks, quotes and claims.

    The document of a quote or claim is the part of its first citation before
    ``::``.  Null ids, null texts and records without a document are left out:
    of them it can't be said that they share with another document."""
    cited = F.split_part(F.element_at(F.col("citations"), 1), F.lit("::"), F.lit(1))
    first = F.when(F.size("citations") > 0, cited)
    parts = [
        chunks.select(F.lit("chunk").alias("field"), F.col("chunk_id").alias("rec_id"), F.col("doc_id").alias("doc"), "text"),
        bench.select(F.lit("quote").alias("field"), F.col("vid").alias("rec_id"), first.alias("doc"), F.col("quote").alias("text")),
        bench.select(F.lit("claim").alias("field"), F.col("vid").alias("rec_id"), first.alias("doc"), F.col("claim").alias("text")),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.where(F.col("rec_id").isNotNull() & F.col("doc").isNotNull() & F.col("text").isNotNull())


RECORD = ("field", "rec_id", "doc")


def _signed(records: DataFrame, least: int) -> DataFrame:
    """(key, field, rec_id, doc, first, last), one row for each run of paragraphs of one key."""
    schema = T.StructType([T.StructField("key", T.LongType()), *(records.schema[c] for c in RECORD), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, first, last, key = signatures(batch.column(3).to_pylist(), least)
            rows = pa.array(which)
            cols = [pa.array(key.view(np.int64)), *(batch.column(c).take(rows) for c in range(3)), *(pa.array(x.astype(np.int32)) for x in (first, last))]
            yield pa.RecordBatch.from_arrays(cols, ["key", *RECORD, "first", "last"])

    return records.where(F.length("text") >= least).select(*RECORD, "text").mapInArrow(run, schema)


def candidates(records: DataFrame, least: int) -> DataFrame:
    """(field, rec_id, doc, text, runs) of the records with paragraphs that collide with
    those of another document; runs are (first, last) of their starts."""
    signed = _signed(records, least)
    colliding = signed.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key")
    hit = signed.join(colliding, "key", "left_semi").groupBy(*RECORD).agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hit = cc.checkpointed(hit)
    few = hit.agg(F.sum(F.size("runs")).alias("n")).first()[0] or 0
    # few runs are sent to the texts, else both are shuffled; copies of a record are combined
    # only here, where few records are left
    side = F.broadcast(hit) if few <= BROADCAST_RUNS else hit
    return records.select(*RECORD, "text").join(side, [*RECORD]).dropDuplicates([*RECORD, "text"])


def _paragraphs(found: DataFrame, least: int) -> DataFrame:
    """(h1, h2, field, rec_id, doc, start): every paragraph in a colliding run."""
    schema = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), *(found.schema[c] for c in RECORD), T.StructField("start", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes, _, lens = _joined([batch.column(3)[row].as_py()])
                starts = np.unique(np.concatenate([np.arange(r["first"], r["last"] + 1) for r in batch.column(4)[row].as_py()]))
                starts = starts[starts + least <= lens[0]]  # of another text under the same id
                hashes = [pa.array(_stretch_hash(*_prefix(codes, which), starts, least).view(np.int64)) for which in (0, 1)]
                same = pa.array(np.full(len(starts), row))
                yield pa.RecordBatch.from_arrays([*hashes, *(batch.column(c).take(same) for c in range(3)), pa.array(starts.astype(np.int32))], ["h1", "h2", *RECORD, "start"])

    return found.select(*RECORD, "text", "runs").mapInArrow(run, schema)


def shared_spans(records: DataFrame, least: int) -> DataFrame:
    """(field, rec_id, doc, starts, with_field, with_rec_id, with_doc): the starts of the
    paragraphs of exactly ``least`` characters that a record shares with one of another
    document, compared as text.  Every shared paragraph is in one row, with one partner.

    Records shorter than that, empty or null share nothing.  Copies of a record
    under one id count once; ties and hot passages are combined before they are
    shuffled, and no pairs are formed within a group."""
    found = cc.checkpointed(candidates(records, least))
    paragraphs = _paragraphs(found, least)
    place = F.struct("doc", "field", "rec_id", "start")
    groups = paragraphs.groupBy("h1", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo.doc <> hi.doc")
    joined = paragraphs.join(groups, ["h1", "h2"]).withColumn("with", F.when(F.col("doc") != F.col("lo.doc"), F.col("lo")).otherwise(F.col("hi")))
    partner = ["with_field", "with_rec_id", "with_doc"]
    lined = joined.select(*RECORD, "start", *(F.col(f"with.{c}").alias(f"with_{c}") for c in RECORD), (F.col("start") - F.col("with.start")).alias("ahead"))
    runs = lined.groupBy(*RECORD, *partner, "ahead").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    texts = found.select(*RECORD, "text")
    both = runs.join(texts, [*RECORD]).join(texts.select(*(F.col(c).alias(f"with_{c}") for c in RECORD), F.col("text").alias("with_text")), partner)
    columns = [*RECORD, "starts", *partner]
    schema = both.select(*columns).schema

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, held = [], []
            for row, (starts, ahead, one, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("starts", "ahead", "text", "with_text")), strict=True)):
                same = [s for s in starts if s >= ahead and s + least <= len(one) and one[s : s + least] == other[s - ahead : s - ahead + least]]
                if same:
                    kept.append(row)
                    held.append(same)
            rows = pa.array(kept, pa.int64())
            cols = [pa.array(held, pa.list_(pa.int32())) if c == "starts" else batch.column(c).take(rows) for c in columns]
            yield pa.RecordBatch.from_arrays(cols, columns)

    return both.mapInArrow(verified, schema)


def clusters(records: DataFrame, least: int) -> DataFrame:
    """(field, rec_id, cluster, removed) of the records that share spans, directly or
    through others; cluster is the least member, the one that would be kept."""
    node = lambda prefix: F.concat_ws("/", f"{prefix}field", f"{prefix}rec_id")
    edges = shared_spans(records, least).select(node("").alias("a"), node("with_").alias("b")).distinct()
    found = cc.components(edges)
    return found.select(
        F.split_part("node", F.lit("/"), F.lit(1)).alias("field"), F.expr("substring(node, instr(node, '/') + 1)").alias("rec_id"), F.col("component").alias("cluster"), (F.col("node") != F.col("component")).alias("removed")
    )


def sharing_records(records: DataFrame, least: int) -> DataFrame:
    """(field, rec_id) of the records that share a span: the members of the clusters."""
    return clusters(records, least).select("field", "rec_id")


def coverage(records: DataFrame, least: int) -> DataFrame:
    """(field, rec_id, n_chars, shared_chars, shared_part) of every record.

    shared_chars counts the characters inside spans shared with other documents,
    each once; it is 0 for a record that shares nothing."""
    starts = shared_spans(records, least).groupBy("field", "rec_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))
    # each paragraph adds what reaches beyond the one before it
    others = F.size("starts") - 1
    steps = F.zip_with(F.slice("starts", F.lit(2), others), F.slice("starts", F.lit(1), others), lambda b, a: F.least(b - a, F.lit(least)))
    total = F.aggregate(steps, F.lit(least), lambda s, x: s + x)
    shared = starts.select("field", "rec_id", total.alias("shared_chars"))
    sizes = records.groupBy("field", "rec_id").agg(F.max(F.length("text")).alias("n_chars"))
    joined = sizes.join(shared, ["field", "rec_id"], "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    part = F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0))
    return joined.select("field", "rec_id", "n_chars", "shared_chars", F.round(part, 6).alias("shared_part"))
