"""Dense and lexical top-k, rank fusion and reranking, for batches of questions.

Questions are rows (qid, question), passages rows (chunk_id, text).  Rankings
are rows (qid, chunk_id, score, rank) with rank from 1; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import search_terms, sigmoid
from .search import B, BLOCK, DIGITS, DIMENSIONS, EPSILON, K1, PART, best_places, search  # noqa: F401

def top(scored: DataFrame, k: int, key: str = "qid", item: str = "chunk_id", *ties: str) -> DataFrame:
    """The k best rows of each key by score, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), *ties, item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def term_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """The distinct terms of a text hashed into a vector of length 1; zeros without terms.

    The encoder used where no trained one is given."""
    places = F.transform(F.array_distinct(search_terms(text)), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimensions)
    counts = F.aggregate(places, F.array_repeat(F.lit(0.0), dimensions), lambda acc, p: F.transform(acc, lambda c, i: F.when(i == p, c + 1.0).otherwise(c)))
    # in one-element arrays each step is worked out once
    length = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.get(F.transform(length, lambda r: F.transform(r["v"], lambda c: F.coalesce(F.try_divide(c, r["n"]), F.lit(0.0)))), F.lit(0))


def dense_top(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, part: int = 16384, digits: int = DIGITS) -> DataFrame:
    """(qid, chunk_id, score, rank): the k vectors with the largest dot product.

    queries: (qid, vector); vectors: (chunk_id, vector).  Both sides are hashed
    into blocks of bounded size; each pair of blocks is one matrix product in one
    task, which keeps its own k best, so that only those are shuffled and ranked.
    Scores are held to ``digits`` decimals before they are ranked.  A vector is not its
    own neighbour.  Null vectors are left out."""
    q, v = queries.where(F.col("vector").isNotNull()), vectors.where(F.col("vector").isNotNull())
    n_blocks, n_parts = max(1, -(-q.count() // block)), max(1, -(-v.count() // part))
    left = q.select(F.col("qid").cast("string").alias("qid"), "vector", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("p"))
    right = v.select(F.col("chunk_id").cast("string").alias("chunk_id"), "vector", F.pmod(F.xxhash64("chunk_id"), F.lit(n_parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("b"))

    def product(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
        if a.empty or z.empty:
            return pd.DataFrame({"qid": [], "chunk_id": [], "score": []})
        ids = z["chunk_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], np.stack(z["vector"].to_numpy()).astype(float)[order]
        scores = np.round(np.stack(a["vector"].to_numpy()).astype(float) @ matrix.T, digits)
        out = []
        for qid, row in zip(a["qid"], scores, strict=True):
            row = np.where(ids == qid, -np.inf, row)
            best = best_places(row, k)
            best = best[np.isfinite(row[best])]
            out.append(pd.DataFrame({"qid": qid, "chunk_id": ids[best], "score": row[best]}))
        return pd.concat(out, ignore_index=True)

    near = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInPandas(product, "qid string, chunk_id string, score double")
    return top(near, k)


def postings(passages: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf): the inverted index; dl counts the terms of the passage."""
    terms = passages.select("chunk_id", search_terms(F.col("text")).alias("terms"))
    return terms.select("chunk_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("chunk_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25_top(questions: DataFrame, passages: DataFrame, k: int, block: int = BLOCK, part: int = PART) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best passages by BM25.

    A question word counts as often as it is asked.  Questions with fewer than k
    passages that share a word are filled up with passages of score 0."""
    return search(questions, passages, 0, k, block, part).select("qid", "chunk_id", "score", "rank")


def fuse(dense: DataFrame, lexical: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(qid, chunk_id, score, rank): sums of 1 / (rrf_k + rank).

    Ties go to the better dense rank, then to the better lexical one.  If both rankings
    have the column overlap, it is kept."""
    kept = ["overlap"] if "overlap" in dense.columns and "overlap" in lexical.columns else []
    one = dense.select("qid", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank"), *kept)
    two = lexical.select("qid", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("lexical_rank"), *kept)
    # all rows of a question in one place, for every stage up to reranking
    both = one.unionByName(two).repartition("qid").groupBy("qid", "chunk_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank"), *[F.max(c).alias(c) for c in kept])
    gain = lambda c: F.coalesce(1 / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(gain("dense_rank") + gain("lexical_rank"), 12))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


Scorer = Callable[[Column, Column], Column]


def rerank(fused: DataFrame, questions: DataFrame, passages: DataFrame, final_k: int, scorer: Scorer | None = None, enabled: bool = True) -> DataFrame:
    """(qid, chunk_id, score, rank): the final_k best of the fused ranking.

    scorer takes the question and the passage; by default it is the share of the
    question's words in the passage, which is read from the column overlap of the
    fused ranking where it has one.  If any score of a question lies outside
    [0, 1], all of them become sigmoids.  Switched off, the first final_k score 1."""
    if not enabled:
        return fused.where(F.col("rank") <= final_k).select("qid", "chunk_id", F.lit(1.0).alias("score"), "rank")
    ranked = fused.select("qid", "chunk_id", F.col("rank").alias("fused_rank"))
    if scorer is None and "overlap" in fused.columns:  # both sides were at hand in the search
        pairs, score = fused.select("qid", "chunk_id", F.col("rank").alias("fused_rank"), "overlap"), F.col("overlap")
    elif scorer is None:  # the words of a text are taken once, not for each pair
        terms = lambda df, key, text, name: df.select(key, F.array_distinct(search_terms(F.col(text))).alias(name))
        pairs = ranked.join(terms(questions, "qid", "question", "asked"), "qid").join(terms(passages, "chunk_id", "text", "held"), "chunk_id")
        score = F.size(F.array_intersect("asked", "held")) / F.greatest(F.size("asked"), F.lit(1))
    else:
        pairs = ranked.join(questions.select("qid", "question"), "qid").join(passages.select("chunk_id", "text"), "chunk_id")
        score = scorer(F.col("question"), F.col("text")).cast("double")
    raw = pairs.select("qid", "chunk_id", "fused_rank", score.alias("raw"))
    whole = Window.partitionBy("qid")
    outside = (F.min("raw").over(whole) < 0) | (F.max("raw").over(whole) > 1)
    scored = raw.select("qid", "chunk_id", "fused_rank", F.round(F.when(outside, sigmoid(F.col("raw"))).otherwise(F.col("raw")), DIGITS).alias("score"))
    return top(scored, final_k, "qid", "fused_rank").select("qid", "chunk_id", "score", "rank")


def anatomy(dense: DataFrame, lexical: DataFrame, fused: DataFrame, reranked: DataFrame) -> DataFrame:
    """(qid, chunk_id, dense_rank, lexical_rank, fused_rank, final_rank) of every passage any stage named."""
    stages = {"dense_rank": dense, "lexical_rank": lexical, "fused_rank": fused, "final_rank": reranked}
    rows = [df.select("qid", "chunk_id", *[(F.col("rank") if n == name else F.lit(None)).cast("int").alias(n) for n in stages]) for name, df in stages.items()]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return out.groupBy("qid", "chunk_id").agg(*[F.min(n).alias(n) for n in stages])
