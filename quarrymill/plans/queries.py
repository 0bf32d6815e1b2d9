"""Registered queries over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as fn
from ..operators import answers, chunking, metrics, retrieval
from ..operators.lineage import checkpointed, stored
from ..sources.tables import table
from . import flow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Searches ask every row whose number is divisible by this.
EVERY = 100
W, L = fn.WHITE, fn.LINE_END


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- shared inputs -------------------------------------------------------


def passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk once, as last delivered."""
    some = table(spark, folder, "chunks").where("text is not null").select("chunk_id", "ingested_at", "doc_id", "doc_title", "text")
    return answers.latest(some, "chunk_id", "ingested_at")


def number_of(qid: str) -> Column:
    return F.regexp_extract(F.col(qid), r"(\d+)", 1).cast("bigint")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """Every gold question once, as last delivered."""
    some = table(spark, folder, "gold").where("question is not null").select("qid", "added_at", "question", "is_answerable", "gold_answer", "gold_chunk_ids", "bucket")
    return answers.latest(some, "qid", "added_at")


def asked(spark: SparkSession, folder: str) -> DataFrame:
    return gold(spark, folder).where(number_of("qid") % EVERY == 0)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every verifier pair once, as last delivered."""
    some = table(spark, folder, "verifier_bench").select(F.col("vid").alias("claim_id"), "added_at", "claim", "quote", "citations", F.col("supported").alias("label"))
    once = answers.latest(some, "claim_id", "added_at")
    return once.withColumn("citations", F.coalesce("citations", F.expr("cast(array() as array<string>)")))


LATEST = "SELECT * FROM (SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) rn FROM {table} {where}) WHERE rn = 1"


def latest_sql(name: str, key: str, time: str, cols: list[str], where: str = "") -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [time, *cols])
    return LATEST.format(cols=", ".join([key, time, *cols]), key=key, order=order, table=name, where=where)


P = latest_sql("chunks", "chunk_id", "ingested_at", ["doc_id", "doc_title", "text"], "WHERE text IS NOT NULL")
G = latest_sql("gold", "qid", "added_at", ["question", "is_answerable", "gold_answer", "gold_chunk_ids", "bucket"], "WHERE question IS NOT NULL")
Q = f"SELECT * FROM ({G}) WHERE CAST(regexp_extract(qid, '(\\d+)', 1) AS BIGINT) % {EVERY} = 0"
C = f"SELECT vid AS claim_id, claim, quote, coalesce(citations, []) AS citations, supported AS label FROM ({latest_sql('verifier_bench', 'vid', 'added_at', ['claim', 'quote', 'citations', 'supported'])})"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {lit(f'[{W}]+')}), lambda w: w <> '')"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^[{W}]+|[{W}]+$')}, '', 'g')"


def span_sql(x: str) -> str:
    return strip_sql(f"regexp_replace(translate({x}, '*`', ''), {lit(f'[{W}]+')}, ' ', 'g')")


def overlap_sql(premise: str, hypothesis: str) -> str:
    h, p = f"list_distinct({words_sql(f'lower({hypothesis})')})", f"list_distinct({words_sql(f'lower({premise})')})"
    return f"(len(list_intersect({h}, {p})) / greatest(len({h}), 1))"


def estimate_sql(x: str) -> str:
    return f"CAST(trunc(len({words_sql(x)}) * 1.3::DOUBLE) AS INTEGER)"


# ---- text functions ------------------------------------------------------


@query(f"""SELECT doc_id, {strip_sql("regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ ' || chr(9) || ']+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS normal FROM documents WHERE text IS NOT NULL""")
def normalise_docs(spark: SparkSession, folder: str) -> DataFrame:
    """White space of every page put in order."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", fn.normalise_corpus(F.col("text")).alias("normal"))


@query(f"""SELECT doc_id, coalesce(
  list_filter(list_transform(list_filter(string_split_regex(text, {lit(f'{chr(13)}{chr(10)}|[{L}]')}), lambda x: starts_with(x, '# ')), lambda x: {strip_sql('substring(x, 3)')}), lambda x: x <> '')[1],
  array_to_string(list_transform(regexp_extract_all(replace(regexp_replace(regexp_replace(coalesce(url, ''), '^.*/', ''), '(.)\\.[^.]*$', '\\1'), '_', ' '), '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda r: upper(substring(r, 1, 1)) || lower(substring(r, 2))), '')) AS title
  FROM documents WHERE text IS NOT NULL""")
def doc_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Title of every page: its heading, or else its address's last part."""
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", fn.title(F.col("text"), F.coalesce("url", F.lit(""))).alias("title"))


@query(f"SELECT vid, {span_sql('quote')} AS span FROM verifier_bench WHERE quote IS NOT NULL")
def span_normalise(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes without emphasis and superfluous white space."""
    return table(spark, folder, "verifier_bench").where("quote is not null").select("vid", fn.normalise_span(F.col("quote")).alias("span"))


@query(f"SELECT doc_id, {estimate_sql('text')} AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", fn.token_estimate(F.col("text")).alias("tokens"))


@query(f"""SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({words_sql('lower(text)')}) AS term FROM ({P})) GROUP BY term""")
def bm25_tokens_stats(spark: SparkSession, folder: str) -> DataFrame:
    """In how many passages each term stands, and how often."""
    return retrieval.postings(passages(spark, folder)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# ---- units and chunks ----------------------------------------------------

_ABBR = "|".join(a.replace(".", "[.]") for a in chunking.ABBREVIATIONS)
_BLOCK = f"^[{W}]*(?:#{{1,6}}[{W}]|[-*+][{W}]|\\d+[.)][{W}]|\\||>)"
_CUT = chunking.CUT
UNITS = f"""
lines AS (SELECT doc_id, string_split(regexp_replace(translate(text, '{_CUT}', '{chunking.STAND_IN}'), {lit(f'({chr(13)}{chr(10)}|[{L}])')}, '\\1{_CUT}', 'g'), '{_CUT}') AS l FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, flatten(list_transform(l, lambda x: CASE WHEN regexp_matches(x, {lit(_BLOCK)}) THEN [x] ELSE
  string_split(regexp_replace(regexp_replace(x, {lit(f'([.!?])([{W}]+)(["' + chr(39) + '(\\[`]?[A-Z0-9])')}, '\\1\\2{_CUT}\\3', 'g'), {lit(f'((?:{_ABBR})[{W}]+){_CUT}')}, '\\1', 'g'), '{_CUT}') END)) AS p FROM lines),
pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS n FROM cut),
placed AS (SELECT doc_id, n, piece, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
cores AS (SELECT doc_id, n, piece, CAST(before + length(piece) - length(regexp_replace(piece, {lit(f'^[{W}]+')}, '')) AS INTEGER) AS "start", length({strip_sql('piece')}) AS len FROM placed),
units AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS unit, "start", CAST("start" + len AS INTEGER) AS "end", {estimate_sql('piece')} AS tokens FROM cores WHERE len > 0)
"""
_T, _O = Config().chunk.target_tokens, Config().chunk.overlap_sentences
PACKED = f"""{UNITS},
packs AS (
  SELECT u.doc_id, 0 AS i, 0 AS first, u.tokens AS held, CAST(NULL AS INTEGER) AS done_first FROM units u WHERE u.unit = 0
  UNION ALL
  SELECT p.doc_id, p.i + 1, CASE WHEN p.held + u.tokens > {_T} THEN greatest(p.first, p.i + 1 - {_O}) ELSE p.first END,
    CASE WHEN p.held + u.tokens > {_T} THEN (CASE WHEN {_O} > 0 THEN v.tokens ELSE 0 END) + u.tokens ELSE p.held + u.tokens END,
    CASE WHEN p.held + u.tokens > {_T} THEN p.first END
  FROM packs p JOIN units u ON u.doc_id = p.doc_id AND u.unit = p.i + 1 JOIN units v ON v.doc_id = p.doc_id AND v.unit = p.i
),
windows AS (
  SELECT doc_id, done_first AS first, i - 1 AS last FROM packs WHERE done_first IS NOT NULL
  UNION ALL
  SELECT doc_id, arg_max(first, i), max(i) FROM packs GROUP BY doc_id
),
made AS (
  SELECT w.doc_id, w.doc_id || '::c' || lpad(CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.last) - 1 AS VARCHAR), CAST(greatest(2, length(CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.last) - 1 AS VARCHAR))) AS INTEGER), '0') AS chunk_id,
    a."start" AS char_start, z."end" AS char_end, w.first AS sent_first, w.last AS sent_last
  FROM windows w JOIN units a ON a.doc_id = w.doc_id AND a.unit = w.first JOIN units z ON z.doc_id = w.doc_id AND z.unit = w.last
)"""


@query(f"""WITH {UNITS} SELECT doc_id, unit, "start", "end", tokens FROM units""")
def unit_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Units of every page."""
    return chunking.units(table(spark, folder, "documents"), "doc_id", "text")


def _made(spark: SparkSession, folder: str) -> DataFrame:
    c = Config().chunk
    return chunking.chunks(table(spark, folder, "documents"), "doc_id", "text", c.target_tokens, c.overlap_sentences)


@query(f"WITH RECURSIVE {PACKED} SELECT m.doc_id, chunk_id, char_start, char_end, sent_first, sent_last, substring(d.text, char_start + 1, char_end - char_start) AS text FROM made m JOIN documents d ON d.doc_id = m.doc_id")
def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of every page."""
    return _made(spark, folder)


@query(f"WITH RECURSIVE {PACKED} SELECT d.doc_id, length(d.text) AS char_count, coalesce(c.n, 0) AS chunk_count FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM made GROUP BY doc_id) c ON c.doc_id = d.doc_id WHERE d.text IS NOT NULL")
def chunk_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Characters and chunks of every page."""
    return chunking.manifest(table(spark, folder, "documents"), "doc_id", "text", _made(spark, folder))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (WHERE char_end IS NULL) AS n_open, count(*) FILTER (WHERE char_end - char_start <> length(text)) AS n_broken,
  count(*) FILTER (WHERE sent_range[1] > sent_range[2]) AS n_reversed FROM chunks WHERE text IS NOT NULL""")
def chunk_span_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """How many given chunks contradict the span they name."""
    c = table(spark, folder, "chunks").where("text is not null")
    return c.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("char_end").isNull()).alias("n_open"), F.count_if(F.col("char_end") - F.col("char_start") != F.length("text")).alias("n_broken"),
        F.count_if(F.get("sent_range", F.lit(0)) > F.get("sent_range", F.lit(1))).alias("n_reversed"),
    )


@query(f"""SELECT m.doc_id, m.char_count AS stated_chars, m.chunk_count AS stated_chunks, c.n AS chunks, c.reach AS reach
  FROM ({latest_sql('manifest', 'doc_id', 'ingested_at', ['char_count', 'chunk_count'])}) m JOIN (SELECT doc_id, count(DISTINCT chunk_id) AS n, max(char_end) AS reach FROM chunks GROUP BY doc_id) c ON c.doc_id = m.doc_id
  WHERE m.chunk_count IS DISTINCT FROM c.n OR m.char_count IS NULL OR m.char_count < c.reach""")
def manifest_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose manifest no longer fits their chunks."""
    m = answers.latest(table(spark, folder, "manifest").select("doc_id", "ingested_at", "char_count", "chunk_count"), "doc_id", "ingested_at")
    c = table(spark, folder, "chunks").groupBy("doc_id", "chunk_id").agg(F.max("char_end").alias("e")).groupBy("doc_id").agg(F.count("chunk_id").alias("chunks"), F.max("e").alias("reach"))
    stale = ~F.col("chunk_count").eqNullSafe(F.col("chunks")) | F.col("char_count").isNull() | (F.col("char_count") < F.col("reach"))
    return m.join(c, "doc_id").where(stale).select("doc_id", F.col("char_count").alias("stated_chars"), F.col("chunk_count").alias("stated_chunks"), "chunks", "reach")


# ---- retrieval -----------------------------------------------------------

_R = Config().retrieval


@query(f"""SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(v.vec_id AS VARCHAR) AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0)) WHERE rank <= {_R.dense_k}""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 100."""
    e = table(spark, folder, "embeddings")
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    found = retrieval.dense_top(e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), vectors, _R.dense_k, digits=6)
    return found.select("qid", "chunk_id", "score", "rank")




def candidates_sql(q: str) -> str:
    """Dense and lexical candidates of the questions q, fused."""
    return f"""
p AS MATERIALIZED ({P}), q AS MATERIALIZED ({q}),
terms AS MATERIALIZED (SELECT chunk_id, unnest({words_sql('lower(text)')}) AS term FROM p),
post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL),
dl AS (SELECT chunk_id, len({words_sql('lower(text)')}) AS dl FROM p),
stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term), stats),
idf AS (SELECT term, CASE WHEN raw < 0 THEN {retrieval.EPSILON} * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
ask AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({words_sql('lower(question)')}) AS term FROM q) GROUP BY ALL),
hits AS (SELECT qid, chunk_id, round(sum(times * idf * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * dl / avgdl))), {retrieval.DIGITS}) AS score
  FROM ask JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), stats GROUP BY qid, chunk_id),
bm25 AS MATERIALIZED (SELECT qid, chunk_id, score, rank FROM (SELECT qid, chunk_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, chunk_id) AS rank
  FROM (SELECT qid, chunk_id FROM q, p) LEFT JOIN hits USING (qid, chunk_id)) WHERE rank <= {_R.bm25_k}),
pv AS MATERIALIZED (SELECT chunk_id, CAST('0x' || substring(md5(term), 1, 4) AS BIGINT) % {retrieval.DIMENSIONS} AS dim, count(*) AS n FROM post GROUP BY ALL),
qv AS MATERIALIZED (SELECT qid, CAST('0x' || substring(md5(term), 1, 4) AS BIGINT) % {retrieval.DIMENSIONS} AS dim, count(*) AS n FROM ask GROUP BY ALL),
pn AS (SELECT chunk_id, sum(n * n)::DOUBLE AS s FROM pv GROUP BY chunk_id), qn AS (SELECT qid, sum(n * n)::DOUBLE AS s FROM qv GROUP BY qid),
near AS (SELECT qid, chunk_id, round(d / sqrt(qn.s * pn.s), {retrieval.DIGITS}) AS score FROM (SELECT qid, chunk_id, sum(qv.n * pv.n)::DOUBLE AS d FROM qv JOIN pv USING (dim) GROUP BY ALL) JOIN qn USING (qid) JOIN pn USING (chunk_id)),
dense AS MATERIALIZED (SELECT qid, chunk_id, score, rank FROM (SELECT qid, chunk_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, chunk_id) AS rank
  FROM (SELECT qid, chunk_id FROM q, p) LEFT JOIN near USING (qid, chunk_id)) WHERE rank <= {_R.dense_k}),
both_ranks AS (SELECT coalesce(d.qid, b.qid) AS qid, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.rank AS dense_rank, b.rank AS lexical_rank, round(coalesce(1 / ({_R.rrf_k} + d.rank), 0) + coalesce(1 / ({_R.rrf_k} + b.rank), 0), 12) AS score
  FROM dense d FULL OUTER JOIN bm25 b ON d.qid = b.qid AND d.chunk_id = b.chunk_id),
fused AS MATERIALIZED (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS rank FROM both_ranks)"""


def reranked_sql(q: str) -> str:
    return f"""{candidates_sql(q)},
pair AS MATERIALIZED (SELECT f.qid, f.chunk_id, f.rank AS fused_rank, {overlap_sql('p.text', 'q.question')} AS raw FROM fused f JOIN q USING (qid) JOIN p USING (chunk_id)),
reranked AS MATERIALIZED (SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fused_rank, chunk_id) AS rank FROM (SELECT qid, chunk_id, fused_rank, round(raw, {retrieval.DIGITS}) AS score FROM pair)) WHERE rank <= {_R.final_k})"""


FUSED, RERANKED = candidates_sql(Q), reranked_sql(Q)


def _rankings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, flow.Rankings]:
    q, p = checkpointed(asked(spark, folder)), checkpointed(passages(spark, folder))  # read by every stage
    return q, p, flow.rank(q, p, Config())


def _reranked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, p, r = _rankings(spark, folder)
    return q, p, retrieval.rerank(r.fused(Config()), q, p, _R.final_k)


@query(f"WITH {FUSED} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Best passages of every hundredth gold question."""
    found = retrieval.bm25_top(checkpointed(asked(spark, folder)), checkpointed(passages(spark, folder)), _R.bm25_k)
    return found.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {FUSED} SELECT 'dense' AS search, qid, chunk_id, rank FROM dense UNION ALL SELECT 'hybrid', qid, chunk_id, rank FROM fused")
def hybrid_vs_dense_only(spark: SparkSession, folder: str) -> DataFrame:
    """Ranking of hybrid search beside that of the dense vectors alone."""
    _, _, r = _rankings(spark, folder)
    one = r.fused(Config().with_overrides({"retrieval.hybrid": False})).select(F.lit("dense").alias("search"), "qid", "chunk_id", "rank")
    return one.unionByName(r.fused(Config()).select(F.lit("hybrid").alias("search"), "qid", "chunk_id", "rank"))


_RRF = f"""a AS (SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, CAST(b.vec_id AS VARCHAR)) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0) WHERE rank <= {_R.dense_k}),
b AS (SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY (a.label = b.label) DESC, CAST(b.vec_id AS VARCHAR)) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0) WHERE rank <= {_R.bm25_k}),
f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS dense_rank, b.rank AS lexical_rank, round(coalesce(1 / ({_R.rrf_k} + a.rank), 0) + coalesce(1 / ({_R.rrf_k} + b.rank), 0), 12) AS score FROM a FULL OUTER JOIN b ON a.qid = b.qid AND a.chunk_id = b.chunk_id)"""


@query(f"""WITH {_RRF} SELECT CAST(qid AS VARCHAR) AS qid, CAST(chunk_id AS VARCHAR) AS chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST, CAST(chunk_id AS VARCHAR)) AS rank FROM f""")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Two rankings of the vectors fused: by nearness and by common label."""
    e = table(spark, folder, "embeddings")
    near = dense_topk(spark, folder)
    some = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").cast("string").alias("qid"), "label")
    # of each label the k smallest ids, and k of any label to fill up with
    ids = e.select(F.col("vec_id").cast("string").alias("chunk_id"), "label")
    by_label = retrieval.top(ids.select("chunk_id", F.lit(0.0).alias("score"), "label"), _R.bm25_k + 1, "label").select("chunk_id", "label")
    spare = ids.orderBy("chunk_id").limit(2 * _R.bm25_k + 2)
    own = some.join(by_label, "label").select("qid", "chunk_id", F.lit(1.0).alias("score"))
    other = some.join(F.broadcast(spare.select("chunk_id", F.col("label").alias("other"))), F.col("label") != F.col("other")).select("qid", "chunk_id", F.lit(0.0).alias("score"))
    same = retrieval.top(own.unionByName(other).where("qid <> chunk_id"), _R.bm25_k)
    fused = retrieval.fuse(near, same, _R.rrf_k)
    return fused.select("qid", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {RERANKED} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM reranked")
def rerank_topk(spark: SparkSession, folder: str) -> DataFrame:
    _, _, r = _reranked(spark, folder)
    return r.select("qid", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {FUSED}, s AS (SELECT qid, chunk_id, score AS raw, min(score) OVER (PARTITION BY qid) < 0 OR max(score) OVER (PARTITION BY qid) > 1 AS outside FROM bm25)
  SELECT qid, chunk_id, round(CASE WHEN outside THEN 1 / (1 + exp(-raw)) ELSE raw END, 6) AS score FROM s""")
def rerank_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    """Scores outside [0, 1] become sigmoids, all those of a question together."""
    q, p, r = _rankings(spark, folder)
    found = r.lexical
    from pyspark.sql import Window

    whole = Window.partitionBy("qid")
    outside = (F.min("score").over(whole) < 0) | (F.max("score").over(whole) > 1)
    return found.select("qid", "chunk_id", F.round(F.when(outside, fn.sigmoid(F.col("score"))).otherwise(F.col("score")), 6).alias("score"))


@query(f"""WITH {RERANKED}, ids AS (SELECT qid, chunk_id FROM fused UNION SELECT qid, chunk_id FROM reranked)
  SELECT qid, chunk_id, CAST(d.rank AS INTEGER) AS dense_rank, CAST(b.rank AS INTEGER) AS lexical_rank, CAST(f.rank AS INTEGER) AS fused_rank, CAST(r.rank AS INTEGER) AS final_rank FROM ids LEFT JOIN dense d USING (qid, chunk_id) LEFT JOIN bm25 b USING (qid, chunk_id) LEFT JOIN fused f USING (qid, chunk_id) LEFT JOIN reranked r USING (qid, chunk_id)""")
def stage_anatomy(spark: SparkSession, folder: str) -> DataFrame:
    """Where each stage ranked each passage."""
    q, p, r = _rankings(spark, folder)
    fused = r.fused(Config())
    return retrieval.anatomy(r.dense, r.lexical, fused, retrieval.rerank(fused, q, p, _R.final_k))


# ---- answers, gates ------------------------------------------------------

_A = Config().abstain


@query(f"WITH {RERANKED} SELECT q.qid, count(r.chunk_id) AS n_passages, round(coalesce(max(r.score), 0), 6) AS signal, count(r.chunk_id) = 0 OR coalesce(max(r.score), 0) < {_A.min_rerank_score} AS abstained FROM q LEFT JOIN reranked r USING (qid) GROUP BY q.qid")
def gate_a(spark: SparkSession, folder: str) -> DataFrame:
    q, _, r = _reranked(spark, folder)
    return answers.gate_a(q, r, _A.min_rerank_score).withColumn("signal", F.round("signal", 6))


@query(f"WITH {RERANKED} SELECT q.qid, r.chunk_id IS NULL AS insufficient, p.text AS claim, r.chunk_id AS citation, 'extractive-fallback' AS generator FROM q LEFT JOIN (SELECT * FROM reranked WHERE rank = 1) r USING (qid) LEFT JOIN p ON p.chunk_id = r.chunk_id")
def extractive_answer(spark: SparkSession, folder: str) -> DataFrame:
    q, p, r = _reranked(spark, folder)
    made = answers.extractive(q, r, p)
    return made.select("qid", "insufficient", "claim", F.get("citations", F.lit(0)).alias("citation"), "generator")


@query(f"""WITH {RERANKED} SELECT qid, string_agg(printf('[%s] (%.2f) %s', r.chunk_id, score, substring(text, 1, 120) || '...'), chr(10) ORDER BY rank) AS closest FROM reranked r JOIN p USING (chunk_id) WHERE rank <= 2 GROUP BY qid""")
def closest_passages(spark: SparkSession, folder: str) -> DataFrame:
    _, p, r = _reranked(spark, folder)
    return answers.closest_passages(r, p)


@query(f"""WITH p AS MATERIALIZED ({P}), c AS MATERIALIZED ({C}),
  each AS (SELECT claim_id, unnest(citations) AS chunk_id, generate_subscripts(citations, 1) AS pos FROM c),
  known AS (SELECT claim_id, string_agg(chunk_id, ' ' ORDER BY pos) AS allowed FROM each JOIN p USING (chunk_id) GROUP BY claim_id)
  SELECT claim_id, coalesce(allowed, '') AS allowed, len(citations) AS cited FROM c LEFT JOIN known USING (claim_id)""")
def citation_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of chunks that exist, in order."""
    held = answers.cited(claims(spark, folder), passages(spark, folder))
    allowed = answers.allowed_citations(F.col("citations"), F.transform("cited", lambda c: c["chunk_id"]))
    return held.select("claim_id", F.array_join(allowed, " ").alias("allowed"), F.size("citations").alias("cited"))


CITED = f"""p AS MATERIALIZED ({P}), c AS MATERIALIZED ({C}),
each AS (SELECT claim_id, unnest(citations) AS chunk_id, generate_subscripts(citations, 1) AS pos FROM c),
lists AS (SELECT claim_id, list(struct_pack(chunk_id := e.chunk_id, doc_id := p.doc_id, doc_title := p.doc_title, text := p.text) ORDER BY pos) AS cited FROM each e JOIN p USING (chunk_id) GROUP BY claim_id),
held AS MATERIALIZED (SELECT c.*, coalesce(l.cited, []) AS cited FROM c LEFT JOIN lists l USING (claim_id))"""


def premise_sql(quote: str, cited: str, pad: int) -> str:
    """The premise as SQL over a list of passages."""
    joint = f"array_to_string(list_transform({cited}, lambda x: x.text), chr(10) || chr(10))"
    titled = lambda t, b: f"(CASE WHEN coalesce({t}, '') <> '' THEN {t} || chr(10) || chr(10) || {b} ELSE {b} END)"
    needle = f"lower({span_sql(quote)})"
    texts = f"list_transform({cited}, lambda x: struct_pack(t := {span_sql('x.text')}, d := x.doc_title))"
    holder = f"list_filter({texts}, lambda y: contains(lower(y.t), {needle}))[1]"
    at = f"(instr(lower({holder}.t), {needle}) - 1)"
    start, end = f"greatest(0, {at} - {pad})", f"least(length({holder}.t), {at} + length({needle}) + {pad})"
    window = titled(f"{holder}.d", strip_sql(f"substring({holder}.t, {start} + 1, {end} - {start})"))
    whole = f"CASE WHEN len(list_distinct(list_transform({cited}, lambda x: x.doc_id))) = 1 THEN {titled(f'{cited}[-1].doc_title', joint)} ELSE {joint} END"
    return f"(CASE WHEN coalesce({quote}, '') = '' THEN {whole} WHEN {holder} IS NOT NULL THEN {window} ELSE {joint} END)"


_V = Config().verify
_PREMISE = premise_sql("quote", "cited", _V.premise_window_chars)
SCORED = f"""{CITED},
drops AS (SELECT claim_id, claim, quote, cid, pos, list_filter(cited, lambda z: z.chunk_id <> cid) AS cited FROM (SELECT claim_id, claim, quote, cited, unnest(citations) AS cid, generate_subscripts(citations, 1) AS pos FROM held)),
full_score AS (SELECT claim_id, claim, citations, label, CASE WHEN len(cited) = 0 THEN 0 ELSE (CASE WHEN {strip_sql('premise')} = '' OR {strip_sql("coalesce(claim, '')")} = '' THEN 0 ELSE round({overlap_sql('premise', 'claim')}, 9) END) END AS score
  FROM (SELECT *, {_PREMISE} AS premise FROM held)),
less AS (SELECT claim_id, cid, pos, CASE WHEN len(cited) = 0 THEN 0 ELSE (CASE WHEN {strip_sql('premise')} = '' OR {strip_sql("coalesce(claim, '')")} = '' THEN 0 ELSE round({overlap_sql('premise', 'claim')}, 9) END) END AS score
  FROM (SELECT *, {_PREMISE} AS premise FROM drops)),
verdict AS MATERIALIZED (SELECT f.claim_id, f.citations, f.label, f.score, f.score >= {_V.support_threshold} AS supported, coalesce(n.precise, []) AS precise
  FROM full_score f LEFT JOIN (SELECT l.claim_id, list(cid ORDER BY pos) AS precise FROM less l JOIN full_score g USING (claim_id) WHERE g.score >= {_V.support_threshold} AND l.score < {_V.support_threshold} GROUP BY l.claim_id) n USING (claim_id))"""


@query(f"""WITH {CITED} SELECT claim_id, coalesce(quote, '') = '' OR contains(array_to_string(list_transform(cited, lambda x: lower({span_sql('x.text')})), ' '), lower({span_sql('quote')})) AS grounded FROM held""")
def quote_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each quote stands in what it cites."""
    held = answers.cited(claims(spark, folder), passages(spark, folder))
    return held.select("claim_id", answers.grounded(F.col("quote"), F.col("cited")).alias("grounded"))


@query(f"WITH {CITED} SELECT claim_id, {_PREMISE} AS premise FROM held")
def premise_window(spark: SparkSession, folder: str) -> DataFrame:
    """What each claim is held against."""
    held = answers.cited(claims(spark, folder), passages(spark, folder))
    return answers.with_premise(held, _V.premise_window_chars).select("claim_id", "premise")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return answers.verify(claims(spark, folder), passages(spark, folder), _V.support_threshold, _V.premise_window_chars)


@query(f"WITH {SCORED} SELECT claim_id, round(score, 6) AS score, supported, array_to_string(precise, ' ') AS precise_citations FROM verdict")
def verify_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Support of each claim, and which citations it needs."""
    return _verdicts(spark, folder).select("claim_id", F.round("score", 6).alias("score"), "supported", F.array_join("precise_citations", " ").alias("precise_citations"))


@query(f"""WITH {SCORED}, byd AS (SELECT split_part(citations[1], '::', 1) AS answer_id, supported FROM verdict WHERE len(citations) > 0)
  SELECT answer_id, count(*) AS n_claims, count(*) FILTER (WHERE supported) AS n_supported, count(*) FILTER (WHERE supported) < {_A.min_supported_claims} AS abstained FROM byd WHERE answer_id IS NOT NULL GROUP BY answer_id""")
def gate_b(spark: SparkSession, folder: str) -> DataFrame:
    """The claims about a document taken as one answer: is enough of it supported?"""
    v = _verdicts(spark, folder).where(F.size("citations") > 0).select(F.split_part(F.get("citations", F.lit(0)), F.lit("::"), F.lit(1)).alias("answer_id"), "supported").where("answer_id is not null")
    whole = v.select("answer_id").distinct().withColumn("insufficient", F.lit(False))
    return answers.gate_b(whole, v, _A.min_supported_claims)


@query(f"""WITH {SCORED} SELECT count(*) AS claims, round(avg(supported::INT), 4) AS entailed_rate, round(coalesce(sum(len(precise))::DOUBLE / nullif(sum(len(citations)), 0), 0), 4) AS citation_necessity FROM verdict""")
def self_consistency(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.consistency(_verdicts(spark, folder))


# ---- measures ------------------------------------------------------------


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).select("score", "label").where("label is not null")


_LABELLED = f"{SCORED}, s AS MATERIALIZED (SELECT score, label FROM verdict WHERE label IS NOT NULL)"


@query(f"""WITH {_LABELLED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s)
  SELECT count(*) FILTER (WHERE label) AS n_pos, count(*) FILTER (WHERE NOT label) AS n_neg,
  round(coalesce((sum(mid) FILTER (WHERE label) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2.0) / nullif(count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label), 0), 0.5), 4) AS auroc FROM r""")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.auroc(_scored(spark, folder))


_SWEEP = f"""{_LABELLED}, t AS (SELECT 0.0::DOUBLE AS tau UNION SELECT round(score + 1e-6, 6) FROM s),
rates AS (SELECT tau, round(coalesce(count(*) FILTER (WHERE NOT label AND score >= tau)::DOUBLE / nullif(count(*) FILTER (WHERE NOT label), 0), 0), 4) AS false_answer_rate,
 round(coalesce(count(*) FILTER (WHERE label AND score < tau)::DOUBLE / nullif(count(*) FILTER (WHERE label), 0), 0), 4) AS over_refusal_rate,
 round(count(*) FILTER (WHERE label = (score >= tau))::DOUBLE / count(*), 4) AS accuracy FROM t, s GROUP BY tau)"""


@query(f"WITH {_SWEEP} SELECT * FROM rates")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.sweep(_scored(spark, folder))


@query(f"WITH {_SWEEP} SELECT * FROM rates ORDER BY accuracy DESC, false_answer_rate, tau LIMIT 1")
def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_threshold(metrics.sweep(_scored(spark, folder)))


@query(f"WITH {_SWEEP.replace('SELECT 0.0::DOUBLE AS tau UNION SELECT round(score + 1e-6, 6) FROM s', 'SELECT i / 200.0::DOUBLE AS tau FROM range(201) r(i)')} SELECT * FROM rates")
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.grid(_scored(spark, folder))


@query(f"""WITH {_LABELLED} SELECT count(*) FILTER (WHERE label AND score >= 0.5) AS tp, count(*) FILTER (WHERE label AND score < 0.5) AS fn, count(*) FILTER (WHERE NOT label AND score >= 0.5) AS fp, count(*) FILTER (WHERE NOT label AND score < 0.5) AS tn,
  round(avg(score) FILTER (WHERE label), 4) AS mean_pos, round(avg(score) FILTER (WHERE NOT label), 4) AS mean_neg, round(min(score) FILTER (WHERE label) - max(score) FILTER (WHERE NOT label), 4) AS separation,
  round(count(*) FILTER (WHERE label = (score >= 0.5))::DOUBLE / count(*), 4) AS accuracy, round(count(*) FILTER (WHERE label AND score >= 0.5)::DOUBLE / count(*) FILTER (WHERE label), 4) AS recall, round(count(*) FILTER (WHERE NOT label AND score < 0.5)::DOUBLE / count(*) FILTER (WHERE NOT label), 4) AS specificity FROM s""")
def verifier_bench(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.verifier_scores(_scored(spark, folder))


@query(f"WITH {_LABELLED} SELECT label, count(score) AS n, round(min(score), 6) AS min_score, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM s GROUP BY label")
def signal_describe(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.describe(_scored(spark, folder), "label")


def recall_sql(gold_: str, answer: str) -> str:
    bare = lambda x: f"list_distinct(list_transform({words_sql(x)}, lambda w: lower(trim(w, {lit(fn.WORD_EDGE)}))))"
    stop = "[" + ", ".join(lit(w) for w in [*fn.STOP_WORDS, ""]) + "]"
    want = f"list_filter({bare(gold_)}, lambda w: NOT list_contains({stop}, w))"
    return f"coalesce(len(list_intersect({want}, {bare(answer)}))::DOUBLE / nullif(len({want}), 0), 0)"


@query(f"SELECT grade_id, round({recall_sql('gold_answer', 'agent_answer')}, 6) AS token_recall FROM human_grades WHERE gold_answer IS NOT NULL AND agent_answer IS NOT NULL")
def token_recall(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the reference answer each answer has."""
    some = table(spark, folder, "human_grades").where("gold_answer is not null and agent_answer is not null")
    return some.select("grade_id", F.round(fn.token_recall(F.col("gold_answer"), F.col("agent_answer")), 6).alias("token_recall"))


@query(f"""WITH g AS (SELECT grade, count(*) AS n, round(avg({recall_sql("coalesce(gold_answer, '')", "coalesce(agent_answer, '')")}), 4) AS mean_token_recall FROM human_grades WHERE grade IS NOT NULL GROUP BY grade),
  d AS (SELECT unnest(['correct', 'partial', 'wrong']) AS grade UNION SELECT grade FROM g)
  SELECT d.grade, coalesce(n, 0) AS n, round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM g), 4) AS share, mean_token_recall FROM d LEFT JOIN g USING (grade)""")
def grade_score(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.grade_scores(table(spark, folder, "human_grades"))


@query("SELECT count(*) AS n, round(count(*) FILTER (WHERE grade = 'correct')::DOUBLE / count(*), 4) AS strict, round((count(*) FILTER (WHERE grade = 'correct') + count(*) FILTER (WHERE grade = 'partial') / 2.0) / count(*), 4) AS lenient FROM human_grades WHERE grade IN ('correct', 'partial', 'wrong')")
def grade_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.grade_summary(table(spark, folder, "human_grades"))


_CARRY = f"""now AS ({latest_sql('human_grades', 'qid', 'graded_at', ['grade_id', 'agent_answer'])}),
old AS (SELECT * FROM (SELECT h.qid, h.grade_id, h.agent_answer, h.grade, row_number() OVER (PARTITION BY h.qid ORDER BY h.graded_at DESC NULLS LAST, h.grade_id DESC) AS k FROM human_grades h JOIN now USING (qid) WHERE h.grade_id <> now.grade_id AND h.grade IS NOT NULL AND h.qid IS NOT NULL) WHERE k = 1)"""


@query(f"""WITH {_CARRY} SELECT now.qid, now.agent_answer, CASE WHEN old.agent_answer IS NOT DISTINCT FROM now.agent_answer AND old.grade IS NOT NULL THEN old.grade END AS grade,
  CASE WHEN old.grade IS NULL THEN 'ungraded' WHEN old.agent_answer IS NOT DISTINCT FROM now.agent_answer THEN 'carried' ELSE 'reset' END AS outcome FROM now LEFT JOIN old USING (qid) WHERE now.qid IS NOT NULL""")
def grade_carry(spark: SparkSession, folder: str) -> DataFrame:
    """The last answer to each question with the grade of the one before it, if unchanged."""
    h = table(spark, folder, "human_grades").where("qid is not null").select("qid", "graded_at", "grade_id", "agent_answer", "grade")
    now = answers.latest(h.select("qid", "graded_at", "grade_id", "agent_answer"), "qid", "graded_at")
    earlier = h.join(now.select("qid", F.col("grade_id").alias("last")), "qid").where((F.col("grade_id") != F.col("last")) & F.col("grade").isNotNull())
    before = answers.latest(earlier.select("qid", "graded_at", "grade_id", "agent_answer", "grade"), "qid", "graded_at")
    return metrics.carried_grades(now.select("qid", "agent_answer"), before.select("qid", "agent_answer", "grade"))


@query("SELECT grade_id, substring(sha256('local::' || question), 1, 16) AS key, c.reply AS cached, CASE WHEN c.reply IS NOT NULL THEN 'cache' END AS generator FROM human_grades h LEFT JOIN (SELECT sha256('local::' || question) AS key, max(gold_answer) AS reply FROM gold WHERE question IS NOT NULL AND gold_answer IS NOT NULL GROUP BY 1) c ON c.key = sha256('local::' || h.question) WHERE question IS NOT NULL")
def prompt_cache_join(spark: SparkSession, folder: str) -> DataFrame:
    """Graded questions that a cache of the gold answers would answer."""
    g = table(spark, folder, "gold").where("question is not null and gold_answer is not null")
    cache = g.groupBy(fn.prompt_key(F.lit("local"), F.col("question")).alias("key")).agg(F.max("gold_answer").alias("reply"))
    asked_ = table(spark, folder, "human_grades").where("question is not null").select("grade_id", F.col("question").alias("prompt"))
    return answers.with_cache(asked_, cache, "local").select("grade_id", F.substring("key", 1, 16).alias("key"), "cached", "generator")


@query("""SELECT event_id, CAST(json_extract_string(regexp_extract('note ```json' || chr(10) || '{"claims": [], "insufficient_evidence": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "reasoning": "' || event_type || '"}' || chr(10) || '```', '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '$.insufficient_evidence') AS BOOLEAN) AS insufficient,
  json_extract_string(regexp_extract('note ```json' || chr(10) || '{"claims": [], "insufficient_evidence": false, "reasoning": "' || event_type || '"}' || chr(10) || '```', '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1), '$.reasoning') AS reasoning FROM events""")
def json_extract_answer(spark: SparkSession, folder: str) -> DataFrame:
    """Answers parsed from replies with a fenced block, made of the events."""
    flag = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    reply = F.concat(F.lit('note ```json\n{"claims": [], "insufficient_evidence": '), flag, F.lit(', "reasoning": "'), "event_type", F.lit('"}\n```'))
    parsed = table(spark, folder, "events").select("event_id", answers.parsed_reply(reply).alias("r"))
    return parsed.select("event_id", F.col("r.insufficient_evidence").alias("insufficient"), "r.reasoning")


@query(f"""SELECT grade_id, regexp_matches(substring(coalesce(agent_answer, '') || ' ' || coalesce(grader_note, '') || CASE WHEN grade_id % 3 = 0 THEN ' 429: daily quota reached' ELSE '' END, 1, {fn.DAILY_LIMIT_CHARS}), {lit(fn.DAILY_LIMIT)}, 'i') AS daily FROM human_grades""")
def quota_label(spark: SparkSession, folder: str) -> DataFrame:
    """Which messages speak of a daily quota."""
    tail = F.when(F.col("grade_id") % 3 == 0, " 429: daily quota reached").otherwise("")
    message = F.concat(F.coalesce("agent_answer", F.lit("")), F.lit(" "), F.coalesce("grader_note", F.lit("")), tail)
    return table(spark, folder, "human_grades").select("grade_id", fn.names_daily_limit(message).alias("daily"))


@query("SELECT coalesce(split, 'none') AS split, count(DISTINCT qid) AS questions, count(DISTINCT qid) FILTER (WHERE coalesce(split, '') <> 'holdout') AS kept FROM holdout GROUP BY 1")
def holdout_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by split, and how many calibration may use."""
    h = table(spark, folder, "holdout")
    once = h.groupBy(F.coalesce("split", F.lit("none")).alias("split"), "qid").agg(F.max(metrics.usable_for_calibration(F.col("split")).cast("int")).alias("usable"))
    return once.groupBy("split").agg(F.count("qid").alias("questions"), F.sum("usable").alias("kept"))


@query("SELECT qid, arg_max(question, added_at || question) AS question FROM (SELECT qid, question, CAST(added_at AS VARCHAR) AS added_at FROM gold WHERE question IS NOT NULL UNION ALL SELECT qid, question, CAST(added_at AS VARCHAR) FROM holdout WHERE question IS NOT NULL) GROUP BY qid")
def question_map(spark: SparkSession, folder: str) -> DataFrame:
    """Question of each id over several sets; the latest wins."""
    both = table(spark, folder, "gold").select("qid", "added_at", "question").unionByName(table(spark, folder, "holdout").select("qid", "added_at", "question"))
    return answers.latest(both.where("question is not null"), "qid", "added_at").select("qid", "question")


# ---- the whole flow ------------------------------------------------------



def recorded(grades: DataFrame) -> flow.Generator:
    """The recorded answers as a generator: a claim for each sentence, which cites the two
    best passages and quotes what it sets in backticks."""
    some = grades.where("agent_answer is not null and qid is not null").select("qid", "graded_at", "grade_id", "agent_answer")
    last = answers.latest(some, "qid", "graded_at")
    sentences = F.filter(F.transform(F.split(F.regexp_replace("agent_answer", f"([.!?])[{W}]+", F.lit(f"$1{chunking.CUT}")), chunking.CUT), fn.strip), lambda s: s != "")

    def generate(questions: DataFrame, reranked: DataFrame, passages: DataFrame) -> DataFrame:
        best = reranked.where("rank <= 2").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("b")).select("qid", F.col("b.chunk_id").alias("best"))
        claim = lambda s: F.struct(s.alias("text"), F.col("best").alias("citations"), F.nullif(F.regexp_extract(s, "`([^`]+)`", 1), F.lit("")).alias("quote"))
        made = last.join(best, "qid").select("qid", F.lit(False).alias("insufficient"), F.lit("recorded").alias("generator"), F.transform(sentences, claim).alias("claims"))
        return answers.from_replies(made, reranked, passages, questions)

    return generate


_HELD = "list_transform(cited, lambda x: x.text)"
_TEST = f"CASE WHEN len(cited) = 0 OR {strip_sql('premise')} = '' OR {strip_sql("coalesce(claim, '')")} = '' THEN 0 ELSE round({overlap_sql('premise', 'claim')}, 9) END"
RECORDS = f"""{reranked_sql(G)},
context AS MATERIALIZED (SELECT 'dense' AS variant, qid, list(chunk_id ORDER BY rank) AS context, 1.0::DOUBLE AS signal FROM dense WHERE rank <= {_R.final_k} GROUP BY qid
  UNION ALL SELECT 'hybrid', qid, list(chunk_id ORDER BY rank), 1.0 FROM fused WHERE rank <= {_R.final_k} GROUP BY qid
  UNION ALL SELECT v, qid, list(chunk_id ORDER BY rank), max(score) FROM reranked, (SELECT unnest(['rerank_gate_a', 'full']) AS v) GROUP BY v, qid),
each_q AS MATERIALIZED (SELECT v AS variant, q.*, coalesce(c.context, []) AS context, coalesce(c.signal, 0) AS signal, c.qid IS NULL OR v IN ('rerank_gate_a', 'full') AND c.signal < {_A.min_rerank_score} AS at_a
  FROM q CROSS JOIN (SELECT unnest(['dense', 'hybrid', 'rerank_gate_a', 'full']) AS v) LEFT JOIN context c ON c.variant = v AND c.qid = q.qid),
replies AS (SELECT qid, list_filter(list_transform(string_split(regexp_replace(agent_answer, {lit(f'([.!?])[{W}]+')}, '\\1{_CUT}', 'g'), '{_CUT}'), lambda s: {strip_sql('s')}), lambda s: s <> '') AS said
  FROM ({latest_sql('human_grades', 'qid', 'graded_at', ['grade_id', 'agent_answer'], 'WHERE agent_answer IS NOT NULL AND qid IS NOT NULL')})),
made AS MATERIALIZED (SELECT e.variant, e.qid, CASE WHEN r.qid IS NULL THEN 'extractive-fallback' ELSE 'recorded' END AS generator, CASE WHEN r.qid IS NULL THEN [p.text] ELSE r.said END AS said, CASE WHEN r.qid IS NULL THEN e.context[1:1] ELSE e.context[1:2] END AS citations, r.qid IS NULL AS plain
  FROM each_q e LEFT JOIN replies r ON r.qid = e.qid LEFT JOIN p ON p.chunk_id = e.context[1] WHERE NOT e.at_a),
spoken AS MATERIALIZED (SELECT variant || '|' || qid || '#' || (pos - 1) AS claim_id, variant, qid, pos, claim, citations, CASE WHEN plain THEN NULL ELSE nullif(regexp_extract(claim, '`([^`]+)`', 1), '') END AS quote
  FROM (SELECT variant, qid, citations, plain, unnest(said) AS claim, generate_subscripts(said, 1) AS pos FROM made)),
cites AS (SELECT claim_id, unnest(citations) AS chunk_id, generate_subscripts(citations, 1) AS n FROM spoken),
listed AS (SELECT claim_id, list(struct_pack(chunk_id := e.chunk_id, doc_id := p.doc_id, doc_title := p.doc_title, text := p.text) ORDER BY n) AS cited FROM cites e JOIN p USING (chunk_id) GROUP BY claim_id),
held AS MATERIALIZED (SELECT s.*, coalesce(l.cited, []) AS cited FROM spoken s LEFT JOIN listed l USING (claim_id)),
claims AS MATERIALIZED (SELECT *, coalesce(quote, '') = '' OR contains(array_to_string(list_transform(cited, lambda x: lower({span_sql('x.text')})), ' '), lower({span_sql('quote')})) AS is_grounded FROM held),
whole AS MATERIALIZED (SELECT *, {_TEST} AS score FROM (SELECT *, {_PREMISE} AS premise FROM claims WHERE is_grounded AND variant = 'full')),
fewer AS (SELECT claim_id, cid, n, {_TEST} AS score FROM (SELECT *, {_PREMISE} AS premise FROM (SELECT claim_id, claim, quote, cid, n, list_filter(cited, lambda z: z.chunk_id <> cid) AS cited FROM (SELECT claim_id, claim, quote, cited, unnest(citations) AS cid, generate_subscripts(citations, 1) AS n FROM whole WHERE score >= {_V.support_threshold})))),
verdict AS MATERIALIZED (SELECT w.variant, w.qid, w.pos, w.claim, w.citations, round(w.score, 9) AS score, w.score >= {_V.support_threshold} AS supported, coalesce(n.precise, []) AS precise FROM whole w LEFT JOIN (SELECT claim_id, list(cid ORDER BY n) AS precise FROM fewer WHERE score < {_V.support_threshold} GROUP BY claim_id) n USING (claim_id)
  UNION ALL SELECT variant, qid, pos, claim, citations, 1.0, true, citations FROM claims WHERE is_grounded AND variant <> 'full'),
counted AS (SELECT variant, qid, count(*) FILTER (WHERE supported) AS n_supported, list_sort(list_distinct(flatten(list(citations) FILTER (WHERE supported)))) AS said, string_agg(claim, ' ' ORDER BY pos) FILTER (WHERE supported) AS answer, string_agg(claim, ' / ' ORDER BY pos) FILTER (WHERE NOT supported) AS dropped FROM verdict GROUP BY variant, qid),
ends AS MATERIALIZED (SELECT e.*, NOT at_a AND variant = 'full' AND coalesce(n_supported, 0) < {_A.min_supported_claims} AS at_b, coalesce(c.said, []) AS all_said, coalesce(c.answer, '') AS all_answer, coalesce(c.dropped, '') AS all_dropped, m.generator FROM each_q e LEFT JOIN counted c USING (variant, qid) LEFT JOIN made m USING (variant, qid)),
recs AS MATERIALIZED (SELECT variant, qid, question, bucket, coalesce(is_answerable, false) AS is_answerable, gold_answer, coalesce(gold_chunk_ids, []) AS gold, signal, context, generator, at_a OR at_b AS abstained, CASE WHEN len(context) = 0 THEN 'no_candidates' WHEN at_a THEN 'gate_a' WHEN at_b THEN 'gate_b' END AS reason,
  CASE WHEN at_a OR at_b THEN [] ELSE all_said END AS said, CASE WHEN at_a OR at_b THEN '' ELSE all_answer END AS answer, CASE WHEN at_a OR at_b THEN '' ELSE all_dropped END AS dropped FROM ends)"""


def _whole(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, flow.Generator]:
    """All gold questions, the passages, and the recorded answers."""
    return checkpointed(gold(spark, folder)), stored(passages(spark, folder)), recorded(table(spark, folder, "human_grades"))


_REAL = "generator NOT LIKE 'extractive-fallback%' AND generator NOT IN ('cache', 'none', 'unknown')"


@query(f"""WITH {RECORDS},
pr AS (SELECT variant, sum(len(list_intersect(said, list_distinct(gold)))) AS h, sum(len(said)) AS s, sum(len(list_distinct(gold))) AS g FROM recs WHERE is_answerable GROUP BY variant),
pf AS (SELECT variant, coalesce(h::DOUBLE / nullif(s, 0), 0) AS p, coalesce(h::DOUBLE / nullif(g, 0), 0) AS r FROM pr),
rt AS (SELECT variant, round(avg((hit IS NOT NULL)::INT), 4) AS recall_at_k, round(avg(coalesce(1.0 / hit, 0)), 4) AS mrr FROM (SELECT variant, list_min(list_filter(list_transform(gold, lambda g: list_position(context, g)), lambda x: x > 0)) AS hit FROM recs WHERE is_answerable AND len(gold) > 0) GROUP BY variant),
ar AS (SELECT variant, round(avg({recall_sql('gold_answer', 'answer')}), 4) AS mean_token_recall FROM recs WHERE is_answerable AND coalesce(gold_answer, '') <> '' GROUP BY variant),
ma AS (SELECT variant, CASE WHEN count(*) FILTER (WHERE generator = 'cache') > 0 THEN printf('%d+%dc/%d', count(*) FILTER (WHERE {_REAL}), count(*) FILTER (WHERE generator = 'cache'), count(generator)) ELSE printf('%d/%d', count(*) FILTER (WHERE {_REAL}), count(generator)) END AS model_answers FROM recs GROUP BY variant),
cm AS (SELECT variant, count(*) FILTER (WHERE is_answerable AND NOT abstained) AS ta, count(*) FILTER (WHERE NOT is_answerable AND NOT abstained) AS fa, count(*) FILTER (WHERE is_answerable AND abstained) AS fr, count(*) FILTER (WHERE NOT is_answerable AND abstained) AS tr FROM recs GROUP BY variant)
SELECT cm.*, round((ta + tr)::DOUBLE / (ta + fa + fr + tr), 4) AS accuracy, round(coalesce(fa::DOUBLE / nullif(fa + tr, 0), 0), 4) AS false_answer_rate, round(coalesce(fr::DOUBLE / nullif(fr + ta, 0), 0), 4) AS over_refusal_rate,
  round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, recall_at_k, mrr, mean_token_recall, model_answers
FROM cm LEFT JOIN pf USING (variant) LEFT JOIN rt USING (variant) LEFT JOIN ar USING (variant) LEFT JOIN ma USING (variant)""")
def ablation_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the flow over all gold questions, with one stage more each time."""
    q, p, generate = _whole(spark, folder)
    return flow.ladder_report(flow.ladder_records(flow.ladder(q, p, Config(), generator=generate)))


def _full(spark: SparkSession, folder: str) -> tuple[DataFrame, flow.Outcome]:
    q, p, generate = _whole(spark, folder)
    return q, flow.answer(q, p, flow.rank(q, p, Config()), Config(), generate)


@query(f"""WITH {RECORDS} SELECT qid, abstained, reason AS abstain_reason, answer AS answer_text, array_to_string(said, ' ') AS cited, dropped, generator FROM recs WHERE variant = 'full'""")
def flow_records(spark: SparkSession, folder: str) -> DataFrame:
    """The answer to each gold question, or why there is none."""
    _, out = _full(spark, folder)
    return out.records.select("qid", "abstained", "abstain_reason", "answer_text", F.array_join("predicted_chunk_ids", " ").alias("cited"), F.array_join("dropped_claims", " / ").alias("dropped"), "generator")


@query(f"WITH {RECORDS} SELECT bucket, count(*) AS n, count(*) FILTER (WHERE abstained) AS abstained, count(*) FILTER (WHERE NOT abstained) AS answered FROM recs WHERE variant = 'full' GROUP BY bucket")
def abstention_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Answered and refused questions of each bucket."""
    _, out = _full(spark, folder)
    return out.records.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("abstained").alias("abstained"), F.count_if(~F.col("abstained")).alias("answered"))


@query(f"WITH {RECORDS} SELECT is_answerable, count(*) AS n, sum(len(list_intersect(said, list_distinct(gold)))) AS hits, sum(len(list_distinct(gold))) AS wanted FROM recs WHERE variant = 'full' GROUP BY is_answerable")
def citation_prf(spark: SparkSession, folder: str) -> DataFrame:
    _, out = _full(spark, folder)
    said, want = F.array_distinct("predicted_chunk_ids"), F.array_distinct("gold_chunk_ids")
    return out.records.groupBy("is_answerable").agg(F.count("*").alias("n"), F.sum(F.size(F.array_intersect(said, want))).alias("hits"), F.sum(F.size(want)).alias("wanted"))


@query(f"WITH {RECORDS} SELECT qid, list_min(list_filter(list_transform(gold, lambda g: list_position(context, g)), lambda x: x > 0)) AS first_hit FROM recs WHERE variant = 'full' AND len(gold) > 0")
def retrieval_mrr(spark: SparkSession, folder: str) -> DataFrame:
    """At which rank the first reference passage of a question stands."""
    _, out = _full(spark, folder)
    at = F.array_min(F.filter(F.transform("gold_chunk_ids", lambda g: F.array_position("context", g)), lambda p: p > 0))
    return out.records.where(F.size("gold_chunk_ids") > 0).select("qid", at.alias("first_hit"))


@query(f"WITH {RECORDS} SELECT generator, count(*) AS n, NOT ({_REAL}) AS synthetic FROM recs WHERE variant = 'full' AND generator IS NOT NULL GROUP BY generator")
def generator_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Who made the answers."""
    q, p = checkpointed(gold(spark, folder)), stored(passages(spark, folder).select("chunk_id", "text"))
    *_, made = flow.reply(q, p, flow.rank(q, p, Config()), Config(), recorded(table(spark, folder, "human_grades")))
    return metrics.generator_mix(made)


@query(f"""WITH {RECORDS}, m AS (SELECT generator, count(*) AS n, {_REAL} AS real FROM recs WHERE variant = 'full' AND generator IS NOT NULL GROUP BY generator)
  SELECT sum(n)::BIGINT AS answers, coalesce(sum(n) FILTER (WHERE NOT real), 0)::BIGINT AS synthetic, count(*) FILTER (WHERE real) AS models, count(*) FILTER (WHERE real) > 1 AS mixed FROM m""")
def generator_warning(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers no model made, and whether several models did."""
    return metrics.generator_warning(generator_mix(spark, folder))


_TRACE_SQL = f"""WITH {RECORDS},
l1 AS (SELECT qid, string_agg(chunk_id, ' ' ORDER BY rank) AS dense_candidates FROM dense GROUP BY qid), l2 AS (SELECT qid, string_agg(chunk_id, ' ' ORDER BY rank) AS bm25_candidates FROM bm25 GROUP BY qid),
l3 AS (SELECT qid, string_agg(chunk_id || '=' || printf('%.6f', score), ' ' ORDER BY rank) AS rrf_fused FROM fused GROUP BY qid), l4 AS (SELECT qid, string_agg(chunk_id || '=' || printf('%.6f', score), ' ' ORDER BY rank) AS reranked FROM reranked GROUP BY qid),
l5 AS (SELECT qid, string_agg(printf('%s|%s|%.6f|%s', claim, CASE WHEN supported THEN 'true' ELSE 'false' END, score, array_to_string(precise, ' ')), ' / ' ORDER BY pos) AS verdicts FROM verdict WHERE variant = 'full' GROUP BY qid),
l6 AS (SELECT qid, string_agg(quote, ' / ' ORDER BY pos) AS ungrounded_quotes FROM claims WHERE variant = 'full' AND NOT is_grounded GROUP BY qid)
SELECT regexp_replace(qid, '[^A-Za-z0-9_.-]', '_', 'g') AS stem, qid, question, coalesce(dense_candidates, '') AS dense_candidates, coalesce(bm25_candidates, '') AS bm25_candidates, coalesce(rrf_fused, '') AS rrf_fused, coalesce(reranked, '') AS reranked,
  array_to_string(context, ' ') AS context_injected, coalesce(verdicts, '') AS verdicts, coalesce(ungrounded_quotes, '') AS ungrounded_quotes, dropped AS dropped_claims, answer AS answer_text, abstained, reason AS abstain_reason
FROM recs LEFT JOIN l1 USING (qid) LEFT JOIN l2 USING (qid) LEFT JOIN l3 USING (qid) LEFT JOIN l4 USING (qid) LEFT JOIN l5 USING (qid) LEFT JOIN l6 USING (qid) WHERE variant = 'full'"""


@query(_TRACE_SQL)
def trace_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The trace of every gold question, its lists as text."""
    q, out = _full(spark, folder)
    joined = lambda c, sep=" ": F.array_join(F.coalesce(c, F.expr("cast(array() as array<string>)")), sep)
    scored = lambda c: joined(F.transform(c, lambda x: F.format_string("%s=%.6f", x["chunk_id"], x["score"])))
    verdict = F.transform("verdicts", lambda v: F.format_string("%s|%s|%.6f|%s", v["claim_text"], v["supported"].cast("string"), v["score"], F.array_join(v["precise_citations"], " ")))
    return flow.trace_fields(q, out).select(
        fn.trace_stem(F.col("qid"), F.col("question")).alias("stem"), "qid", "question", joined(F.col("dense_candidates")).alias("dense_candidates"), joined(F.col("bm25_candidates")).alias("bm25_candidates"),
        scored("rrf_fused").alias("rrf_fused"), scored("reranked").alias("reranked"), joined(F.col("context_injected")).alias("context_injected"), joined(verdict, " / ").alias("verdicts"),
        joined(F.col("ungrounded_quotes"), " / ").alias("ungrounded_quotes"), joined(F.col("dropped_claims"), " / ").alias("dropped_claims"), "answer_text", "abstained", "abstain_reason",
    )


# ---- calibration on questions, grading, integrity -------------------------

H = latest_sql("holdout", "qid", "added_at", ["question", "is_answerable", "gold_answer", "gold_chunk_ids", "bucket", "split"], "WHERE question IS NOT NULL")
CALIBRATED = f"SELECT qid, question, is_answerable FROM ({G}) UNION ALL SELECT qid, question, is_answerable FROM ({H}) WHERE coalesce(split, '') <> 'holdout'"
SIGNALS = f"{reranked_sql(CALIBRATED)}, s AS MATERIALIZED (SELECT q.qid, coalesce(is_answerable, false) AS label, coalesce(max(r.score), 0) AS score FROM q LEFT JOIN reranked r USING (qid) GROUP BY ALL)"


def _signals(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieval signals of the questions that thresholds may be set on."""
    columns = ["qid", "question", "is_answerable"]
    held = answers.latest(table(spark, folder, "holdout").where("question is not null").select("qid", "added_at", "question", "is_answerable", "gold_answer", "gold_chunk_ids", "bucket", "split"), "qid", "added_at")
    q = checkpointed(gold(spark, folder).select(*columns).unionByName(held.where(metrics.usable_for_calibration(F.col("split"))).select(*columns)))
    p = stored(passages(spark, folder).select("chunk_id", "text"))
    reranked = retrieval.rerank(flow.rank(q, p, Config()).fused(Config()), q, p, _R.final_k)
    signal = answers.gate_a(q, reranked, _A.min_rerank_score).select("qid", F.col("signal").alias("score"))
    return q.select("qid", F.coalesce("is_answerable", F.lit(False)).alias("label")).join(signal, "qid")


_CALIBRATE = _SWEEP.replace(_LABELLED, SIGNALS)


@query(f"WITH {_CALIBRATE} SELECT * FROM rates")
def calibration_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Thresholds of gate A over the questions not held out."""
    return metrics.sweep(_signals(spark, folder))


@query(f"""WITH {SIGNALS} SELECT count(*) FILTER (WHERE label) AS n_answerable, round(min(score) FILTER (WHERE label), 6) AS min_answerable, round(max(score) FILTER (WHERE label), 6) AS max_answerable,
  count(*) FILTER (WHERE NOT label) AS n_unanswerable, round(min(score) FILTER (WHERE NOT label), 6) AS min_unanswerable, round(max(score) FILTER (WHERE NOT label), 6) AS max_unanswerable,
  coalesce(min(score) FILTER (WHERE label) > max(score) FILTER (WHERE NOT label), false) AS separable FROM s""")
def calibration_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of answerable and unanswerable questions, and whether one threshold parts them."""
    return metrics.separability(_signals(spark, folder))


@query(f"WITH {_SWEEP} SELECT round(tau, 4) AS best_tau FROM rates ORDER BY accuracy DESC, tau LIMIT 1")
def verifier_best_tau(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest threshold of best accuracy on the verifier bench."""
    return metrics.best_tau(metrics.sweep(_scored(spark, folder)))


@query(f"WITH c AS ({C}), e AS (SELECT claim_id, unnest(citations) AS chunk_id FROM c) SELECT chunk_id, count(DISTINCT claim_id) AS claims FROM e WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY chunk_id")
def bench_missing_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Passages that the verifier bench cites but nobody delivered."""
    return answers.missing_citations(claims(spark, folder), table(spark, folder, "chunks"))


@query("SELECT qid FROM gold WHERE qid IS NOT NULL INTERSECT SELECT qid FROM holdout")
def split_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Question ids in both the training and the evaluation splits; there should be none."""
    return table(spark, folder, "gold").where("qid is not null").select("qid").intersect(table(spark, folder, "holdout").select("qid"))


@query(f"""WITH {SCORED}, t AS (SELECT claim, verdict.* FROM verdict JOIN held USING (claim_id) WHERE claim IS NOT NULL), l AS (SELECT claim, arg_max(supported, claim_id) AS supported, round(arg_max(score, claim_id), 6) AS score FROM t GROUP BY claim)
  SELECT vid, l.supported, l.score FROM (SELECT DISTINCT vid, claim FROM verifier_bench WHERE claim IS NOT NULL) JOIN l USING (claim)""")
def verdict_by_text(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of each claim by its text; of several claims of one text the last counts."""
    shown = table(spark, folder, "verifier_bench").where("claim is not null").select("vid", "claim").distinct()
    return answers.verdict_by_text(shown, _verdicts(spark, folder)).select("vid", "supported", F.round("score", 6).alias("score"))


@query(f"""WITH {RECORDS}, g AS (SELECT * FROM (SELECT qid, agent_answer AS old_answer, grade AS old_grade, row_number() OVER (PARTITION BY qid ORDER BY graded_at DESC NULLS LAST, grade_id DESC NULLS LAST, agent_answer DESC NULLS LAST, grade DESC NULLS LAST) AS k FROM human_grades WHERE grade IS NOT NULL AND qid IS NOT NULL) WHERE k = 1),
  m AS (SELECT qid, question FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY added_at DESC NULLS LAST, question DESC) AS k FROM (SELECT qid, added_at, question FROM holdout WHERE question IS NOT NULL UNION ALL SELECT qid, added_at, question FROM gold WHERE question IS NOT NULL AND source IS NOT NULL)) WHERE k = 1)
  SELECT r.qid, coalesce(m.question, '(question text not found)') AS question, gold_answer, answer AS agent_answer, CASE WHEN old_grade IS NOT NULL AND old_answer IS NOT DISTINCT FROM answer THEN old_grade END AS grade,
    CASE WHEN old_grade IS NULL THEN 'ungraded' WHEN old_answer IS NOT DISTINCT FROM answer THEN 'carried' ELSE 'reset' END AS outcome
  FROM recs r LEFT JOIN g USING (qid) LEFT JOIN m ON m.qid = r.qid WHERE variant = 'full' AND is_answerable AND NOT abstained AND coalesce(gold_answer, '') <> ''""")
def grade_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Answers for a person to grade; questions are looked up in the sets whose source is known."""
    _, out = _full(spark, folder)
    known = table(spark, folder, "gold").where("source is not null").select("qid", "added_at", "question").unionByName(table(spark, folder, "holdout").select("qid", "added_at", "question"))
    questions = answers.latest(known.where("question is not null"), "qid", "added_at")
    h = table(spark, folder, "human_grades").where("grade is not null and qid is not null").select("qid", "graded_at", "grade_id", "agent_answer", "grade")
    return flow.grade_sheet(out.records, questions, answers.latest(h, "qid", "graded_at"))


@query(f"""WITH g AS (SELECT avg({recall_sql("coalesce(gold_answer, '')", "coalesce(agent_answer, '')")}) FILTER (WHERE grade = 'correct') - avg({recall_sql("coalesce(gold_answer, '')", "coalesce(agent_answer, '')")}) FILTER (WHERE grade = 'wrong') AS gap FROM human_grades)
  SELECT round(gap, 4) AS gap, gap >= 0.25 AS separates FROM g""")
def grade_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Whether token recall parts correct answers from wrong ones."""
    return metrics.grade_gap(table(spark, folder, "human_grades"))


@query(f"""WITH {RERANKED}, b AS (SELECT qid, string_agg('[' || r.chunk_id || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM reranked r JOIN p USING (chunk_id) GROUP BY qid)
  SELECT qid, length(context) AS context_chars, sha256(context) AS context_hash FROM b""")
def prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    """The passages of each question's prompt."""
    q, p, r = _reranked(spark, folder)
    made = answers.prompts(q, r, p)
    inner = F.regexp_extract("prompt", r"(?s)\A.*?\n\n(.*)\n\nQuestion: ", 1)
    return made.select("qid", F.length(inner).alias("context_chars"), F.sha2(inner, 256).alias("context_hash"))
