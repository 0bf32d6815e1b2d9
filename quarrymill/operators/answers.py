"""Answers and their claims: prompt, native answer, grounding, verification, gates.

Claims are rows (claim_id, claim, quote, citations); passages rows (chunk_id,
doc_id, doc_title, text).  Scorers take (premise, hypothesis) columns and give a
number in [0, 1]; by default that is the share of the hypothesis' words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_of, normalise_span, prompt_key, snippet, strip, with_title, word_overlap

Scorer = Callable[[Column, Column], Column]


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row of each key: the one of the latest time, of several the largest."""
    rest = [c for c in rows.columns if c not in (key, time)]
    best = rows.groupBy(key).agg(F.max(F.struct(time, *rest)).alias("r"))
    return best.select(key, f"r.{time}", *[f"r.{c}" for c in rest])


def cited(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """The claims with ``cited``, their known passages in the order of citation.

    Unknown citations are left out; a passage cited twice is there twice."""
    each = claims.select("claim_id", F.posexplode("citations").alias("pos", "chunk_id"))
    found = each.join(passages.select("chunk_id", "doc_id", "doc_title", "text"), "chunk_id")
    lists = found.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "doc_id", "doc_title", "text"))).alias("cited"))
    nothing = F.expr("cast(array() as array<struct<pos:int,chunk_id:string,doc_id:string,doc_title:string,text:string>>)")
    return claims.join(lists, "claim_id", "left").withColumn("cited", F.coalesce("cited", nothing))


def allowed_citations(citations: Column, known: Column) -> Column:
    """The citations that are known, in order, repeats kept."""
    return F.filter(citations, lambda c: F.array_contains(known, c))


def grounded(quote: Column, passages: Column) -> Column:
    """Whether a quote stands in its cited passages, white space, emphasis and case
    apart; it may run from one into the next.  No quote counts as grounded."""
    joined = F.array_join(F.transform(passages, lambda c: F.lower(normalise_span(c["text"]))), " ")
    return F.when(F.coalesce(quote, F.lit("")) == "", True).otherwise(F.contains(joined, F.lower(normalise_span(quote))))


def with_premise(held: DataFrame, pad: int) -> DataFrame:
    """held (quote, cited) with ``premise``, what a claim is held against: a window
    around its quote under the document's title, or all cited passages if there is
    no quote or no passage holds it."""
    texts = F.transform("cited", lambda c: F.struct(normalise_span(c["text"]).alias("text"), c["doc_title"].alias("doc_title")))
    ready = held.withColumn("__needle", F.lower(normalise_span(F.col("quote")))).withColumn("__texts", texts)
    holder = F.get(F.filter("__texts", lambda c: F.contains(F.lower(c["text"]), F.col("__needle"))), F.lit(0))
    found = ready.withColumn("__holder", F.when(F.coalesce("quote", F.lit("")) != "", holder))
    at = F.instr(F.lower(F.col("__holder.text")), F.col("__needle")) - 1
    placed = found.withColumn("__at", at)
    start = F.greatest(F.lit(0), F.col("__at") - pad)
    end = F.least(F.length("__holder.text"), F.col("__at") + F.length("__needle") + pad)
    window = with_title(F.col("__holder.doc_title"), strip(F.col("__holder.text").substr(start + 1, end - start)))
    joint = F.array_join(F.transform("cited", lambda c: c["text"]), "\n\n")
    one_document = F.size(F.array_distinct(F.transform("cited", lambda c: c["doc_id"]))) == 1
    whole = F.when(one_document, with_title(F.element_at("cited", -1)["doc_title"], joint)).otherwise(joint)
    chosen = F.when(F.coalesce("quote", F.lit("")) == "", whole).when(F.col("__holder").isNotNull(), window).otherwise(joint)
    return placed.withColumn("premise", chosen).drop("__needle", "__texts", "__holder", "__at")


def with_score(held: DataFrame, pad: int, scorer: Scorer = word_overlap) -> DataFrame:
    """held (claim, quote, cited) with ``score``; 0 without passages and for a blank
    premise or claim."""
    ready = with_premise(held, pad)
    blank = (F.size("cited") == 0) | (strip(F.col("premise")) == "") | (strip(F.coalesce("claim", F.lit(""))) == "")
    return ready.withColumn("score", F.when(blank, F.lit(0.0)).otherwise(F.round(scorer(F.col("premise"), F.col("claim")).cast("double"), 9))).drop("premise")


def verify(claims: DataFrame, passages: DataFrame, threshold: float = 0.5, pad: int = 160, enabled: bool = True, scorer: Scorer = word_overlap) -> DataFrame:
    """The claims with score, supported and precise_citations.

    A citation is precise if the claim is supported and without that passage is
    not.  Claims without known passages score 0 and are not supported.  Switched
    off, every claim is supported with score 1 and all citations are precise."""
    if not enabled:
        return claims.select("*", F.lit(1.0).alias("score"), F.lit(True).alias("supported"), F.col("citations").alias("precise_citations"))
    held = cited(claims, passages)
    judged = with_score(held, pad, scorer).withColumn("supported", F.col("score") >= threshold)
    # only supported claims can have needed citations; each citation is left out once
    each = judged.where("supported").select("claim_id", "claim", "quote", "cited", F.posexplode("citations").alias("pos", "cid"))
    less = each.withColumn("cited", F.filter("cited", lambda c: c["chunk_id"] != F.col("cid")))
    needed = with_score(less, pad, scorer).where(F.col("score") < threshold)
    lists = needed.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("pos", "cid"))).alias("n")).select("claim_id", F.col("n.cid").alias("precise_citations"))
    none = F.expr("cast(array() as array<string>)")
    return judged.drop("cited").join(lists, "claim_id", "left").withColumn("precise_citations", F.coalesce("precise_citations", none))


def gate_a(questions: DataFrame, reranked: DataFrame, threshold: float, enabled: bool = True) -> DataFrame:
    """(qid, n_passages, signal, abstained): whether retrieval is too weak to answer.

    Without passages a question abstains even if the gate is off."""
    best = reranked.groupBy("qid").agg(F.count("*").alias("n_passages"), F.max("score").alias("signal"))
    joined = questions.select("qid").join(best, "qid", "left").fillna({"n_passages": 0, "signal": 0.0})
    weak = (F.col("signal") < threshold) if enabled else F.lit(False)
    return joined.select("qid", "n_passages", "signal", ((F.col("n_passages") == 0) | weak).alias("abstained"))


def gate_b(answers: DataFrame, verdicts: DataFrame, least: int, enabled: bool = True) -> DataFrame:
    """(answer_id, n_claims, n_supported, abstained) from answers (answer_id,
    insufficient) and verdicts (answer_id, supported).

    An answer that calls its evidence insufficient abstains even if the gate is off."""
    counts = verdicts.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.count_if("supported").alias("n_supported"))
    joined = answers.join(counts, "answer_id", "left").fillna(0, ["n_claims", "n_supported"])
    few = (F.col("n_supported") < least) if enabled else F.lit(False)
    return joined.select("answer_id", "n_claims", "n_supported", (F.coalesce("insufficient", F.lit(False)) | few).alias("abstained"))


def extractive(questions: DataFrame, reranked: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, insufficient, claim, citations, generator): the best passage as the
    only claim; without passages the evidence is insufficient."""
    best = reranked.where("rank = 1").join(passages.select("chunk_id", "text"), "chunk_id")
    joined = questions.select("qid").join(best.select("qid", "chunk_id", "text"), "qid", "left")
    none = F.expr("cast(array() as array<string>)")
    return joined.select(
        "qid", F.col("chunk_id").isNull().alias("insufficient"), F.col("text").alias("claim"),
        F.when(F.col("chunk_id").isNull(), none).otherwise(F.array("chunk_id")).alias("citations"), F.lit("extractive-fallback").alias("generator"),
    )


def closest_passages(reranked: DataFrame, passages: DataFrame, n: int = 2) -> DataFrame:
    """(qid, closest): the n best passages with their scores, to show on abstention."""
    best = reranked.where(F.col("rank") <= n).join(passages.select("chunk_id", "text"), "chunk_id")
    line = F.format_string("[%s] (%.2f) %s", "chunk_id", "score", snippet(F.col("text")))
    lists = best.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lists.select("qid", F.array_join("l.line", "\n").alias("closest"))


def prompts(questions: DataFrame, reranked: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, prompt): the passages in rank order and the question, for a generator."""
    blocks = reranked.join(passages.select("chunk_id", "text"), "chunk_id").select("qid", "rank", F.concat(F.lit("["), "chunk_id", F.lit("] "), "text").alias("block"))
    context = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b")).select("qid", F.array_join("b.block", "\n\n").alias("context"))
    ask = F.concat(
        F.lit("Use only the numbered passages. Answer with claims, each citing passage ids and quoting the words it rests on.\n"),
        F.lit('Reply in JSON: {"insufficient_evidence": bool, "claims": [{"text": str, "citations": [str], "quote": str}]}.\n\n'),
        "context", F.lit("\n\nQuestion: "), "question",
    )
    return questions.select("qid", "question").join(context, "qid").select("qid", ask.alias("prompt"))


ANSWER_SCHEMA = "insufficient_evidence boolean, claims array<struct<text:string,citations:array<string>,quote:string>>, reasoning string"


def parsed_reply(reply: Column) -> Column:
    """The answer in a generator's reply, null if there is none."""
    return F.from_json(json_of(reply), ANSWER_SCHEMA)


def with_cache(asked: DataFrame, cache: DataFrame, provider: str) -> DataFrame:
    """asked (qid, prompt) with key and the cached reply, if any, whose generator is then "cache"."""
    keyed = asked.withColumn("key", prompt_key(F.lit(provider), F.col("prompt")))
    hit = keyed.join(cache.select("key", F.col("reply").alias("cached")), "key", "left")
    return hit.withColumn("generator", F.when(F.col("cached").isNotNull(), "cache"))


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache (key, reply, written_at) with newer replies in place of older ones."""
    return latest(cache.unionByName(new), "key", "written_at")


CLAIMS = "array<struct<text:string,citations:array<string>,quote:string>>"


def as_claims(made: DataFrame) -> DataFrame:
    """Answers of one claim (qid, insufficient, claim, citations, generator) in the form
    (qid, insufficient, generator, claims) that several claims take."""
    one = F.array(F.struct(F.col("claim").alias("text"), "citations", F.lit(None).cast("string").alias("quote")))
    return made.select("qid", "insufficient", "generator", F.when(F.col("claim").isNull(), F.expr(f"cast(array() as {CLAIMS})")).otherwise(one).alias("claims"))


def from_replies(replies: DataFrame, reranked: DataFrame, passages: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, insufficient, generator, claims) from replies (qid, insufficient, generator,
    claims): citations outside the question's passages are left out; questions without
    a reply get the extractive answer."""
    context = reranked.groupBy("qid").agg(F.collect_set("chunk_id").alias("known"))
    asked = questions.select("qid").join(context, "qid", "left").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<string>)")))
    kept = F.transform("claims", lambda c: F.struct(c["text"].alias("text"), allowed_citations(c["citations"], F.col("known")).alias("citations"), c["quote"].alias("quote")))
    given = replies.join(asked, "qid").select("qid", F.coalesce("insufficient", F.lit(False)).alias("insufficient"), "generator", kept.alias("claims"))
    rest = questions.join(replies.select("qid"), "qid", "left_anti")
    return given.unionByName(as_claims(extractive(rest, reranked, passages)))


def ground(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """The claims (claim_id, quote, citations, ...) with ``is_grounded``."""
    held = cited(claims, passages)
    return held.withColumn("is_grounded", grounded(F.col("quote"), F.col("cited"))).drop("cited")


def missing_citations(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, claims): cited passages that do not exist, and how many claims cite them."""
    each = claims.select("claim_id", F.explode("citations").alias("chunk_id"))
    lost = each.join(chunks.select("chunk_id"), "chunk_id", "left_anti")
    return lost.groupBy("chunk_id").agg(F.countDistinct("claim_id").alias("claims"))


def verdict_by_text(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claims (claim, ...) with supported and score of the verdict on the same text; of
    several verdicts on one text that of the greatest claim_id."""
    last = verdicts.where(F.col("claim").isNotNull()).groupBy("claim").agg(F.max_by(F.struct("supported", "score"), "claim_id").alias("v"))
    return claims.join(last.select("claim", "v.supported", "v.score"), "claim")
