"""The whole flow for a batch of questions, and its ablations.

retrieve -> fuse -> rerank -> gate A -> answer -> ground -> verify -> gate B -> prune,
each stage a DataFrame.  Questions that gate A stops never reach the answering stage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import trace_stem
from ..operators import answers, metrics, retrieval
from ..operators.lineage import checkpointed, stored

#: Settings of the ablations, each adding a stage to the one before.
VARIANTS: dict[str, dict[str, bool]] = {
    "dense": {"retrieval.hybrid": False, "rerank.enabled": False, "verify.enabled": False, "abstain.gate_a": False, "abstain.gate_b": False},
    "hybrid": {"retrieval.hybrid": True, "rerank.enabled": False, "verify.enabled": False, "abstain.gate_a": False, "abstain.gate_b": False},
    "rerank_gate_a": {"retrieval.hybrid": True, "rerank.enabled": True, "verify.enabled": False, "abstain.gate_a": True, "abstain.gate_b": False},
    "full": {"retrieval.hybrid": True, "rerank.enabled": True, "verify.enabled": True, "abstain.gate_a": True, "abstain.gate_b": True},
}

#: Answers (qid, insufficient, generator, claims) to questions, from their reranked passages.
Generator = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Rankings:
    """Candidates of the questions, shared by all variants."""

    dense: DataFrame
    lexical: DataFrame

    def fused(self, config: Config) -> DataFrame:
        """Both rankings fused; without hybrid search the dense one alone."""
        lexical = self.lexical if config.retrieval.hybrid else self.lexical.where("false")
        return retrieval.fuse(self.dense, lexical, config.retrieval.rrf_k)


@dataclass(frozen=True)
class Outcome:
    rankings: Rankings
    fused: DataFrame
    reranked: DataFrame
    gate_a: DataFrame
    answers: DataFrame
    claims: DataFrame  # (qid, pos, claim, quote, citations, is_grounded)
    verdicts: DataFrame  # of the grounded claims
    records: DataFrame


def rank(questions: DataFrame, passages: DataFrame, config: Config, dense: DataFrame | None = None) -> Rankings:
    """Dense and lexical candidates.  A dense ranking (qid, chunk_id, rank) of a trained
    encoder may be given; else terms hashed into vectors stand in for it."""
    if dense is not None:
        return Rankings(checkpointed(dense), retrieval.bm25_top(questions, passages, config.retrieval.bm25_k))
    both = retrieval.search(questions, passages, config.retrieval.dense_k, config.retrieval.bm25_k)
    return Rankings(both.where("is_dense").drop("is_dense"), both.where("not is_dense").drop("is_dense"))


def extractive(questions: DataFrame, reranked: DataFrame, passages: DataFrame) -> DataFrame:
    """The default generator: the best passage."""
    return answers.as_claims(answers.extractive(questions, reranked, passages))


def reply(questions: DataFrame, passages: DataFrame, rankings: Rankings, config: Config, generator: Generator = extractive, reranked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The fused and the reranked passages, gate A, and the answers of the questions that it lets through.

    The answers are not written here: who only counts them moves no text."""
    c = config
    fused = rankings.fused(config)
    if reranked is None:
        reranked = checkpointed(retrieval.rerank(fused, questions, passages, c.retrieval.final_k, enabled=c.rerank.enabled))
    first = answers.gate_a(questions, reranked, c.abstain.min_rerank_score, c.abstain.gate_a)
    through = questions.join(first.where("not abstained").select("qid"), "qid", "left_semi")
    return fused, reranked, first, generator(through, reranked, passages)


def answer(questions: DataFrame, passages: DataFrame, rankings: Rankings, config: Config, generator: Generator = extractive, reranked: DataFrame | None = None) -> Outcome:
    """questions: (qid, question, is_answerable, gold_answer, gold_chunk_ids, bucket).

    Claims whose quote stands in none of their passages are dropped before they are
    verified; claims that are not supported are dropped once gate B lets the answer
    through.  reranked may be given where it is known from an outcome of the same search."""
    c = config
    fused, reranked, first, made = reply(questions, passages, rankings, config, generator, reranked)
    made = checkpointed(made)
    each = made.select("qid", F.posexplode("claims").alias("pos", "c")).select(F.concat_ws("#", "qid", "pos").alias("claim_id"), "qid", "pos", F.col("c.text").alias("claim"), F.col("c.quote").alias("quote"), F.col("c.citations").alias("citations"))
    # texts are moved once, for the passages that are cited, and not again for each use of theirs
    named = each.select(F.explode("citations").alias("chunk_id")).distinct()
    used = stored(passages.select("chunk_id", "doc_id", "doc_title", "text").join(named, "chunk_id", "left_semi"))
    claims = checkpointed(answers.ground(each, used))
    grounded = claims.where("is_grounded").drop("is_grounded")
    verdicts = checkpointed(answers.verify(grounded, used, c.verify.support_threshold, c.verify.premise_window_chars, c.verify.enabled))
    second = answers.gate_b(made.select(F.col("qid").alias("answer_id"), "insufficient"), verdicts.withColumnRenamed("qid", "answer_id"), c.abstain.min_supported_claims, c.abstain.gate_b)
    context = reranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c")).select("qid", F.col("c.chunk_id").alias("context"))
    kept = verdicts.where("supported").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "claim", "citations"))).alias("k"))
    lost = verdicts.where("not supported").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "claim"))).alias("d"))
    none = F.expr("cast(array() as array<string>)")
    joined = (
        questions.join(first.select("qid", "n_passages", "signal", F.col("abstained").alias("at_a")), "qid")
        .join(second.select(F.col("answer_id").alias("qid"), F.col("abstained").alias("at_b")), "qid", "left")
        .join(made.select("qid", "generator"), "qid", "left").join(kept, "qid", "left").join(lost, "qid", "left").join(context, "qid", "left")
    )
    out = F.col("at_a") | F.coalesce("at_b", F.lit(False))
    reason = F.when(F.col("n_passages") == 0, "no_candidates").when(F.col("at_a"), "gate_a").when(F.col("at_b"), "gate_b")
    records = joined.select(
        "qid", "bucket", F.coalesce("is_answerable", F.lit(False)).alias("is_answerable"), "gold_answer", F.coalesce("gold_chunk_ids", none).alias("gold_chunk_ids"), "signal", out.alias("abstained"), reason.alias("abstain_reason"),
        F.when(out, none).otherwise(F.array_sort(F.array_distinct(F.flatten(F.coalesce("k.citations", F.expr("cast(array() as array<array<string>>)")))))).alias("predicted_chunk_ids"),
        F.when(out, F.lit("")).otherwise(F.array_join(F.coalesce("k.claim", none), " ")).alias("answer_text"), F.coalesce("context", none).alias("context"), "generator",
        F.when(out, none).otherwise(F.coalesce("d.claim", none)).alias("dropped_claims"),
    )
    return Outcome(rankings, fused, reranked, first, made, claims, verdicts, records)


def ladder(questions: DataFrame, passages: DataFrame, config: Config, dense: DataFrame | None = None, generator: Generator = extractive) -> dict[str, Outcome]:
    """The outcome of every variant, by its name."""
    rankings = rank(questions, passages, config, dense)
    outcomes: dict[str, Outcome] = {}
    known: dict[tuple[bool, bool], DataFrame] = {}  # what the variants of one search have in common
    for name, settings in VARIANTS.items():
        c = config.with_overrides(settings)
        search = c.retrieval.hybrid, c.rerank.enabled
        outcomes[name] = answer(questions, passages, rankings, c, generator, known.get(search))
        known[search] = outcomes[name].reranked
    return outcomes


def ladder_records(outcomes: dict[str, Outcome]) -> DataFrame:
    """Records of every variant, with the variant's name."""
    out = None
    for name, o in outcomes.items():
        records = checkpointed(o.records).withColumn("variant", F.lit(name))
        out = records if out is None else out.unionByName(records)
    return out


def ladder_report(records: DataFrame) -> DataFrame:
    """One row of measures for each variant."""
    parts = [
        metrics.confusion(records, "variant"),
        metrics.citation_scores(records, "variant").select("variant", "precision", "recall", "f1"),
        metrics.retrieval_scores(records, "variant").select("variant", "recall_at_k", "mrr"),
        metrics.answer_recall(records, "variant").select("variant", "mean_token_recall"),
        metrics.model_answers(records, "variant"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "variant", "left")
    return out


def trace_fields(questions: DataFrame, outcome: Outcome) -> DataFrame:
    """What happened to each question, one column a field, lists in their order."""

    def listed(df: DataFrame, order: str, item: str, name: str) -> DataFrame:
        return df.select("qid", F.struct(F.col(order).alias("o"), F.col(item).alias("i")).alias(name))

    scored = lambda df: df.withColumn("item", F.struct("chunk_id", F.round("score", 6).alias("score")))
    o = outcome
    verdict = o.verdicts.withColumn("item", F.struct(F.col("claim").alias("claim_text"), "citations", "supported", F.round("score", 6).alias("score"), "precise_citations"))
    parts = [
        listed(o.rankings.dense, "rank", "chunk_id", "dense_candidates"), listed(o.rankings.lexical, "rank", "chunk_id", "bm25_candidates"), listed(scored(o.fused), "rank", "item", "rrf_fused"),
        listed(scored(o.reranked), "rank", "item", "reranked"), listed(verdict, "pos", "item", "verdicts"), listed(o.claims.where("not is_grounded"), "pos", "quote", "ungrounded_quotes"),
    ]
    names = [p.columns[1] for p in parts]
    # one grouping of all lists: a join and a sort for each would stand in one task with all others, which have no memory left there
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lists = rows.repartition("qid").groupBy("qid").agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in names])
    lists = lists.select("qid", *[F.when(F.size(n) > 0, F.col(f"{n}.i")).alias(n) for n in names])
    records = checkpointed(o.records.select("qid", F.col("context").alias("context_injected"), "abstained", "abstain_reason", "answer_text", "predicted_chunk_ids", "generator", "dropped_claims"))
    return questions.select("qid", "question").join(records, "qid").join(lists, "qid", "left")


def traces(questions: DataFrame, outcome: Outcome) -> DataFrame:
    """(stem, trace): what happened to each question, as JSON."""
    fields = trace_fields(questions, outcome)
    return fields.select(trace_stem(F.col("qid"), F.col("question")).alias("stem"), F.to_json(F.struct(*fields.columns)).alias("trace"))


def grade_sheet(records: DataFrame, questions: DataFrame, graded: DataFrame) -> DataFrame:
    """(qid, question, gold_answer, agent_answer, grade, outcome): the answers that a
    person can grade, of answerable questions with a reference answer; a question whose
    text is not among questions (qid, question) gets a stand-in; earlier grades are
    carried over where the answer is unchanged and reset otherwise."""
    some = records.where("is_answerable and not abstained and coalesce(gold_answer, '') <> ''")
    rows = some.select("qid", "gold_answer", F.col("answer_text").alias("agent_answer"))
    carried = metrics.carried_grades(rows.select("qid", "agent_answer"), graded).select("qid", "grade", "outcome")
    text = F.coalesce("question", F.lit("(question text not found)")).alias("question")
    return rows.join(questions.select("qid", "question"), "qid", "left").join(carried, "qid").select("qid", text, "gold_answer", "agent_answer", "grade", "outcome")


def signals(questions: DataFrame, outcome: Outcome) -> DataFrame:
    """(score, label): the retrieval signal of each question and whether it can be answered."""
    return questions.select("qid", F.coalesce("is_answerable", F.lit(False)).alias("label")).join(outcome.gate_a.select("qid", F.col("signal").alias("score")), "qid").select("qid", "score", "label")
