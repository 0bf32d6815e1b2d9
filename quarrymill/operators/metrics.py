"""Measures of answers, retrieval and verifiers, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_recall
from .lineage import checkpointed

#: Ranges of a score in [0, 1] for running totals in two steps.
RANGES = 4096
GRADES = ("correct", "partial", "wrong")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing in nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(records: DataFrame, *by: str) -> DataFrame:
    """Counts of right and wrong answers and abstentions, from is_answerable and abstained."""
    can, not_ = F.coalesce(F.col("is_answerable"), F.lit(False)), F.coalesce(F.col("abstained"), F.lit(False))
    counts = records.groupBy(*by).agg(F.count_if(can & ~not_).alias("ta"), F.count_if(~can & ~not_).alias("fa"), F.count_if(can & not_).alias("fr"), F.count_if(~can & not_).alias("tr"))
    ta, fa, fr, tr = (F.col(c) for c in ("ta", "fa", "fr", "tr"))
    return counts.select(
        *by, "ta", "fa", "fr", "tr", F.round(ratio(ta + tr, ta + fa + fr + tr), 4).alias("accuracy"),
        F.round(ratio(fa, fa + tr), 4).alias("false_answer_rate"), F.round(ratio(fr, fr + ta), 4).alias("over_refusal_rate"),
    )


def citation_scores(records: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 of cited against reference passages over answerable records."""
    some = records.where("is_answerable")
    none = F.expr("cast(array() as array<string>)")
    said, gold = F.array_distinct(F.coalesce("predicted_chunk_ids", none)), F.array_distinct(F.coalesce("gold_chunk_ids", none))
    sums = some.groupBy(*by).agg(
        F.count("*").alias("questions_scored"), F.coalesce(F.sum(F.size(F.array_intersect(said, gold))), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.size(said)), F.lit(0)).alias("citations_predicted"), F.coalesce(F.sum(F.size(gold)), F.lit(0)).alias("citations_gold"),
    )
    p, r = ratio(F.col("hits"), F.col("citations_predicted")), ratio(F.col("hits"), F.col("citations_gold"))
    return sums.select(*by, "questions_scored", "citations_predicted", "citations_gold", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def answer_recall(records: DataFrame, *by: str) -> DataFrame:
    """Mean share of the reference answer's words that the answers have."""
    some = records.where("is_answerable and coalesce(gold_answer, '') <> ''")
    score = token_recall(F.col("gold_answer"), F.coalesce("answer_text", F.lit("")))
    return some.groupBy(*by).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 4).alias("mean_token_recall"), F.count("*").alias("questions_scored"))


def retrieval_scores(records: DataFrame, *by: str) -> DataFrame:
    """Hit rate and mean reciprocal rank of the first reference passage in the context."""
    some = records.where("is_answerable and size(gold_chunk_ids) > 0")
    at = F.array_min(F.filter(F.transform("gold_chunk_ids", lambda g: F.array_position("context", g)), lambda p: p > 0))
    ranked = some.withColumn("at", at)
    return ranked.groupBy(*by).agg(
        F.round(F.coalesce(F.avg(F.col("at").isNotNull().cast("int")), F.lit(0.0)), 4).alias("recall_at_k"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))), F.lit(0.0)), 4).alias("mrr"), F.count("*").alias("questions_scored"),
    )


def consistency(verdicts: DataFrame, *by: str) -> DataFrame:
    """Share of supported claims, and of citations that are needed."""
    sums = verdicts.groupBy(*by).agg(
        F.count("*").alias("claims"), F.count_if("supported").alias("entailed"), F.coalesce(F.sum(F.greatest(F.size("citations"), F.lit(0))), F.lit(0)).alias("cited"), F.coalesce(F.sum(F.size("precise_citations")), F.lit(0)).alias("needed")
    )
    return sums.select(*by, "claims", F.round(ratio(F.col("entailed"), F.col("claims")), 4).alias("entailed_rate"), F.round(ratio(F.col("needed"), F.col("cited")), 4).alias("citation_necessity"))


def score_totals(scored: DataFrame, thresholds: bool = False) -> DataFrame:
    """(score, pos, neg, is_tau, pos_below, neg_below) of every distinct score, from rows
    (score in [0, 1], label), and, if asked for, of the thresholds 0 and just above
    each score, which count no rows themselves.

    pos_below and neg_below count the rows of smaller scores.  The running totals
    are taken over ranges of the score first and then within each range, so that
    no task sorts all scores."""
    some = scored.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    per = some.groupBy("score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    own = F.struct("score", "pos", "neg", F.lit(False).alias("is_tau"))
    tau = lambda x: F.struct(x.alias("score"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg"), F.lit(True).alias("is_tau"))
    if thresholds:
        each = per.select(F.explode(F.array(own, tau(F.round(F.col("score") + 1e-6, 6)), tau(F.lit(0.0)))).alias("r")).select("r.*")
        per = each.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_tau").alias("is_tau"))
    else:
        per = per.withColumn("is_tau", F.lit(False))
    per = checkpointed(per.withColumn("range", F.floor(F.col("score") * RANGES)))
    ranges = per.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    every = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 2 rows
    before = ranges.select("range", F.coalesce(F.sum("p").over(every), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(every), F.lit(0)).alias("n0"))
    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    joined = per.join(before, "range")
    below = lambda start, c: (F.col(start) + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below")
    return joined.select("score", "pos", "neg", "is_tau", below("p0", "pos"), below("n0", "neg"))


def auroc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counting half; 0.5 with fewer than two classes."""
    t = score_totals(scored)
    wins = F.sum((F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).cast("double"))
    sums = t.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"), wins.alias("wins"))
    area = F.try_divide(F.col("wins"), F.col("n_pos") * F.col("n_neg"))
    return sums.select("n_pos", "n_neg", F.round(F.coalesce(area, F.lit(0.5)), 4).alias("auroc"))


def usable_for_calibration(split: Column) -> Column:
    """Whether thresholds may be set on a question: not on those held out."""
    return F.coalesce(split, F.lit("")) != "holdout"


def sweep(scored: DataFrame) -> DataFrame:
    """(tau, false_answer_rate, over_refusal_rate, accuracy) of every threshold that
    changes anything: 0 and just above each score.  Rows answer if their score
    reaches tau; label says whether they should.

    A threshold may lie above other scores than its own, so it is put into the order
    of the scores and counted there."""
    t = score_totals(scored, thresholds=True)
    sums = t.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    below = t.where("is_tau").select(F.col("score").alias("tau"), F.col("pos_below").alias("fr"), F.col("neg_below").alias("tr"))
    return _rates(below.join(F.broadcast(sums), how="cross"))  # one row


def _rates(counts: DataFrame) -> DataFrame:
    ta, fa = F.col("p") - F.col("fr"), F.col("n") - F.col("tr")
    return counts.select(
        "tau", F.round(ratio(fa, F.col("n")), 4).alias("false_answer_rate"), F.round(ratio(F.col("fr"), F.col("p")), 4).alias("over_refusal_rate"),
        F.round(ratio(ta + F.col("tr"), F.col("p") + F.col("n")), 4).alias("accuracy"),
    )


def best_threshold(rates: DataFrame) -> DataFrame:
    """The threshold of best accuracy, then lowest false answer rate, then lowest tau."""
    best = rates.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "false_answer_rate", "tau", "over_refusal_rate", "accuracy")).alias("b"))
    return best.where("b is not null").select("b.tau", "b.false_answer_rate", "b.over_refusal_rate", "b.accuracy")


def grid(scored: DataFrame, steps: int = 200) -> DataFrame:
    """The rates at tau = 0, 1/steps ... 1."""
    some = checkpointed(scored.where(F.col("score").isNotNull() & F.col("label").isNotNull()).groupBy("score", "label").agg(F.count("*").alias("c")))
    # the first k whose tau = k / steps lies above the score
    near = F.round(F.col("score") * steps).cast("int")
    first = F.when(near / F.lit(float(steps)) <= F.col("score"), near + 1).otherwise(near)
    per = some.groupBy(first.alias("k")).agg(F.sum(F.when(F.col("label"), F.col("c")).otherwise(0)).alias("pos"), F.sum(F.when(~F.col("label"), F.col("c")).otherwise(0)).alias("neg"))
    taus = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    upto = Window.partitionBy(F.lit(1)).orderBy("k")  # steps + 1 rows
    sums = per.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("p"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n"))
    filled = taus.join(per, "k", "left").fillna(0, ["pos", "neg"])
    running = filled.select((F.col("k") / F.lit(float(steps))).alias("tau"), F.sum("pos").over(upto).alias("fr"), F.sum("neg").over(upto).alias("tr"))
    return _rates(running.join(F.broadcast(sums), how="cross"))  # one row


def verifier_scores(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, means and separation of a verifier's scores against labels."""
    yes, hit = F.col("label"), F.col("score") >= threshold
    some = scored.where(F.col("score").isNotNull() & F.col("label").isNotNull())
    c = some.agg(
        F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & hit).alias("fp"), F.count_if(~yes & ~hit).alias("tn"),
        F.round(F.coalesce(F.avg(F.when(yes, F.col("score"))), F.lit(0.0)), 4).alias("mean_pos"), F.round(F.coalesce(F.avg(F.when(~yes, F.col("score"))), F.lit(0.0)), 4).alias("mean_neg"),
        F.round(F.min(F.when(yes, F.col("score"))) - F.max(F.when(~yes, F.col("score"))), 4).alias("separation"),
    )
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return c.select("*", F.round(ratio(tp + tn, tp + fn + fp + tn), 4).alias("accuracy"), F.round(ratio(tp, tp + fn), 4).alias("recall"), F.round(ratio(tn, tn + fp), 4).alias("specificity"))


def describe(scored: DataFrame, *by: str) -> DataFrame:
    """Count, least, mean and greatest score of each group."""
    return scored.groupBy(*by).agg(F.count("score").alias("n"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"))


def grade_scores(graded: DataFrame) -> DataFrame:
    """(grade, n, share, mean_token_recall) of each grade, and how far token recall
    and the grades disagree is read from its rows.  Null grades are not counted."""
    some = graded.where(F.col("grade").isNotNull())
    unknown = some.where(~F.col("grade").isin(*GRADES))
    per = some.groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg(token_recall(F.coalesce("gold_answer", F.lit("")), F.coalesce("agent_answer", F.lit("")))), 4).alias("mean_token_recall"))
    domain = graded.sparkSession.createDataFrame([(g,) for g in GRADES], "grade string")
    named = domain.unionByName(unknown.select("grade").distinct()).distinct()
    total = some.agg(F.count("*").alias("total"))
    joined = named.join(per, "grade", "left").fillna(0, ["n"]).join(F.broadcast(total), how="cross")  # one row
    return joined.select("grade", "n", F.round(ratio(F.col("n"), F.col("total")), 4).alias("share"), "mean_token_recall")


def grade_summary(graded: DataFrame) -> DataFrame:
    """Strict and lenient scores: correct answers, and partial ones counting half."""
    some = graded.where(F.col("grade").isin(*GRADES))
    right, half = F.count_if(F.col("grade") == "correct"), F.count_if(F.col("grade") == "partial")
    return some.agg(F.count("*").alias("n"), F.round(ratio(right, F.count("*")), 4).alias("strict"), F.round(ratio(right + half / 2, F.count("*")), 4).alias("lenient"))


def carried_grades(answers: DataFrame, graded: DataFrame) -> DataFrame:
    """answers (qid, agent_answer) with the earlier grade of the same question,
    carried over only if the answer is unchanged; outcome says which."""
    before = graded.where(F.col("grade").isNotNull()).select("qid", F.col("agent_answer").alias("old_answer"), F.col("grade").alias("old_grade"))
    joined = answers.join(before, "qid", "left")
    same = F.col("old_answer").eqNullSafe(F.col("agent_answer"))
    outcome = F.when(F.col("old_grade").isNull(), "ungraded").when(same, "carried").otherwise("reset")
    return joined.select("qid", "agent_answer", F.when(outcome == "carried", F.col("old_grade")).alias("grade"), outcome.alias("outcome"))


def generator_mix(answers: DataFrame, *by: str) -> DataFrame:
    """(generator, n, synthetic): answers by generator, and whether no model made them."""
    return answers.groupBy(*by, "generator").agg(F.count("*").alias("n")).withColumn("synthetic", is_synthetic(F.col("generator")))


def is_synthetic(generator: Column) -> Column:
    """Whether no model made an answer just now."""
    return F.startswith(generator, F.lit("extractive-fallback")) | generator.isin("cache", "none", "unknown")


def model_answers(records: DataFrame, *by: str) -> DataFrame:
    """(model_answers): answers that models made, with cached ones apart, of all made."""
    made, cached = F.col("generator").isNotNull(), F.col("generator") == "cache"
    counts = records.groupBy(*by).agg(F.count_if(made & ~is_synthetic(F.col("generator"))).alias("r"), F.count_if(made & cached).alias("c"), F.count_if(made).alias("t"))
    text = F.when(F.col("c") > 0, F.format_string("%d+%dc/%d", "r", "c", "t")).otherwise(F.format_string("%d/%d", "r", "t"))
    return counts.select(*by, text.alias("model_answers"))


def generator_warning(mix: DataFrame) -> DataFrame:
    """(answers, synthetic, models, mixed) from (generator, n, synthetic): answers that no
    model made, and whether several models made the others."""
    sums = mix.agg(F.sum("n").alias("answers"), F.coalesce(F.sum(F.when(F.col("synthetic"), F.col("n"))), F.lit(0)).alias("synthetic"), F.count_if(~F.col("synthetic")).alias("models"))
    return sums.withColumn("mixed", F.col("models") > 1)


def separability(scored: DataFrame) -> DataFrame:
    """Count, least and greatest score of each class, and whether one threshold parts them;
    not separable where a class is empty."""
    yes, no = F.col("label"), ~F.col("label")
    pick = lambda when: F.when(when, F.col("score"))
    return scored.agg(
        F.count_if(yes).alias("n_answerable"), F.round(F.min(pick(yes)), 6).alias("min_answerable"), F.round(F.max(pick(yes)), 6).alias("max_answerable"),
        F.count_if(no).alias("n_unanswerable"), F.round(F.min(pick(no)), 6).alias("min_unanswerable"), F.round(F.max(pick(no)), 6).alias("max_unanswerable"),
        F.coalesce(F.min(pick(yes)) > F.max(pick(no)), F.lit(False)).alias("separable"),
    )


def best_tau(rates: DataFrame) -> DataFrame:
    """(best_tau): the lowest threshold of best accuracy."""
    best = rates.agg(F.min(F.struct((-F.col("accuracy")).alias("a"), "tau")).alias("b"))
    return best.where("b is not null").select(F.round("b.tau", 4).alias("best_tau"))


def grade_gap(graded: DataFrame, least: float = 0.25) -> DataFrame:
    """(gap, separates): mean token recall of correct less that of wrong answers; null
    where either has none."""
    recall = token_recall(F.coalesce("gold_answer", F.lit("")), F.coalesce("agent_answer", F.lit("")))
    gap = graded.agg((F.avg(F.when(F.col("grade") == "correct", recall)) - F.avg(F.when(F.col("grade") == "wrong", recall))).alias("g"))
    return gap.select(F.round("g", 4).alias("gap"), (F.col("g") >= least).alias("separates"))


def checked_grades(graded: DataFrame) -> DataFrame:
    """The graded rows, if every grade is known; else an error that names some of the rest."""
    unknown = graded.where(F.col("grade").isNotNull() & ~F.col("grade").isin(*GRADES)).select("qid").distinct().limit(20).collect()
    if unknown:
        raise ValueError("unknown grades for " + ", ".join(sorted(str(r.qid) for r in unknown)))
    return graded
