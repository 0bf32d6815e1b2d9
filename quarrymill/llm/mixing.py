"""Mixing sources to target weights (problem 8): Pareto order sampling.

Sizes are tokens of the byte-level tokenizer: the UTF-8 bytes of a text and one
end token.  From the sizes of the sources and how often each may be repeated
follows how many tokens of each the mix takes.  That amount is certain whole
copies of the source and a remainder; the remainder is a sample of fixed size
with unequal probabilities, taken in the order of the Pareto ranks: random odds
divided by inclusion odds.  Where the order is cut follows from sums over narrow
ranges of the rank, so that no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges per doubling of the Pareto rank.
RANGES = 4096
#: Inclusion odds grow with this power of a document's size.
SIZE_POWER = 0.5


def token_count(text: Column) -> Column:
    """Tokens of a text; of a null text the end token alone."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def source_name(source: Column) -> Column:
    """The one spelling of a source: no blanks around it, lower case."""
    return F.lower(F.trim(source))


def allocate(available: dict[str, int], share: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that the mix takes of each source that has any.

    Without a total, the most tokens at which every source reaches its share
    exactly.  With one, the shares of the sources that run out at their cap go to
    the others in proportion."""
    caps = {s: available[s] * max(0, repeats[s]) for s in share if available.get(s, 0) > 0 and share[s] > 0}
    caps = {s: c for s, c in caps.items() if c > 0}
    if not caps:
        return {}
    if total is None:
        weight = sum(share[s] for s in caps)
        total = min(caps[s] * weight / share[s] for s in caps)
    left, open_, got = min(float(total), float(sum(caps.values()))), set(caps), {}
    while open_:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= caps[s]}
        if not full:
            return got | {s: left * share[s] / weight for s in open_}
        for s in full:
            got[s] = float(caps[s])
        left -= sum(caps[s] for s in full)
        open_ -= full
    return got


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents in the mix.

    Sources are compared without case and blanks around them; documents of null,
    blank or unlisted sources and with null text are left out; a listed source
    without documents gets nothing and its share goes to the others.  copies
    never exceeds max_repeats.  Ties of the rank are taken by doc_id; repeated
    rows of a doc_id count as one document; empty texts count one token."""
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sized = docs.select("doc_id", source_name(F.col("source")).alias("source"), token_count(F.col("text")).alias("n_tokens"))
    listed = targets.where(F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    sized = sized.join(listed.select("source").distinct(), "source", "left_semi")
    sized = sized.groupBy("doc_id").agg(F.min_by("source", "n_tokens").alias("source"), F.min("n_tokens").alias("n_tokens"))
    weight = F.pow(F.col("n_tokens").cast("double"), F.lit(SIZE_POWER))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(weight * F.col("n_tokens")).alias("weighted"))
    # one row for each row of the fixed table of targets
    plan = {r["source"]: r for r in listed.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).join(sums, "source").collect()}
    got = allocate({s: r["tokens"] for s, r in plan.items()}, {s: r["share"] or 0.0 for s, r in plan.items()}, {s: r["repeats"] or 0 for s, r in plan.items()}, total)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType()), T.StructField("scale", T.DoubleType())])
    rows = []
    for s, tokens in got.items():
        whole = int(tokens / plan[s]["tokens"] + 1e-9)
        rest = max(0.0, tokens - whole * plan[s]["tokens"])
        rows.append((s, whole, rest, rest / plan[s]["weighted"]))
    wanted = sized.join(sized.sparkSession.createDataFrame(rows, schema), "source")
    # Pareto rank: odds of a uniform number over the odds of inclusion
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**40)).cast("double") + 0.5) / F.lit(float(2**40))
    chance = F.least(F.col("scale") * weight, F.lit(1 - 1e-9))
    rank = F.when(chance > 0, (uniform / (1 - uniform)) / (chance / (1 - chance)))
    ranked = wanted.withColumn("rank", rank).withColumn("range", F.floor(F.log2("rank") * RANGES))
    ranges = ranked.where("rest > 0").groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("range"))
    edge = ranges.withColumn("before", upto - F.col("tokens")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
    edge = edge.select("source", F.col("range").alias("edge"), "before")
    near = ranked.join(edge, "source", "left")
    inside = near.where((F.col("rest") > 0) & (F.col("range") == F.col("edge")))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    # the document at the cut is taken if that comes nearer
    cut = inside.withColumn("running", running).where(F.col("running") - F.col("n_tokens") / 2 <= F.col("rest")).select("doc_id", F.lit(1).alias("at_cut"))
    taken = near.join(cut, "doc_id", "left")
    extra = F.when((F.col("rest") > 0) & (F.col("range") < F.col("edge")), 1).when(F.col("at_cut") == 1, 1).otherwise(0)
    return taken.select("doc_id", "source", "n_tokens", (F.col("whole") + extra).cast("int").alias("copies")).where("copies > 0")


def report(documents: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, mix_documents, mix_tokens,
    share_reached, most_copies) of every listed source."""
    listed = targets.where(F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    there = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).groupBy(source_name(F.col("source")).alias("source")).agg(F.countDistinct("doc_id").alias("documents"))
    used = mixed.groupBy("source").agg(F.count("*").alias("mix_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"), F.max("copies").alias("most_copies"))
    joined = listed.join(there, "source", "left").join(used, "source", "left").fillna(0, ["documents", "mix_documents", "mix_tokens", "most_copies"])
    total = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))
    reached = F.round(F.coalesce(F.try_divide(F.col("mix_tokens").cast("double"), total), F.lit(0.0)), 6)
    return joined.select("source", "target_share", "max_repeats", "documents", "mix_documents", "mix_tokens", reached.alias("share_reached"), "most_copies")
