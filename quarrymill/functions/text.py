"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and those that end a line.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0  -     　"
LINE_END = "\n\r\x0b\x0c\x1c\x1d\x1e\x85  "
# Words that do not count in a reference answer, and characters stripped from a word.
STOP_WORDS = "the a an of in to and for is are was were on by with that this it as at from or".split()
WORD_EDGE = ".,;:()`\"'"
# The pattern of a daily quota in an error message, and how much of it is read.
DAILY_LIMIT = r"per\s+day|\bTPD\b|\bRPD\b|daily\s+(limit|quota)"
DAILY_LIMIT_CHARS = 2000


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+\\z", F.lit(""))


def words(text: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def normalise_corpus(text: Column) -> Column:
    """One kind of line end, single blanks, at most one blank line, no outer white space."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    single = F.regexp_replace(unix, "[ \t]+", F.lit(" "))
    return strip(F.regexp_replace(single, "\n{3,}", F.lit("\n\n")))


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and the rest small."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def title(text: Column, filename: Column) -> Column:
    """The first line "# ..." that says something, else the file's stem."""
    lines = F.split(text, f"\r\n|[{LINE_END}]")
    headings = F.filter(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("# "))), lambda x: strip(x.substr(F.lit(3), F.length(x)))), lambda x: x != "")
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", F.lit("")), r"(?<=.)\.[^.]*\z", F.lit(""))
    return F.coalesce(F.get(headings, F.lit(0)), title_case(F.replace(stem, F.lit("_"), F.lit(" "))))


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, cut to a whole number."""
    return (F.size(words(text)) * F.lit(1.3)).cast("int")


def search_terms(text: Column) -> Column:
    """Lower-case words, marks and all."""
    return words(F.lower(text))


def normalise_span(text: Column) -> Column:
    """text without emphasis marks, its white space as single blanks."""
    return strip(F.regexp_replace(F.translate(text, "*`", ""), f"[{WHITE}]+", F.lit(" ")))


def word_overlap(premise: Column, hypothesis: Column) -> Column:
    """Share of the hypothesis' distinct words that the premise holds."""
    h, p = F.array_distinct(search_terms(hypothesis)), F.array_distinct(search_terms(premise))
    return F.size(F.array_intersect(h, p)) / F.greatest(F.size(h), F.lit(1))


def with_title(title_: Column, body: Column) -> Column:
    """The body under its title, if there is one."""
    return F.when(F.coalesce(title_, F.lit("")) != "", F.concat(title_, F.lit("\n\n"), body)).otherwise(body)


def answer_words(text: Column) -> Column:
    """Distinct lower-case words without marks at their ends."""
    bare = F.transform(words(text), lambda w: F.lower(F.btrim(w, F.lit(WORD_EDGE))))
    return F.array_distinct(bare)


def token_recall(gold: Column, answer: Column) -> Column:
    """Share of the reference answer's words, stop words apart, that the answer has."""
    wanted = F.array_except(answer_words(gold), F.array(*[F.lit(w) for w in [*STOP_WORDS, ""]]))
    shared = F.size(F.array_intersect(wanted, answer_words(answer)))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(wanted)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Array of shares that sum to 1, shifted by the largest logit."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def prompt_key(name: Column, prompt: Column) -> Column:
    """Key of a cached answer."""
    return F.sha2(F.concat_ws("::", name, prompt), 256)


def trace_stem(qid: Column, question: Column) -> Column:
    """File stem of a trace: the id made safe, else a hash of the question."""
    safe = F.regexp_replace(qid, "[^A-Za-z0-9_.-]", F.lit("_"))
    return F.when(F.coalesce(qid, F.lit("")) != "", safe).otherwise(F.concat(F.lit("query_"), F.substring(F.sha2(question, 256), 1, 10)))


def chunk_id(doc_id: Column, number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(doc_id, F.lit("::c"), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")))


def snippet(text: Column, length: int = 120) -> Column:
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def json_of(reply: Column) -> Column:
    """The JSON object in a reply: a fenced block, else from the first { to the last }."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def names_daily_limit(message: Column) -> Column:
    """Whether an error message speaks of a quota by the day."""
    return F.coalesce(F.substring(message, 1, DAILY_LIMIT_CHARS).rlike(f"(?i){DAILY_LIMIT}"), F.lit(False))
