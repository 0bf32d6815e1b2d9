"""Same or near-same records across splits (problem 6).

Evaluation questions are normalised to their content words: courtesies and function
words are left out, words of one meaning become one.  Their passages are the single
words, identifiers among them, and the runs of two words.  The distinct passages
are sharded; the Aho-Corasick automaton of each shard scans every training text, in
blocks of texts.  A pair becomes a candidate if the training text was hit by one of
the passages that it cannot lack: the rarest of the identifiers (versions, builds,
advisory numbers), which no rewording may change, or, in questions without any, the
rarest passages without which the others cover too little.  The matched intervals
of a candidate are merged into the covered share of the evaluation record; pairs
covered enough are compared word by word: what differs must be slips of spelling,
courtesies, function words or words exchanged for one of the same meaning.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import glyphs
from .components import checkpointed

#: Share of an evaluation question that its passages must cover in a training question.
COVERED = 0.5
#: Distinct passages of an automaton, training texts of a block, and the least number of scans of a block.
SHARD = 50_000
BLOCK = 20_000
LEAST_SCANS = 8
#: Parts of the training texts that the same passage hits.
SALTS = 8

# Courtesies and function words, which make no difference.
IDLE = """
please kindly tell me us say could can would you i we want need know to answer short briefly brief quickly quick question q
hi hello hey dear thanks thank just a an the of in on at for by with from and or is are was be been does do did has have that this it so now
which what how many much number when
bitte kurz danke hallo frage sagen sie mir antwort können könnten der die das den dem des ein eine im in von zu zum bei mit und ist hat wird was welche welcher welches wie viele
por favor gracias hola pregunta dime diga respuesta breve el la los las un una de del en con y es qué que cuál cuántos para
merci bonjour svp s il vous plaît question dites moi réponse brève le la les l un une de des du d en et est dans pour quel quelle combien y
пожалуйста спасибо привет вопрос скажите мне ответьте кратко в на с к о для и из какой какую какая какие сколько
παρακαλώ ευχαριστώ γεια ο η το του της στο στη για και ποιο ποια
請 请 谢谢 教えて ください
""".split()
# Everyday words of one meaning, the first standing for all.
SAME_MEANING = [
    s.split()
    for s in (
        "receive receives received get gets got", "accept accepts accepted take takes taken handle handles", "reject rejects rejected refuse refuses refused",
        "kind kinds type types sort", "limit limits limited restrict restricts restricted", "publish publishes published release releases released issue issues issued",
        "change changes changed modify modifies modified alter alters altered", "trigger triggers triggered sets set off cause causes caused",
        "describe describes described explain explains", "upgrade upgraded upgrades update updated", "expose exposed exposes vulnerable affected affect affects",
        "keep keeps kept hold holds held", "read reads", "long time", "reason why", "should must", "setting option parameter",
        "melden meldet meldete", "veröffentlicht herausgegeben publiziert", "betroffen anfällig", "describe describen", "décrit décrivait", "lire lit", "concerné touché",
    )
]

#: An identifier: words of other scripts may stand beside it without a blank.
_IDENTIFIER = re.compile(r"[0-9a-z]+(?:[.\-_][0-9a-z]+)*")
# scripts without blanks between words: Thai, kana, Chinese characters
_UNSPACED = re.compile("([ก-๛぀-ヿ㐀-䶿一-鿿])")
_WORD = re.compile(r"[^\W_]+(?:[.\-_][^\W_]+)*")


@lru_cache(maxsize=1)
def _fold() -> tuple[dict[int, str | None], dict[int, str]]:
    look = glyphs.compat_single() | glyphs.compat_multi()
    drop: dict[int, str | None] = {ord(c): None for c in glyphs.invisible()}
    alike = glyphs.lookalike_single()
    # after lower-casing, also the small forms of capitals that look alike
    small = {ord(k.lower()): unicodedata.normalize("NFD", v.lower())[0] for k, v in alike.items() if len(k.lower()) == 1}
    return {ord(k): v for k, v in look.items()} | drop, small


@lru_cache(maxsize=4096)
def normalise(text: str | None) -> str:
    """Lower-case words of one visible form, separated by single blanks."""
    if not text:
        return ""
    forms, small = _fold()
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.translate(forms)).lower()).translate(small)
    return " ".join(_WORD.findall(s))


def separated(norm: str) -> str:
    """A normalised text with characters as words in scripts without blanks."""
    return norm if norm.isascii() else " ".join(w for part in _UNSPACED.sub(r" \1 ", norm).split() if (w := part.strip("-._")))


def key_of(norm: str) -> str:
    """The identifiers of a normalised text: its distinct ASCII runs with a digit, sorted."""
    return " ".join(sorted({w for w in _IDENTIFIER.findall(norm) if any(c.isdigit() for c in w)}))


@lru_cache(maxsize=1)
def _lexicon() -> tuple[frozenset[str], dict[str, str], dict[str, list[str]]]:
    idle = frozenset(p for w in IDLE for p in separated(normalise(w)).split())
    same = {normalise(w): normalise(group[0]) for group in SAME_MEANING for w in group}
    by_length: dict[str, list[str]] = defaultdict(list)
    for w in [*idle, *same]:
        if len(w) > 2:
            by_length[str(len(w))].append(w)
    return idle, same, by_length


def one_slip(a: str, b: str) -> bool:
    """Equal up to one letter added, left out, replaced or swapped with the next."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]


def two_slips(a: str, b: str) -> bool:
    """Equal up to two letters added, left out, replaced or swapped with the next."""
    if abs(len(a) - len(b)) > 2:
        return False
    last, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            n = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            row.append(n)
    return row[-1] <= 2


@lru_cache(maxsize=100_000)
def _idle_slip(word: str) -> bool:
    """A slip of a courtesy, function or everyday word."""
    _, _, by_length = _lexicon()
    near = (w for n in (-1, 0, 1) for w in by_length.get(str(len(word) + n), ()))
    return len(word) > 2 and any(one_slip(word, w) for w in near)


@lru_cache(maxsize=100_000)
def _parts(word: str) -> tuple[str, ...]:
    """A word with digits that other scripts stand beside: its identifiers and the rest."""
    found = [w for w in _IDENTIFIER.findall(word) if any(c.isdigit() for c in w)]
    rest = [w for w in _IDENTIFIER.sub(lambda m: " " if any(c.isdigit() for c in m[0]) else m[0], word).split() if w.strip("-._")]
    return (*found, *rest)


def content_words(norm: str) -> list[str]:
    """The words of a normalised text that say what is asked, words of one meaning as
    one; all its words if it has no others."""
    idle, same, _ = _lexicon()
    words = separated(norm).split()
    if not norm.isascii():
        words = [p for w in words for p in (_parts(w) if any(c.isdigit() for c in w) and not w.isascii() else (w,))]
    return [same.get(w, w) for w in words if w not in idle] or words


def _content(norm: str) -> Counter[str]:
    return Counter(content_words(norm))


def same_question(a: str, b: str) -> bool:
    """Whether two normalised texts have the same identifiers and ask the same."""
    if key_of(a) != key_of(b):
        return False
    x, y = _content(a), _content(b)
    everyday = _lexicon()[1]
    more, less = list((x - y).elements()), list((y - x).elements())
    for w in list(more):
        if any(c.isdigit() for c in w):
            if y[w] == 0:
                return False
            more.remove(w)  # an identifier said twice
            continue
        for v in less:
            if any(c.isdigit() for c in v):
                continue
            # two slips are told from another word only where the word is an everyday one
            if len(w) > 2 and one_slip(w, v) or len(w) > 4 and (w in everyday or v in everyday) and two_slips(w, v):
                more.remove(w)
                less.remove(v)
                break
    less = [v for v in less if not (any(c.isdigit() for c in v) and x[v])]
    # a word said twice, as in a repeated courtesy, or a slip of an idle word
    rest = [w for w in more if not _idle_slip(w)] + [v for v in less if not _idle_slip(v)]
    return all(x[w] and y[w] for w in rest)


def is_identifier(word: str) -> bool:
    return any(c.isdigit() for c in word) and bool(_IDENTIFIER.fullmatch(word))


def passages_of(words: list[str]) -> list[tuple[str, int, int]]:
    """(passage, start, end) in " " + the joined words + " ", blanks included: the
    single words and the runs of two."""
    text = " " + " ".join(words) + " "
    gaps = [i for i, c in enumerate(text) if c == " "]
    return [(text[gaps[i] : gaps[i + n] + 1], gaps[i], gaps[i + n] + 1) for n in (1, 2) for i in range(len(gaps) - n)]


def covered_share(spans: list[tuple[int, int]], length: int) -> float:
    """Share of a text that merged intervals cover."""
    total, reach = 0, 0
    for a, b in sorted(spans):
        if b > reach:
            total += b - max(a, reach)
            reach = b
    return total / max(1, length)


def needed_passages(passages: list[tuple[str, int, int]], texts_hit: list[int], covered: float) -> list[str]:
    """The passages of an evaluation record of which any match has at least one.

    texts_hit: how many training texts each hits.  The rarest identifier; without
    any, the rarest passages, until the others cover less than the share asked for."""
    by_rarity = sorted(range(len(passages)), key=lambda k: (texts_hit[k], passages[k][0]))
    for k in by_rarity:
        if is_identifier(passages[k][0].strip(" ")):
            return [passages[k][0]] if texts_hit[k] else []
    length = max((e for _, _, e in passages), default=0)
    taken: list[str] = []
    rest = [passages[k] for k in by_rarity if texts_hit[k]]
    while rest and covered_share([(a, b) for _, a, b in rest], length) >= covered:
        taken.append(rest.pop(0)[0])
    return sorted(set(taken))


def _normal_form(questions: DataFrame) -> DataFrame:
    """(qid, norm) of rows with a qid and a question that holds a word."""

    @F.pandas_udf("string")
    def form(text: pd.Series) -> pd.Series:
        return text.map(lambda t: separated(normalise(t)))

    some = questions.where(F.col("qid").isNotNull() & F.col("question").isNotNull()).select("qid", "question").distinct()
    return some.select("qid", form("question").alias("norm")).where("norm <> ''")


def _with_words(forms: DataFrame, name: str) -> DataFrame:
    """(name, norm, words) of the distinct texts, numbered and written once."""

    @F.pandas_udf("string")
    def words(norm: pd.Series) -> pd.Series:
        return norm.map(lambda n: " ".join(content_words(n)))

    numbered = forms.select("norm").distinct().withColumn(name, F.monotonically_increasing_id())
    return checkpointed(numbered.select(name, "norm", words("norm").alias("words")))


def passage_table(evals: DataFrame) -> DataFrame:
    """(e, passage, start, end) of the evaluation texts (e, norm, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *p) for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in passages_of(w.split(" "))]
            yield pa.RecordBatch.from_pydict(dict(zip(("e", "passage", "start", "end"), zip(*rows, strict=True), strict=True)) if rows else {"e": [], "passage": [], "start": [], "end": []}, schema)

    schema = pa.schema([("e", pa.int64()), ("passage", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return evals.select("e", "words").mapInArrow(run, "e long, passage string, start int, end int")


def _scan_block(passages: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    """The automaton of a shard's passages over a block of training texts."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for p in passages["passage"]:
        automaton.add_word(p, p)
    if len(automaton):
        automaton.make_automaton()
    found = [sorted({p for _, p in automaton.iter(f" {w} ")}) if len(automaton) else [] for w in texts["words"]]
    return pd.DataFrame({"t": texts["t"].astype("int64"), "found": pd.Series(found, texts.index, object)})


def scan(passages: DataFrame, train: DataFrame, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(t, found): the passages found in every training text (t, norm, words), also
    where there are none.

    Each automaton holds about ``shard`` distinct passages and scans all texts, about
    ``block`` of them in a task; only bounded blocks of both sides are copied."""
    some = passages.select("passage").distinct()
    n_shards = max(1, -(-some.count() // shard))
    n_blocks = max(-(-LEAST_SCANS // n_shards), -(-train.count() // block))
    number = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = some.select("passage", number("passage", n_shards).alias("shard"), every(n_blocks).alias("block"))
    right = train.select("t", "words", number("words", n_blocks).alias("block"), every(n_shards).alias("shard"))
    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_scan_block, "t long, found array<string>")
    return hits if n_shards == 1 else hits.groupBy("t").agg(F.flatten(F.collect_list("found")).alias("found"))


def matched_texts(evals: DataFrame, train: DataFrame, covered: float = COVERED, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(norm_eval, norm_train, covered) of distinct normalised texts that ask the same.

    Copies are one text here, however many rows have it; the training texts that a
    passage hits are spread over SALTS parts."""
    e, t = _with_words(evals, "e"), _with_words(train, "t")
    passages = passage_table(e)
    found = checkpointed(scan(passages, t, shard, block))
    hits = found.select("t", F.explode("found").alias("passage"))
    frequency = hits.groupBy("passage").agg(F.count("*").alias("texts_hit"))
    counted = passages.join(frequency, "passage", "left").fillna(0, ["texts_hit"])
    listed = counted.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("start", "end", "passage", "texts_hit"))).alias("p"))

    @F.pandas_udf("array<string>")
    def needed(p: pd.Series) -> pd.Series:
        return p.map(lambda x: needed_passages([(r["passage"], r["start"], r["end"]) for r in x], [r["texts_hit"] for r in x], covered))

    listed = checkpointed(listed.withColumn("needed", needed("p")).where(F.size("needed") > 0).select("e", F.expr("transform(p, x -> struct(x.passage, x.start, x.end))").alias("spans"), "needed"))
    asked = listed.select("e", F.explode("needed").alias("passage"))
    asked = asked.select("e", "passage", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = hits.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
    candidates = asked.join(salted, ["passage", "salt"]).select("e", "t").distinct()
    wide = candidates.join(listed.select("e", "spans"), "e").join(e.select("e", F.col("norm").alias("norm_eval")), "e").join(found, "t").join(t.select("t", F.col("norm").alias("norm_train")), "t")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, seen, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                hit = set(seen)
                share = covered_share([(s["start"], s["end"]) for s in spans if s["passage"] in hit], max(s["end"] for s in spans))
                if share >= covered and same_question(a, b):
                    rows.append((a, b, min(1.0, share)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], ["norm_eval", "norm_train", "covered"])

    return wide.select("spans", "found", "norm_eval", "norm_train").mapInArrow(judge, "norm_eval string, norm_train string, covered double")


def cross_split_pairs(holdout: DataFrame, gold: DataFrame, covered: float = COVERED) -> DataFrame:
    """(qid_a, qid_b, covered): distinct pairs of a holdout and a gold question that
    ask the same, the smaller qid first.

    Rows with a null qid, a null question or one without words give nothing;
    repeated rows count once; of several wordings under one qid the best covered
    counts; very long questions are compared whole."""
    e, t = checkpointed(_normal_form(holdout)), checkpointed(_normal_form(gold))
    found = matched_texts(e, t, covered)
    pairs = found.join(e.select(F.col("qid").alias("h"), F.col("norm").alias("norm_eval")), "norm_eval").join(t.select(F.col("qid").alias("g"), F.col("norm").alias("norm_train")), "norm_train")
    ordered = pairs.where("h <> g").select(F.least("h", "g").alias("qid_a"), F.greatest("h", "g").alias("qid_b"), "covered")
    return ordered.groupBy("qid_a", "qid_b").agg(F.max("covered").alias("covered"))


def report(holdout: DataFrame, gold: DataFrame, covered: float = COVERED) -> DataFrame:
    """(split, source, n_questions, n_overlapping, n_pairs) of the evaluation splits;
    null splits and sources count as "unknown", sources trimmed and lower-cased."""
    e, t = checkpointed(_normal_form(holdout)), checkpointed(_normal_form(gold))
    found = matched_texts(e, t, covered)
    in_gold = t.groupBy(F.col("norm").alias("norm_train")).agg(F.countDistinct("qid").alias("n"))
    # gold questions by evaluation text, then by evaluation question
    per_text = found.join(in_gold, "norm_train").groupBy(F.col("norm_eval").alias("norm")).agg(F.sum("n").alias("n_pairs"))
    per_qid = e.join(per_text, "norm").groupBy("qid").agg(F.max("n_pairs").alias("n_pairs"))
    split = F.coalesce(F.col("split"), F.lit("unknown")).alias("split")
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown")).alias("source")
    asked = holdout.where(F.col("qid").isNotNull()).select("qid", split, source).distinct()
    joined = asked.join(per_qid, "qid", "left")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("n_questions"), F.count("n_pairs").alias("n_overlapping"), F.coalesce(F.sum("n_pairs"), F.lit(0)).cast("bigint").alias("n_pairs")
    )
