"""Broken prompt and response pairs (problem 2): a conditional random field over clauses.

A response is cut into clauses (the units of problem 1).  Each clause gets
features held against the question and the reference answer, and a linear-chain
conditional random field tags it as answer, refusal, echo, foreign or
unfinished.  The share of the response that each tag covers decides the defect
of the pair.

How often words and pairs of words end a sentence is counted over all rows, exactly,
and joined to the responses that end without a mark.  Which words belong to which
language is counted over all rows into a table of fixed size.
The field is fitted on a bounded sample of rows whose clauses carry silver
labels from plain rules.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentences
from .components import checkpointed
from .overlap import normalise

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
TAGS = 5
DEFECTS = {REFUSAL: "refusal", ECHO: "copy", FOREIGN: "other_language", UNFINISHED: "truncated"}
#: Rows the field is fitted on, about, drawn by hash.
SAMPLE_ROWS = 4000
#: Distinct words and pairs that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Parts of the responses that break off after the same words.
SALTS = 16
#: Buckets of the words by language.
LANG_BUCKETS = 1 << 16
#: Words of a language, for smoothing.
VOCABULARY = 20_000
#: Occurrences that the share of endings of a word or pair is smoothed with.
PRIOR = 2.0
#: Shares of endings under which a text surely and possibly breaks off, and from which it does not; some 10 % of all words end a sentence.
RARELY, SELDOM, OFTEN = 0.02, 0.1, 0.3
#: Hashed word features, and their value where the word is there.
WORD_FEATURES = 256
WORD_WEIGHT = 0.3

# What stands for no answer at all, after mark-up and punctuation are gone.
PLACEHOLDERS = """
n/a na none null nil nan undefined unknown tbd tba todo no answer answer response empty blank missing pending
keine antwort keine angabe k.a sin respuesta respuesta aucune réponse réponse нет ответа ответ 无 暂无 答案 なし 回答 回答なし
""".split("\n")
# Words and phrases with which an answer is refused, by language.
REFUSALS = re.compile(
    r"\bi(?:'m| am)? ?(?:sorry|unable|not able|cannot|can't|can not|won't|will not|must decline|have to decline|decline|refuse|don't have|do not have|lack|would rather not)\b"
    r"|\bi(?:'m| am) (?:sorry|afraid|unable|not)\b|not something i (?:can|may)|what i (?:may|can) talk|not be responsible of me|no answer can be given|insufficient evidence"
    r"|not contain enough|not enough (?:evidence|information)|outside (?:of )?(?:my|what i)|as an? (?:language|ai) (?:assistant|model)|my (?:guidelines|policy|rules) (?:keep|prevent|forbid|do not)"
    r"|leider|(?:darf|kann|werde|möchte) ich (?:dazu |hierzu |das )?(?:nicht|keine)|nicht beantworten|keine ausreichenden|antworte ich nicht|keine auskunft"
    r"|lo siento|no puedo|no dispongo|no me está permitido|no tengo (?:suficiente|información)|me abstengo|no estoy autorizado"
    r"|désolée?|je ne (?:peux|suis|dispose)|ne suffisent pas|m['’]abstenir|pas en mesure|pas autorisée?"
    r"|(?:не могу|не в состоянии|не вправе)|нельзя (?:обсуждать|отвечать)|недостаточно|воздерж|к сожалению"
    r"|抱歉|对不起|无法|不能(?:讨论|回答|提供)|作为.{0,8}助手|恕不|恕难|不便|资料不足|申し訳|できません|お答え(?:でき|いたし)|回答できない|お答えを控え|控えさせ"
    r"|عذرا|لا أستطيع|لا يمكنني|لا تكفي|أعتذر|क्षमा|नहीं (?:कर|दे|बता) सक|असमर्थ|पर्याप्त (?:जानकारी|प्रमाण) नहीं|λυπάμαι|δεν μπορώ|δεν επαρκ|ขออภัย|ไม่สามารถ|ไม่เพียงพอ"
)
# Words that answer by themselves.
YES_NO = frozenset("yes no sí si ja nein oui non да нет 是 否 不是 はい いいえ نعم لا हाँ नहीं ναι όχι".split())
# Function words by language, for languages that share the Latin script.
LATIN = {
    "en": "the of and is in to that on which what does when how with for are was by under from it should they why".split(),
    "de": "der die das und ist von zu den dem mit ein eine nicht auf bei wird wie viele welcher wann hat warum laut liest im einen".split(),
    "es": "el la los las de que y en por un una según para lee qué cuántos del se fallo puerto describe queda no".split(),
    "fr": "le la les de des du et est une dans par un quel quelle combien peut il que avec pas au défaut".split(),
}
# Words a sentence plainly goes on after.
GOES_ON = frozenset(
    "the a an of and or to in on at by for with from that which whose because if when while as than into before after not only is are was its their this "
    "der die das den dem des ein eine einen einem und oder von zu mit in im auf bei für weil dass ist sind wird "
    "el la los las un una de del y o en por para con que según es se al "
    "le la les un une de des du et ou en dans par pour avec que est au aux "
    "и в на с к по для из от что как не или при".split()
)
_MARKUP = re.compile(r"<[^<>]*>|[*_`#>~|\"'“”„«»()\[\]{}]")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|„[^“]*“|«[^»]*»|“[^”]*”|「[^」]*」")
_LETTERS = re.compile(r"[^\W\d_]+")
_SCRIPTS = (("ja", re.compile("[ぁ-ヿ]")), ("zh", re.compile("[一-鿿]")), ("ru", re.compile("[а-яё]")), ("el", re.compile("[α-ωά-ώ]")), ("ar", re.compile("[ء-ي]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[ก-๎]")))
_END = re.compile(r"[.!?…。！？؟।]+[\"'”“»」』)\]*_`]*\s*$")


_DIGIT = re.compile(r"\d")


@lru_cache(maxsize=200_000)
def numeric(word: str) -> bool:
    """Whether a word has a digit."""
    return bool(_DIGIT.search(word))


@lru_cache(maxsize=200_000)
def bucket(text: str, buckets: int) -> int:
    return crc32(text.encode("utf-8", "surrogatepass")) % buckets


_HEX = re.compile("[0-9a-f]")
_CJK_CHAR = re.compile("([぀-ヿ一-鿿])")


def words_of(norm: str) -> list[str]:
    """Words of a normalised text; in scripts without blanks, characters."""
    return (norm if norm.isascii() else _CJK_CHAR.sub(r" \1 ", norm)).split()


def shapes(text: str) -> list[str]:
    """Words in lower case, those with digits by their shape alone."""
    words = words_of(normalise(text))
    return [_HEX.sub("9", w) if numeric(w) else w for w in words]


def script_language(text: str) -> str | None:
    """Language by script, or "latin"; None without letters."""
    low = text.lower()
    counts = {name: len(rx.findall(low)) for name, rx in _SCRIPTS}
    if counts["ja"]:
        counts["ja"] += counts["zh"]
        counts["zh"] = 0
    latin = sum(len(w) for w in re.findall("[a-zà-ÿœ]+", low))
    name = max(counts, key=counts.get)
    # names and identifiers are Latin in every language
    if counts[name] * (4 if name in ("zh", "ja") else 2) > latin and counts[name]:
        return name
    return "latin" if latin else None


def latin_votes(text: str) -> np.ndarray:
    words = _LETTERS.findall(text.lower())
    return np.array([sum(w in words_of for w in words) for words_of in _LATIN_SETS], float)


_LATIN_SETS = [frozenset(v) for v in LATIN.values()]
_LANGS = list(LATIN)


@dataclass(frozen=True)
class Statistics:
    """Counts over all rows: words by Latin-script language, in buckets."""

    lang: np.ndarray  # languages x buckets

    @cached_property
    def odds(self) -> np.ndarray:
        """Log odds of the languages for a word of each bucket."""
        # smoothed over a vocabulary, so that a language without rows is no better than one with many
        share = (self.lang + 0.5) / (self.lang.sum(1, keepdims=True) + 0.5 * VOCABULARY)
        return np.clip(np.log(share / share.mean(0)), -3, 3)

    def word_language(self, text: str) -> np.ndarray:
        """Log odds of the Latin-script languages from the words of a text."""
        return self.odds[:, [bucket(w, LANG_BUCKETS) for w in set(_LETTERS.findall(text.lower())) if len(w) > 1]].sum(1)


#: Of the last word of a text and of its pair with the word before it: how often each
#: ends a sentence and goes on, and how often longer words begin with the last word.
Seen = tuple[int, int, int, int, int]
SEEN = ["end", "go", "end_pair", "go_pair", "longer"]


def cut_off(word: str, end: int, go: int, end_pair: int, go_pair: int, longer: int) -> float:
    """How surely a text without a closing mark breaks off after its last word: 1
    surely, 0 surely not.

    Only smoothed shares decide, so that more text of the same kind makes no other
    verdict: endings are held against how often the word goes on and how often it is
    the beginning of a longer word."""
    if any(c.isdigit() for c in word):  # a number may end a sentence if those of its shape do
        share = end / (end + go + PRIOR)
        return 0.9 if share < RARELY else 0.5 if share < SELDOM else 0.1
    share = end / (end + go + longer + PRIOR)
    pair = (end_pair + PRIOR * share) / (end_pair + go_pair + PRIOR)
    if word in GOES_ON:
        return 0.0 if pair >= 0.5 else 1.0
    if pair < RARELY:  # also a word seen nowhere else: cut inside
        return 1.0
    return 0.5 if pair < SELDOM else 0.1 if pair < OFTEN else 0.0


def last_words(answer: str | None, spans: list[tuple[int, int]]) -> str:
    """The last two words of an answer that ends without a mark, the first empty where
    its last clause has one word; nothing for other answers."""
    raw = answer[slice(*spans[-1])] if answer and spans else answer or ""
    words = [] if _END.search(raw) else shapes(raw)
    return " ".join(["", *words][-2:]) if words else ""


def _count_words(question: str | None, gold: str | None, answer: str | None, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, str]], list[tuple[int, int]]]:
    """Of one row: (0 goes on or 1 ends, word or pair of words), and (language, bucket
    of a word).  A question and a reference answer are whole; spans are the answer's units."""
    out: list[tuple[int, str]] = []
    lang: list[tuple[int, int]] = []
    for text, whole in ((question, True), (gold, True), (answer, False)):
        if not text or not text.strip():
            continue
        starts = [text] if whole else [text[s:e] for s, e in spans]
        for k, unit in enumerate(starts):
            words = shapes(unit)
            closed = whole or k < len(starts) - 1 or bool(_END.search(unit))
            for n, w in enumerate(words):
                last = n == len(words) - 1
                if last and not closed:
                    break
                kind = 1 if last else 0
                out.append((kind, w))
                if n and not numeric(w) and not numeric(words[n - 1]):
                    out.append((kind, words[n - 1] + " " + w))
    if question and script_language(question) == "latin":
        votes = latin_votes(question)
        best = int(votes.argmax())
        if votes[best] >= 2 and (votes == votes[best]).sum() == 1:
            for text in (question, gold or ""):
                lang += [(best, bucket(w, LANG_BUCKETS)) for w in set(_LETTERS.findall(text.lower())) if len(w) > 1]
    return out, lang


def _units(texts: list[str | None]) -> list[list[tuple[int, int]]]:
    """Spans of the units of each text."""
    counts, s, e = sentences.spans_of([t or "" for t in texts])
    spans = list(zip(s.tolist(), e.tolist(), strict=True))
    ends = np.cumsum(counts).tolist()
    return [spans[b - n : b] for n, b in zip(counts.tolist(), ends, strict=True)]


def count(pairs: DataFrame) -> tuple[Statistics, DataFrame]:
    """The statistics over all rows, and (key, end, go) of every word and pair of
    words; the driver gets at most 4 x LANG_BUCKETS sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        total = np.zeros(len(_LANGS) * LANG_BUCKETS, np.int64)

        def counted() -> pa.RecordBatch:
            keys = list(words[0].keys() | words[1].keys())
            cols = [pa.array([0] * len(keys), pa.int32()), pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (words[1], words[0]))]
            for c in words:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "key", "end", "go"])

        for batch in batches:
            rows = list(_rows(batch, 0))
            for row, spans in zip(rows, _units([r[2] for r in rows]), strict=True):
                said, spoken = _count_words(*row, spans)
                for kind, w in said:
                    words[kind][w] += 1
                for k, b in spoken:
                    total[k * LANG_BUCKETS + b] += 1
            if len(words[0]) + len(words[1]) > HELD_WORDS:
                yield counted()
        yield counted()
        hit = np.flatnonzero(total)
        cols = [pa.array((hit // LANG_BUCKETS + 1).astype(np.int32)), pa.array([str(b) for b in (hit % LANG_BUCKETS).tolist()], pa.string()), pa.array(np.zeros(len(hit), np.int64)), pa.array(total[hit])]
        yield pa.RecordBatch.from_arrays(cols, ["lang", "key", "end", "go"])

    found = pairs.select("question", "gold_answer", "agent_answer").mapInArrow(run, "lang int, key string, end long, go long")
    sums = checkpointed(found.groupBy("lang", "key").agg(F.sum("end").alias("end"), F.sum("go").alias("go")))
    spoken = sums.where("lang > 0").select(F.col("lang") - 1, F.col("key").cast("int"), "go").toArrow()
    k, at, n = (c.to_numpy() for c in spoken.columns)
    lang = np.zeros((len(_LANGS), LANG_BUCKETS))
    lang[k, at] = n
    return Statistics(lang), sums.where("lang = 0").select("key", "end", "go")


def _open_ended() -> Column:
    """Whether an answer may end without a mark."""
    return ~F.coalesce(F.rtrim("agent_answer").rlike(r"""[.!?…。！？؟।]["'”“»」』)\]*_`]*\z"""), F.lit(True))


def _asked(rows: DataFrame) -> DataFrame:
    """rows (grade_id, question, gold_answer, agent_answer) with asked, their last words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("agent_answer").to_pylist()
            yield batch.append_column("asked", pa.array([last_words(a, spans) for a, spans in zip(answers, _units(answers), strict=True)], pa.string()))

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("asked", T.StringType())]))


def seen_words(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(asked, end, go, end_pair, go_pair, longer) of the last words of the answers
    that end without a mark."""
    open_ended = pairs.where(_open_ended()).select("grade_id", "question", "gold_answer", "agent_answer")
    asked = checkpointed(_asked(open_ended).where("asked <> ''").select("asked").distinct()).withColumn("last", F.substring_index("asked", " ", -1))
    single = words.where(~F.contains("key", F.lit(" ")))
    parts = single.where("length(key) > 1").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("key") - 1), lambda n: F.col("key").substr(F.lit(1), n))).alias("last"), (F.col("end") + F.col("go")).alias("n"))
    longer = parts.join(asked.select("last").distinct(), "last", "left_semi").groupBy("last").agg(F.sum("n").alias("longer"))
    both = words.select(F.col("key").alias("asked"), F.col("end").alias("end_pair"), F.col("go").alias("go_pair"))
    seen = asked.join(single.withColumnRenamed("key", "last"), "last", "left").join(longer, "last", "left").join(both, "asked", "left")
    return checkpointed(seen.select("asked", *SEEN).fillna(0))


def with_seen(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """(grade_id, question, gold_answer, agent_answer, end, go, end_pair, go_pair,
    longer), the counts null for answers with a closing mark.  Only the others are
    shuffled, in SALTS parts for each asked pair of words."""
    rows = pairs.select("grade_id", "question", "gold_answer", "agent_answer")
    salted = seen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    asked = _asked(rows.where(_open_ended())).withColumn("salt", F.pmod(F.xxhash64("grade_id", "question", "agent_answer"), F.lit(SALTS)))
    looked_up = asked.join(salted, ["asked", "salt"], "left").select(*rows.columns, *SEEN)
    return looked_up.union(rows.where(~_open_ended()).select(*rows.columns, *(F.lit(None).cast("bigint").alias(c) for c in SEEN)))


def is_empty(answer: str | None) -> bool:
    """Null, blank, or only a placeholder, mark-up or punctuation."""
    if answer is None:
        return True
    bare = normalise(_MARKUP.sub(" ", answer).replace("/", ""))
    return bare in _EMPTY


_EMPTY = frozenset({""} | {normalise(w.replace("/", "")) for line in PLACEHOLDERS for w in [*line.split(), line]} | {normalise(p) for p in ("no answer", "keine antwort", "sin respuesta", "aucune réponse", "нет ответа", "not available", "not applicable", "to be done", "no response")})


@dataclass
class Clauses:
    """Clauses of one response: their spans, features and silver labels (-1 unsure)."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    silver: np.ndarray


#: Features ahead of the hashed words.
PLAIN_FEATURES = 26


def clauses_of(question: str | None, gold: str | None, answer: str, spans: list[tuple[int, int]], stats: Statistics, seen: Seen | None) -> Clauses:
    """Features of the clauses, given by their spans, of an answer that is not empty;
    seen are the counts of its last words if it ends without a mark."""
    spans = spans or [(0, len(answer))]
    asked = words_of(normalise(question or ""))
    asked_set = set(asked)
    gold_norm = f" {normalise(gold or '')} "
    answer_norm = f" {normalise(answer)} "
    has_gold = len(gold_norm) > 2 and gold_norm in answer_norm and gold_norm not in f" {normalise(question or '')} "
    q_script = script_language(_QUOTED.sub(" ", question or ""))
    q_votes = latin_votes(question or "")
    q_odds = stats.word_language(question or "") if q_script == "latin" else np.zeros(len(_LANGS))
    q_lang = int((q_votes * 2 + q_odds).argmax()) if q_script == "latin" else -1
    x = np.zeros((len(spans), PLAIN_FEATURES + WORD_FEATURES), np.float32)
    silver = np.full(len(spans), -1)
    refused_before = False
    for k, (a, b) in enumerate(spans):
        raw = answer[a:b]
        norm = normalise(raw)
        words = words_of(norm)
        low = raw.lower()
        inside = sum(w in asked_set for w in words) / max(1, len(words))
        reached = len(set(words) & asked_set) / max(1, len(asked_set))
        new_number = any(numeric(w) and w not in asked_set for w in words)
        yes_no = bool(words) and any(w in YES_NO for w in words[:4])
        own_gold = has_gold and gold_norm in f" {norm} "
        refusal = bool(REFUSALS.search(low))
        prose = _QUOTED.sub(" ", raw)
        script = script_language(prose)
        other_script = bool(q_script and script and script != q_script and len(_LETTERS.findall(prose)) >= 1)
        other_latin, margin = False, 0.0
        if script == "latin" and q_script == "latin":
            votes, odds = latin_votes(prose), stats.word_language(prose)
            mix = votes * 1.5 + odds
            margin = float(mix.max() - mix[q_lang])
            best = int(mix.argmax())
            other_latin = margin > 3 and votes[best] > votes[q_lang]
        elif script == "latin" and q_script not in (None, "latin"):
            # a name, a version or a bare term is no other language: it takes function words
            other_script = latin_votes(prose).max() >= 2
        last = k == len(spans) - 1
        open_end = last and not _END.search(raw)
        open_marks = last and (raw.count("`") % 2 == 1 or raw.count('"') % 2 == 1 or raw.count("(") > raw.count(")") or raw.count("«") > raw.count("»") or raw.count("„") > raw.count("“") + raw.count("”"))
        asked = last_words(raw, []) if open_end and seen else ""
        cut = cut_off(asked.rpartition(" ")[2], *seen) if asked and gold_norm.strip() != answer_norm.strip() else 0.0
        hanging = open_end and raw.rstrip()[-1:] in ",;–—-(" and len(words) > 1
        if open_end and (open_marks and len(words) > 2 or hanging):
            cut = 1.0
        if own_gold and open_end and norm.endswith(gold_norm.strip()):
            cut = min(cut, 0.1)
        f = [
            1, k == 0, last, len(words) <= 3, len(words) >= 12, inside >= 0.9, 0.7 <= inside < 0.9, inside < 0.4, reached >= 0.9, 0.6 <= reached < 0.9,
            new_number, yes_no, own_gold, has_gold, refusal, refusal and not new_number, other_script, other_latin, margin > 6, open_end, cut >= 0.95, 0.5 <= cut < 0.95,
            0.2 <= cut < 0.5, open_marks, refused_before, inside >= 0.75 and not new_number and not yes_no and not own_gold,
        ]
        x[k, :PLAIN_FEATURES] = f
        for w in set(words):
            if not numeric(w):
                x[k, PLAIN_FEATURES + bucket(w, WORD_FEATURES)] = WORD_WEIGHT
        echo = inside >= 0.75 and reached >= 0.5 and not new_number and not yes_no and not own_gold
        if other_script or other_latin and margin > 5:
            silver[k] = FOREIGN
        elif refusal and not own_gold or refused_before and not has_gold:
            silver[k] = REFUSAL
        elif echo:
            silver[k] = ECHO
        elif cut >= 0.9:
            silver[k] = UNFINISHED
        elif cut < 0.3 and (own_gold or inside < 0.75 or new_number or yes_no):
            silver[k] = ANSWER
        refused_before |= refusal
    return Clauses(spans, x, silver)


@dataclass(frozen=True)
class Field:
    """Weights of the conditional random field."""

    emit: np.ndarray  # features x tags
    move: np.ndarray


def _padded(rows: list[Clauses]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all clauses of some rows, where there are any, and the allowed tags."""
    longest = max(len(r.silver) for r in rows)
    on = np.zeros((len(rows), longest), bool)
    allow = np.zeros((len(rows), longest, TAGS))
    for i, r in enumerate(rows):
        n = len(r.silver)
        on[i, :n] = True
        allow[i, :n] = (r.silver[:, None] < 0) | (r.silver[:, None] == np.arange(TAGS))
    return np.concatenate([r.features for r in rows]), on, allow


def fit_field(rows: list[Clauses], rounds: int = 80, rate: float = 0.15, ridge: float = 1e-4) -> Field:
    """Maximum conditional likelihood of the silver tags, by Adam; unsure clauses
    are summed over.  Rows of about the same length are worked through together."""
    rows = [r for r in rows if (r.silver >= 0).any()]
    params = [np.zeros((PLAIN_FEATURES + WORD_FEATURES, TAGS)), np.zeros((TAGS, TAGS))]
    if not rows:
        return Field(*params)
    groups: dict[int, list[Clauses]] = {}
    for r in rows:
        groups.setdefault(len(r.silver).bit_length(), []).append(r)
    parts = [_padded(g) for _, g in sorted(groups.items())]
    steps = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for t in range(1, rounds + 1):
        grads = [np.zeros_like(p) for p in params]
        for flat, on, allow in parts:
            scores = np.zeros((*on.shape, TAGS))
            scores[on] = flat @ params[0].astype(np.float32)
            free, moves = _marginals(scores, params[1], on, np.ones_like(allow))
            held, moves_held = _marginals(scores, params[1], on, allow)
            grads[0] += (flat.T @ (held - free)[on].astype(np.float32)).astype(float) / len(rows)
            grads[1] += (moves_held - moves) / len(rows)
        for p, g, s in zip(params, grads, steps, strict=True):
            g = g - ridge * p
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            p += rate * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.999**t)) + 1e-8)
    return Field(*params)


def _marginals(scores: np.ndarray, move: np.ndarray, on: np.ndarray, allow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals and expected moves by forward-backward, in scaled probabilities."""
    n, length, _ = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True)) * allow
    m = np.exp(move)
    forward, backward, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, length))
    for k in range(length):
        now = e[:, k] if k == 0 else (forward[:, k - 1] @ m) * e[:, k]
        scale[:, k] = np.maximum(now.sum(1), 1e-300)
        forward[:, k] = np.where(on[:, k, None], now / scale[:, k, None], forward[:, k - 1] if k else now)
    for k in range(length - 2, -1, -1):
        later = (e[:, k + 1] * backward[:, k + 1]) @ m.T / scale[:, k + 1, None]
        backward[:, k] = np.where(on[:, k + 1, None], later, 1.0)
    tags = forward * backward
    tags = np.where(on[..., None], tags / np.maximum(tags.sum(2, keepdims=True), 1e-300), 0)
    moves = np.zeros_like(move)
    for k in range(length - 1):
        both = on[:, k + 1]
        pair = forward[both, k, :, None] * m * (e[both, k + 1] * backward[both, k + 1])[:, None, :]
        moves += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
    return tags, moves


def best_tags(field: Field, features: np.ndarray) -> np.ndarray:
    """Viterbi tags of one response."""
    scores = features @ field.emit
    back = np.zeros((len(scores), TAGS), np.int64)
    now = scores[0]
    for k in range(1, len(scores)):
        through = now[:, None] + field.move
        back[k] = through.argmax(0)
        now = through.max(0) + scores[k]
    tags = [int(now.argmax())]
    for k in range(len(scores) - 1, 0, -1):
        tags.append(int(back[k, tags[-1]]))
    return np.array(tags[::-1])


def defect_of(question: str | None, gold: str | None, answer: str | None, spans: list[tuple[int, int]], seen: Seen | None, field: Field, stats: Statistics) -> tuple[str | None, list[float]]:
    """The defect of a pair, if any, and the share of the response by tag."""
    shares = [0.0] * TAGS
    if is_empty(answer):
        return "empty", shares
    if gold is None:
        return None, shares
    c = clauses_of(question, gold, answer, spans, stats, seen)
    tags = best_tags(field, c.features)
    sizes = np.array([b - a for a, b in c.spans], float)
    cover = np.bincount(tags, sizes, minlength=TAGS) / max(1.0, sizes.sum())
    shares = cover.tolist()
    if cover[FOREIGN] >= 0.5:
        return DEFECTS[FOREIGN], shares
    holds_gold = bool(c.features[0, 13])
    # greetings around a refusal are no answer: without the reference answer a smaller part decides
    if cover[REFUSAL] >= 0.5 or cover[REFUSAL] >= 0.25 and not holds_gold:
        return DEFECTS[REFUSAL], shares
    if cover[ECHO] >= 0.5 and cover[ANSWER] < 0.3:
        return DEFECTS[ECHO], shares
    if tags[-1] == UNFINISHED:
        return DEFECTS[UNFINISHED], shares
    return None, shares


def _rows(batch: pa.RecordBatch | pa.Table, start: int) -> Iterator[tuple[str | None, str | None, str | None]]:
    return zip(*(batch.column(k).to_pylist() for k in range(start, start + 3)), strict=True)


def _seen(table: pa.RecordBatch | pa.Table) -> list[Seen | None]:
    counts = zip(*(table.column(c).to_pylist() for c in SEEN), strict=True)
    return [None if c[0] is None else c for c in counts]


def fit(pairs: DataFrame, stats: Statistics, seen: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """The field fitted on about sample_rows rows, at most twice as many, drawn by a hash of
    the row.  Their features are made in tasks; the driver gets those of the sample only."""
    some = pairs.where(F.col("gold_answer").isNotNull() & F.col("agent_answer").isNotNull())
    chance = min(1.0, sample_rows / max(1, some.count()))
    drawn = F.pmod(F.xxhash64("grade_id", "question", "agent_answer"), F.lit(2**40)) < F.lit(int(chance * 2**40))
    sample = with_seen(some.where(drawn), seen).limit(2 * sample_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All features are there or not, and go as bits."""
        for batch in batches:
            rows = [(r, words) for r, words in zip(_rows(batch, 1), _seen(batch), strict=True) if not is_empty(r[2])]
            made = [clauses_of(*r, spans, stats, words) for (r, words), spans in zip(rows, _units([r[2] for r, _ in rows]), strict=True)]
            bits = [np.packbits(c.features > 0, axis=1).tobytes() for c in made]
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), pa.array([c.silver.tolist() for c in made], pa.list_(pa.int32()))], ["bits", "silver"])

    rows = []
    for r in sorted(sample.mapInArrow(featured, "bits binary, silver array<int>").toArrow().to_pylist(), key=lambda r: (r["bits"], r["silver"])):
        silver = np.array(r["silver"])
        x = np.unpackbits(np.frombuffer(r["bits"], np.uint8).reshape(len(silver), -1), axis=1)[:, : PLAIN_FEATURES + WORD_FEATURES].astype(np.float32)
        x[:, PLAIN_FEATURES:] *= WORD_WEIGHT
        rows.append(Clauses([], x, silver))
    return fit_field(rows)


def defective_pairs(pairs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(grade_id, defect, answer_share, refusal_share, echo_share, foreign_share,
    unfinished_share) of each defective row.

    Null or blank answers are ``empty``; rows with a null gold_answer can only be
    that; a null question is held as an empty one.  Responses of any length are
    read whole; repeated rows give repeated results; ties between tags go to the
    first; other columns are not read; no rows give no rows."""
    stats, words = count(pairs)
    seen = seen_words(pairs, words)
    field = fit(pairs, stats, seen, sample_rows)
    names = [f"{t}_share" for t in ("answer", "refusal", "echo", "foreign", "unfinished")]
    schema = T.StructType([pairs.schema["grade_id"], T.StructField("defect", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_rows(batch, 1))
            got = [defect_of(*row, spans, counts, field, stats) for row, spans, counts in zip(rows, _units([r[2] for r in rows]), _seen(batch), strict=True)]
            cols = [batch.column(0), pa.array([d for d, _ in got], pa.string()), *(pa.array([s[k] for _, s in got], pa.float64()) for k in range(TAGS))]
            yield pa.RecordBatch.from_arrays(cols, ["grade_id", "defect", *names])

    return with_seen(pairs, seen).mapInArrow(run, schema).where(F.col("defect").isNotNull())
