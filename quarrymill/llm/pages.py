"""Keyword-stuffed and link-list pages (problem 9): a hidden Markov model of lines.

Every line becomes one symbol, packed from four binned measures: what
the line looks like (links, hash tags, priced items, code or table, heading,
other), its share of function words, the words between two separators, and how
much the page repeats its words.  The model's states are prose, link list, tag
list, menu and data (code and tables, which are neither).  It is fitted on a
bounded sample of pages by Viterbi training from seed labels, and every page of
the corpus is then decoded; a page is flagged if most of its words stand in
links, tags and menus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import glyphs

PROSE, LINKS, TAGS, MENU, DATA = range(5)
STATES = 5
KINDS, FUNCS, SEGS, REPS = 6, 5, 4, 3
K_OTHER, K_LINK, K_HASH, K_PRICE, K_DATA, K_PIPE = range(KINDS)
#: Pages the model is fitted on, about (whole corpus if it has fewer), drawn by hash.
SAMPLE_PAGES = 3000
#: Share of non-prose words from which a page is flagged.
MOST = 0.5

# Function words by language, with the abbreviations that sentences refer by.
FUNCTION_WORDS = """
the of and to in is that with was on at it its which once before so if not when from as than this neither nor
does asked why whose each every any under only
der die das und den von zu mit ein eine einen im ist nicht auf für bei dem des noch weder wer hat wird so man sich sollte
vgl abschn nr abb tab usw ca bis laut über am erst oder
el la los las en que por según para una un tras desde ninguna cuya cuyo recibe y se al del cuando con
aprox pág núm fig art
le les des du et est une dans pour avec qui par sur après avant la encore jamais cite il
env ex etc
и в не на что если для из к до с под после модуля показано как ли или при
см п т е д г рис табл прибл
ο η το του της και σε με από για στο στη στην μετά ένα γιατί λείπει μη είναι την ότι
βλ σελ π χ
في من إلى ما هل على أن عند بعد إذا كان ثم التي مشكلة رسالة زال انظر وإلا نوع أجل
के का की में है से को पर ने और भी लिए कर रह या जो क्या अब तक ही गया गई होता हो जाता
""".split()
CJK_FUNCTION = "[ぁ-ゖ]|[的了会与和从到后仍被将请就于为]"
THAI_FUNCTION = "ของ|ที่|ให้|และ|ไปยัง|โดย|ไม่|จาก|เป็น|ได้|แล้ว|ก่อน|ทำ|ควร|สำหรับ|เมื่อ|ใช้|แก้|ส่ง|อ่าน|หลัง|เหลือ"

_LINE_ENDS = re.compile(r"[\n\r]+")
_HEADING = re.compile(r"\s*#{1,6}\s")
# letters with the vowel signs and accents that stand on them
_WORD = re.compile("(?:[^\\W\\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0e31\u0e34-\u0e4e])+")
_CJK = re.compile(r"[ぁ-ヿ一-鿿]")
_CJK_FUNCTION = re.compile(CJK_FUNCTION)
_THAI = re.compile(r"[ก-๎]")
_THAI_FUNCTION = re.compile(THAI_FUNCTION)
_LINK = re.compile(r"https?://|www\.|href=")
_HASH = re.compile(r"(?:^|\s)#[^\W\d_]")
_PRICE = re.compile(r"\bsku|\d[.,]\d\d ?(?:usd|eur|€|\$)|[$€]\d")
_CODE = re.compile(r"\s*\|.*\|\s*$|.*[;{}]\s*$|\s*[\w.\[\]]+\s*=\s*\S|\s*[{\[<](?!a )|\s*[-*+>]?\s*`[^`]*`:\s*\d")
_PIPE = re.compile(r" (?:[|/»·•>]|>>) ")
_BREAK = re.compile(r"\s[|/»;,>·•\-]+\s|[;,|、；，]|[.!?؟](?=\s|$)|[。！？।]")
_ONE = {ord(k): v for k, v in glyphs.LOOKALIKE.items()}
_FUNCTION = frozenset(x.translate(_ONE).lower() for w in FUNCTION_WORDS for x in (w, w.capitalize()))


def _one_form() -> dict[int, str | None]:
    """Look-alikes and width forms in one form, invisible characters dropped."""
    table: dict[int, str | None] = {ord(k): v for k, v in (glyphs.compat_single() | glyphs.LOOKALIKE).items()}
    return table | {ord(c): None for c in glyphs.invisible()}


def page_symbols(text: str | None, table: dict[int, str | None]) -> tuple[list[int], list[int]]:
    """Symbol and words of every line that holds something, headings apart."""
    if not text:
        return [], []
    lower = text.translate(table).lower()
    page = _WORD.findall(lower)
    variety = len(set(page)) / max(1, len(page))
    rep = 2 if variety < 0.3 else 1 if variety < 0.45 else 0
    symbols, sizes = [], []
    for line in _LINE_ENDS.split(lower):
        if not line.strip() or _HEADING.match(line):
            continue
        function = sum(w in _FUNCTION for w in _WORD.findall(line))
        words = len(line.split())
        if not line.isascii():
            cjk = len(_CJK.findall(line))
            words += cjk // 2 + len(_THAI.findall(line)) // 5
            if cjk:
                function += len(_CJK_FUNCTION.findall(line)) / 2
            function += len(_THAI_FUNCTION.findall(line))
        words = max(1, words)
        urls, hashes = len(_LINK.findall(line)), len(_HASH.findall(line))
        prices, pipes = len(_PRICE.findall(line)), len(_PIPE.findall(line))
        share = function / words
        per_segment = words / (len(_BREAK.findall(line)) + 1)
        if urls >= 3 or urls and urls * 7 >= words:
            kind = K_LINK
        elif hashes * 2 >= words:
            kind = K_HASH
        elif prices >= 2 and prices * 5 >= words:
            kind = K_PRICE
        elif _CODE.match(line):
            kind = K_DATA
        elif pipes >= 3 and pipes * 6 >= words:
            kind = K_PIPE
        else:
            kind = K_OTHER
        func = (share >= 0.03) + (share >= 0.1) + (share >= 0.17) + (share >= 0.26)
        seg = (per_segment >= 3.5) + (per_segment >= 5.5) + (per_segment >= 8)
        symbols.append(((kind * FUNCS + func) * SEGS + seg) * REPS + rep)
        sizes.append(words)
    return symbols, sizes


@dataclass(frozen=True)
class Model:
    """Log probabilities of the first state, of moves and of each measure by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # by symbol and state


def _unpack(symbols: np.ndarray) -> tuple[np.ndarray, ...]:
    rest, rep = np.divmod(symbols, REPS)
    rest, seg = np.divmod(rest, SEGS)
    kind, func = np.divmod(rest, FUNCS)
    return kind, func, seg, rep


def seed_labels(symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
    """First guess of a line's state from its measures alone."""
    kind, func, seg, rep = _unpack(symbols)
    label = np.where((func >= 2) & (seg >= 1), PROSE, np.where((func <= 1) & (seg <= 2), TAGS, PROSE))
    label = np.where((kind == K_PIPE) & (words <= 20), MENU, label)
    label = np.where((kind == K_PIPE) & (words > 20) & (func <= 2), TAGS, label)
    label = np.where(np.isin(kind, (K_HASH, K_PRICE)), TAGS, label)
    label = np.where(kind == K_LINK, LINKS, label)
    return np.where(kind == K_DATA, DATA, label)


def estimate(symbols: np.ndarray, labels: np.ndarray, first: np.ndarray) -> Model:
    """Smoothed relative frequencies; the measures are independent given the state."""
    start = np.bincount(labels[first], minlength=STATES) + 1.0
    move = np.ones((STATES, STATES))
    np.add.at(move, (labels[:-1][~first[1:]], labels[1:][~first[1:]]), 1)
    every = _unpack(np.arange(KINDS * FUNCS * SEGS * REPS))
    emit = np.zeros((len(every[0]), STATES))
    for seen, values, size in zip(_unpack(symbols), every, (KINDS, FUNCS, SEGS, REPS), strict=True):
        table = np.full((size, STATES), 0.5)
        np.add.at(table, (seen, labels), 1)
        emit += np.log(table / table.sum(0))[values]
    return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), emit)


def decode(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Viterbi states of many pages at once, as one flat array."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    size, at = lengths[order], starts[order]
    most = int(size[0]) if len(size) else 0
    live_at = [int(np.searchsorted(-size, -k, side="left")) for k in range(most)]
    states = np.zeros(len(symbols), np.int64)
    if not most:
        return states
    live = live_at[0]
    score = model.start + model.emit[symbols[at[:live]]]
    back = []
    for k in range(1, most):
        live = live_at[k]
        through = score[:live, :, None] + model.move
        back.append(through.argmax(1).astype(np.int8))
        score[:live] = through.max(1) + model.emit[symbols[at[:live] + k]]
    state = score.argmax(1)
    for k in range(most - 1, -1, -1):
        live = live_at[k]
        states[at[:live] + k] = state[:live]
        if k:
            state[:live] = back[k - 1][np.arange(live), state[:live]]
    return states


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = 4) -> Model:
    """Viterbi training on about sample_pages pages, at most twice as many, drawn
    by a hash of page and text.  The driver gets the packed symbols of those only."""
    some = pages.where(F.col("text").isNotNull())
    chance = min(1.0, sample_pages / max(1, pages.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40)) < F.lit(int(chance * 2**40))
    shown = some.where(drawn).limit(2 * sample_pages)
    schema = T.StructType([T.StructField("symbols", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _one_form()
        for batch in batches:
            got = [page_symbols(t, table) for t in batch.column(0).to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, ["symbols", "words"])

    rows = [r for r in shown.select("text").mapInArrow(run, schema).toArrow().to_pylist() if r["symbols"]]
    rows = rows or [{"symbols": [0], "words": [1]}]
    lengths = np.array([len(r["symbols"]) for r in rows])
    symbols = np.array([x for r in rows for x in r["symbols"]], np.int64)
    words = np.array([x for r in rows for x in r["words"]], np.int64)
    first = np.zeros(len(symbols), bool)
    first[np.cumsum(lengths) - lengths] = True
    # one line of each state keeps every state alive in any sample
    labels = seed_labels(symbols, words)
    for _ in range(rounds):
        model = estimate(symbols, labels, first)
        labels = decode(model, symbols, lengths)
    return estimate(symbols, labels, first)


def scored(pages: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, link_words, tag_words, menu_words) of every page.

    Null, empty or blank text has no lines and counts 0 words; a text of any
    length is taken whole; repeated rows give repeated results; ties between
    states go to the first of them; other columns are not read."""
    names = ["n_words", "link_words", "tag_words", "menu_words"]
    schema = T.StructType([pages.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _one_form()
        for batch in batches:
            got = [page_symbols(t, table) for t in batch.column(1).to_pylist()]
            lengths = np.array([len(g[0]) for g in got], np.int64)
            symbols = np.array([x for g in got for x in g[0]], np.int64)
            words = np.array([x for g in got for x in g[1]], np.int64)
            states = decode(model, symbols, lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            sums = [np.bincount(owner, words * (states == s) if s is not None else words, minlength=len(lengths)).astype(np.int64) for s in (None, LINKS, TAGS, MENU)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["doc_id", *names])

    return pages.select("doc_id", "text").mapInArrow(run, schema)


def spam_pages(pages: DataFrame, most: float = MOST, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(doc_id, n_words, non_prose_words, non_prose_share) of the flagged pages."""
    out = scored(pages, fit(pages, sample_pages))
    non_prose = F.col("link_words") + F.col("tag_words") + F.col("menu_words")
    out = out.select("doc_id", "n_words", non_prose.alias("non_prose_words"), F.try_divide(non_prose.cast("double"), "n_words").alias("non_prose_share"))
    return out.where(F.col("non_prose_share") > most)
