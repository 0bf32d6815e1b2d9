"""Sentence units across languages and scripts (problem 1).

The rules are compiled into a finite transducer.  Each character becomes one
symbol of a small alphabet (its class, the class of what follows, whether it
ends an abbreviation); the transducer's states hold what is open around it: a
quotation, a bracket, a code span, and whether those opened at a sentence start.
Running text is cut into tiles.  A tile that starts a block of text starts in
the known state; every other tile is first run as a function from entry state
to exit state, the functions of one block are composed by a parallel prefix
scan, and then all tiles are run once more from their known entry states.  All
of that is done with arrays over a whole Arrow batch at a time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import glyphs

#: Characters of text handled at a time inside a task (bounds its memory).
SLICE_CHARS = 500_000
#: Symbols of a tile; longer blocks of text go through the prefix scan.
TILE = 64

# Abbreviations after which a sentence goes on, whatever follows.
STRONG = """
e.g i.e vs v cf med resp approx viz ca rev dr mr mrs prof
abschn vgl bzw evtl ggf inkl
aprox ej ee sr sra dra
env ex mme
е т п см прибл напр
βλ π.χ δηλ
ص د
पृ डॉ
""".split()
# Abbreviations only before a number ("No. 5", "p. 12").
NUMERIC = "no nos p pp vol nr art arts fig figs sec ref refs ch eq abb tab núm pág págs кн № рис табл стр гл σελ αρ n°".split()
# Abbreviations that close a sentence only before a capital.
WEAK = "u.s a.m p.m inc ltd corp co uu jr".split()
# Abbreviations that close a sentence unless a small letter follows.
FINAL = "etc usw г д др пр гг κ.λπ κλπ".split()
# Small words that no lower-case name stands in for.
JOINERS = "and or on in of to for at by with und oder y o et ou и или".split()
# Month names after a German ordinal ("11. April").
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember".split()

OTHER, UP, LOW, LETTER, DIGIT, BLANK, NL, TERM, OPENB, CLOSEB, OPENQ, CLOSEQ, AQ, TICK, THAI, KANA, CJK, INVERT, SEMI, INVIS = range(20)
CJK_TERMS = "。！？｡"
DANDA = "।॥"
TERMS = ".!?…؟。！？｡．‼⁇⁈⁉।॥"
LINE_ENDS = "\n\r\x0b\x0c\x85  "

# Symbols of the transducer.  ADJ: nothing but blanks and closers since a stop.
S_WORD, S_STOP, S_NOSTOP, S_OPENB, S_OPENB_ADJ, S_OPENQ, S_OPENQ_ADJ, S_DEQ, S_DEQ_ADJ, S_TICK, S_SOFT = range(11)
S_CLOSEB = 11  # + kind
S_CLOSEQ = 15
S_AQ = 19
S_AQ_ADJ = 23
S_LQ = 27  # “ , which opens in English and Chinese and closes in German
S_LQ_ADJ = 31
N_SYMBOLS = 35
# Kinds of closers: no stop inside; stop and a sentence start follows; stop but
# the sentence seems to go on; stop of a script without blanks.
K_NONE, K_START, K_ON, K_TIGHT = range(4)


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray, int]:
    """Next state and output (1: a unit ends here) by symbol and state.

    A state is (quote, bracket, tick, fresh): quote 0 none, 1 open, 2 opened at
    a sentence start, 3 and 4 the same for „; bracket 0 none, 1 open, 2 opened
    at a sentence start; tick whether a code span is open; fresh whether a unit
    has just ended."""
    states = [(q, b, t, f) for q in range(5) for b in range(3) for t in range(2) for f in range(2)]
    number = {s: i for i, s in enumerate(states)}
    step = np.zeros((N_SYMBOLS, len(states)), np.uint8)
    emit = np.zeros((N_SYMBOLS, len(states)), bool)

    def close(kind: int, at_start: bool, bracket: bool, outer: bool) -> bool:
        if not outer or kind == K_NONE:
            return False
        if kind == K_START:
            return True
        return at_start if bracket else kind == K_TIGHT and not at_start

    for (q, b, t, f), i in number.items():
        for sym in range(N_SYMBOLS):
            q2, b2, t2, f2, out = q, b, t, 0, False
            if sym == S_TICK:
                t2 = 1 - t
            elif t:
                pass  # inside a code span nothing counts
            elif sym in (S_STOP, S_SOFT):
                out = not q and not b
            elif sym in (S_OPENB, S_OPENB_ADJ):
                b2 = b or (2 if f and sym == S_OPENB_ADJ and not q else 1)
            elif sym in (S_OPENQ, S_OPENQ_ADJ):
                q2 = q or (2 if f and sym == S_OPENQ_ADJ and not b else 1)
            elif sym in (S_DEQ, S_DEQ_ADJ):
                q2 = q or (4 if f and sym == S_DEQ_ADJ and not b else 3)
            elif S_CLOSEB <= sym < S_CLOSEB + 4:
                out, b2 = close(sym - S_CLOSEB, b == 2, True, not q), 0
            elif S_CLOSEQ <= sym < S_CLOSEQ + 4:
                out, q2 = close(sym - S_CLOSEQ, q in (2, 4), False, not b), 0
            elif S_AQ <= sym < S_LQ:
                adj, kind = sym >= S_AQ_ADJ, (sym - S_AQ) % 4
                if q:
                    out, q2 = close(kind, q in (2, 4), False, not b), 0
                else:
                    q2 = 2 if f and adj and not b else 1
            elif sym >= S_LQ:
                adj, kind = sym >= S_LQ_ADJ, (sym - S_LQ) % 4
                if q in (3, 4):
                    out, q2 = close(kind, q == 4, False, not b), 0
                else:
                    q2 = q or (2 if f and adj and not b else 1)
            if out:
                f2 = 1
            step[sym, i], emit[sym, i] = number[q2, b2, t2, f2], out
    return step, emit, number[0, 0, 0, 1]


def run_transducer(symbols: np.ndarray, lane_start: np.ndarray) -> np.ndarray:
    """Which symbols end a unit.  lane_start: where each block of text begins
    in symbols, ascending; every block begins in the start state."""
    step, emit, start = transducer()
    n = len(symbols)
    out = np.zeros(n, bool)
    if not n:
        return out
    ends = np.append(lane_start[1:], n)
    tiles_of = -(-(ends - lane_start) // TILE)
    lane = np.repeat(np.arange(len(lane_start)), tiles_of)
    nth = np.arange(len(lane)) - np.repeat(np.cumsum(tiles_of) - tiles_of, tiles_of)
    at = lane_start[lane] + nth * TILE
    size = np.minimum(ends[lane] - at, TILE)
    entry = np.full(len(at), start, np.uint8)
    later = np.flatnonzero(tiles_of[lane] > 1)
    if len(later):
        # tiles of long blocks as functions from entry state to exit state
        f = np.tile(np.arange(step.shape[1], dtype=np.uint8), (len(later), 1))
        for k in range(int(size[later].max())):
            on = size[later] > k
            f[on] = step[symbols[at[later[on]] + k][:, None], f[on]]
        # inclusive prefix scan by doubling: f[i] becomes f[i] after ... after f[first]
        reach = 1
        while reach <= int(nth[later].max()):
            to = np.flatnonzero(nth[later] >= reach)
            f[to] = np.take_along_axis(f[to], f[to - reach], axis=1)
            reach *= 2
        inner = np.flatnonzero(nth[later] > 0)
        entry[later[inner]] = f[inner - 1, start]
    order = np.argsort(-size, kind="stable")
    at, size, state = at[order], size[order], entry[order]
    for k in range(int(size[0])):
        live = int(np.searchsorted(-size, -k, side="left"))  # sizes above k come first
        sym = symbols[at[:live] + k]
        out[at[:live] + k] = emit[sym, state[:live]]
        state[:live] = step[sym, state[:live]]
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and skeleton (lower case, one form of what looks alike) by code point."""
    cls = np.full(65536, OTHER, np.uint8)
    skel = np.arange(65536, dtype=np.uint16)
    single = glyphs.compat_single() | glyphs.lookalike_single()
    for cp in range(65536):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if 0x0E01 <= cp <= 0x0E4E:
            cls[cp] = THAI
        elif cat in ("Lu", "Lt"):
            cls[cp] = UP
        elif cat == "Ll":
            cls[cp] = LOW
        elif 0x3041 <= cp <= 0x30FF or 0xFF66 <= cp <= 0xFF9F:
            cls[cp] = KANA
        elif 0x2E80 <= cp <= 0x9FFF and cat[0] in "LS" or 0xF900 <= cp <= 0xFAFF:
            cls[cp] = CJK
        elif cat[0] == "L" or cat in ("Mc", "Mn"):
            cls[cp] = LETTER
        elif cat == "Nd":
            cls[cp] = DIGIT
        elif cat == "Zs" or ch == "\t":
            cls[cp] = BLANK
        to = unicodedata.normalize("NFD", single.get(ch, ch).lower())[0]
        skel[cp] = ord(single.get(to, to)[0]) if ord(to) < 65536 else cp
    for chars, c in ((LINE_ENDS, NL), (TERMS, TERM), ("([{（［｛【", OPENB), (")]}）］｝】", CLOSEB), ("«„「『“", OPENQ), ("»」』”", CLOSEQ), ('"＂', AQ), ("`｀", TICK), ("¡¿", INVERT), (";；;", SEMI), (glyphs.invisible(), INVIS)):
        for ch in chars:
            if ord(ch) < 65536:
                cls[ord(ch)] = c
    cls[0x300:0x370] = INVIS  # accents on the letter before, as good as part of it
    cls[0x3099:0x309B] = INVIS
    return cls, skel


def _hash(word: str) -> int:
    _, skel = _tables()
    h = 0
    for ch in reversed(word):
        h = (h * 131 + int(skel[ord(ch)])) & 0xFFFFFFFF
    return h


@lru_cache(maxsize=1)
def _abbreviations() -> dict[str, np.ndarray]:
    out = {}
    for name, words in (("strong", STRONG), ("numeric", NUMERIC), ("weak", WEAK), ("final", FINAL)):
        both = {w for w in words} | {w.replace("fi", "ﬁ") for w in words if "fi" in w}
        out[name] = np.array(sorted({_hash(w) for w in both}), np.uint64)
    out["joiners"] = np.array(sorted({_forward(w) for w in JOINERS}), np.uint64)
    out["months"] = np.array(sorted({_forward(m) for m in MONTHS}), np.uint64)
    return out


def _forward(word: str) -> int:
    _, skel = _tables()
    h = 0
    for ch in word:
        h = (h * 131 + int(skel[ord(ch)])) & 0xFFFFFFFF
    return h


class _Gaps:
    """Where blanks and line ends lie; answers only for the places asked about."""

    def __init__(self, is_gap: np.ndarray):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_gap, [False]]).astype(np.int8)))
        self.first, self.past = edge[::2], edge[1::2]
        self.all = np.flatnonzero(is_gap)
        self.n = len(is_gap)

    def solid_from(self, at: np.ndarray) -> np.ndarray:
        """The first place at or after each that is no gap, else the length."""
        k = np.searchsorted(self.first, at, side="right") - 1
        past = self.past[np.maximum(k, 0)] if len(self.past) else at
        return np.where((k >= 0) & (at < past), past, at)

    def solid_upto(self, at: np.ndarray) -> np.ndarray:
        """The last place at or before each that is no gap, else -1."""
        k = np.searchsorted(self.first, at, side="right") - 1
        inside = (k >= 0) & (at < self.past[np.maximum(k, 0)]) if len(self.past) else np.zeros(len(at), bool)
        return np.where(inside, self.first[np.maximum(k, 0)] - 1, at) if len(self.past) else at

    def gap_from(self, at: np.ndarray) -> np.ndarray:
        """The first gap at or after each, else the length."""
        return np.append(self.all, self.n)[np.searchsorted(self.all, at)]

    def gap_upto(self, at: np.ndarray) -> np.ndarray:
        """The last gap at or before each, else -1."""
        return np.append(-1, self.all)[np.searchsorted(self.all, at, side="right")]


def unit_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, start, end) of every unit, in order."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    # each text is closed by a line end, so that no context leaks into the next
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    base = np.cumsum(lens + 1) - (lens + 1)
    cls_of, skel_of = _tables()
    low = np.minimum(raw, 0xFFFF)
    cls = cls_of[low]
    hidden = np.flatnonzero(cls == INVIS)
    seen = cls != INVIS
    keep = np.flatnonzero(seen)
    cls, low = cls[seen], low[seen]
    n = len(cls)
    text_end = base + lens - np.searchsorted(hidden, base + lens)  # the closing line end of each text
    is_nl = cls == NL
    is_gap = is_nl | (cls == BLANK)
    gaps = _Gaps(is_gap)
    top = n - 1

    def c_at(at: np.ndarray) -> np.ndarray:
        return cls[np.minimum(np.maximum(at, 0), top)]

    def skel_at(at: np.ndarray) -> np.ndarray:
        return skel_of[low[np.minimum(np.maximum(at, 0), top)]]

    # lines
    nl_at = np.flatnonzero(is_nl)
    line_from = np.append(0, nl_at[:-1] + 1)
    first = gaps.solid_from(line_from)
    empty = first >= nl_at
    firstc = np.where(empty, 0, skel_at(first))
    gap_after = is_gap[np.minimum(first + 1, top)]
    mark_end = first.copy()
    for _ in range(6):
        mark_end += (skel_at(mark_end) == ord("#")) & (mark_end < nl_at)
    heading = (firstc == ord("#")) & is_gap[np.minimum(mark_end, top)]
    bullet = np.isin(firstc, [ord(c) for c in "-*+•"]) & gap_after
    row = (firstc == ord("|")) | (firstc == ord(">"))
    dig_end = first.copy()
    for _ in range(3):
        dig_end += (c_at(dig_end) == DIGIT) & (dig_end < nl_at)
    mark = skel_at(dig_end)
    numbered = (dig_end > first) & ((mark == ord(".")) | (mark == ord(")"))) & is_gap[np.minimum(dig_end + 1, top)]
    # a line of data without prose: one long word of an object, a list or a tag
    one_word = (gaps.gap_from(first) >= nl_at) & (nl_at - first > 40) & np.isin(firstc, [ord(c) for c in "{[<"])
    text_of_line = np.searchsorted(text_end, nl_at)
    same = np.append(False, text_of_line[1:] == text_of_line[:-1])
    structural = ~empty & (heading | bullet | row | one_word)
    # "11. April" at the start of a wrapped line is no list item: a numbered line
    # right below running text goes on with it
    running = ~empty & ~structural & ~numbered
    structural |= ~empty & numbered & ~(np.append(False, running[:-1]) & same)
    new_block = np.ones(len(nl_at), bool)
    new_block[1:] = ~(same[1:] & ~empty[1:] & ~empty[:-1] & ~structural[1:] & ~structural[:-1])
    opens = np.flatnonzero(new_block)
    block_from = line_from[opens]
    block_end = np.append(block_from[1:], n)
    plain = ~structural[opens] & ~empty[opens]  # blocks of running text

    def block_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(block_from, at, side="right") - 1

    def places(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(flag)
        blk = block_of(at)
        on = plain[blk]
        return at[on], blk[on]

    def following(at: np.ndarray, blk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next solid place, its class, and whether it lies in the block."""
        f = gaps.solid_from(at + 1)
        inside = f < block_end[blk]
        return f, np.where(inside, c_at(f), NL), inside

    def named(at: np.ndarray, blk: np.ndarray) -> np.ndarray:
        """A word and then a number: a lower-case name and its version."""
        gap = gaps.gap_from(at)
        num = gaps.solid_from(gap)
        yes = (num < block_end[blk]) & (c_at(num) == DIGIT)
        maybe = np.flatnonzero(yes & (gap - at < 5))
        h = np.zeros(len(maybe), np.uint64)
        for k in range(4):
            on = at[maybe] + k < gap[maybe]
            h = np.where(on, (h * 131 + skel_at(at[maybe] + k)) & 0xFFFFFFFF, h)
        yes[maybe[np.isin(h, _abbreviations()["joiners"])]] = False
        return yes

    ev_at, ev_blk, ev_sym = [], [], []

    def event(at: np.ndarray, blk: np.ndarray, sym: np.ndarray | int) -> None:
        ev_at.append(at)
        ev_blk.append(blk)
        ev_sym.append(np.broadcast_to(np.asarray(sym, np.uint8), at.shape))

    # stops
    stop_kind = np.zeros(n, np.int8)  # what a closer finds inside it: 1 a stop, 2 one of a script without blanks
    t_at, t_blk = places(cls == TERM)
    if len(t_at):
        head = np.append(True, np.diff(t_at) > 1)
        i, j, blk = t_at[head], t_at[np.append(head[1:], True)], t_blk[head]
        ncls = c_at(j + 1)
        f, fc, fin = following(j, blk)
        pcls = np.where(i > 0, c_at(i - 1), NL)
        gap_next = is_gap[np.minimum(j + 1, top)]
        one = i == j
        c, cj = low[i], low[j]
        dot_i, dot_j = skel_at(i) == ord("."), skel_at(j) == ord(".")
        dot = dot_i & one
        tight_term = np.isin(cj, [ord(x) for x in CJK_TERMS])
        danda = np.isin(c, [ord(x) for x in DANDA])
        dots = (dot_i | (c == 0x2026)) & (dot_j | (cj == 0x2026)) & (~one | (c == 0x2026))
        cjk_dots = dots & (np.isin(ncls, (CJK, KANA)) | np.isin(pcls, (CJK, KANA)))
        low_next = fc == LOW
        name_next = low_next & (named(f, blk) | (c_at(f + 1) == UP))
        # the token before a single dot, read backwards
        h = np.zeros(len(i), np.uint64)
        piece = np.zeros(len(i), np.uint64)  # the same up to the next dot ("ago.Fig. 7")
        length = np.zeros(len(i), np.int64)
        digits = np.ones(len(i), bool)
        alive, whole = dot.copy(), dot.copy()
        for k in range(1, 10):
            at = i - k
            kc = c_at(at)
            ks = skel_at(at)
            alive = alive & (at >= 0) & (np.isin(kc, (UP, LOW, LETTER, DIGIT)) | (ks == ord(".")) | (ks == 0xB0) | (ks == 0x2116))
            h = np.where(alive, (h * 131 + ks) & 0xFFFFFFFF, h)
            whole = whole & alive & (ks != ord("."))
            piece = np.where(whole, h, piece)
            digits &= ~alive | (kc == DIGIT)
            length += alive
        known = dot & (length > 0) & (length < 9)
        ab = _abbreviations()
        numeric = dot & np.isin(piece, ab["numeric"]) & (fc == DIGIT)
        final = known & np.isin(h, ab["final"])
        weak = known & np.isin(h, ab["weak"]) | final
        strong = known & np.isin(h, ab["strong"]) & ~weak
        initial = known & (length == 1) & ~digits & np.isin(pcls, (UP, LOW)) & ~weak
        ordinal = known & digits & (length <= 2) & gap_next & fin
        fw = np.zeros(len(i), np.uint64)
        go = ordinal.copy()
        for k in range(10):
            go = go & np.isin(c_at(f + k), (UP, LOW))
            fw = np.where(go, (fw * 131 + skel_at(f + k)) & 0xFFFFFFFF, fw)
        ordinal &= np.isin(fw, ab["months"])
        start_next = np.isin(fc, (UP, LETTER, DIGIT, INVERT, OPENQ, OPENB, AQ, TICK, THAI, KANA, CJK, OTHER))
        spaced = gap_next & fin & np.where(weak, (fc == UP) | final & (start_next | name_next), start_next | low_next)
        spaced &= ~(dots & low_next & ~name_next)  # spaced-off dots: a lower-case word goes on
        word_before = np.isin(pcls, (LOW, DIGIT, LETTER, CLOSEB, CLOSEQ, AQ, TICK, OTHER))
        upper_word = (ncls == UP) & np.isin(c_at(j + 2), (LOW, BLANK, NL, LETTER, UP, TERM))
        glued = ~gap_next & (j + 1 < block_end[blk]) & word_before & (~weak | final)
        glued &= upper_word | np.isin(ncls, (INVERT, OPENB, TICK, AQ)) | (ncls == LETTER) & np.isin(pcls, (LETTER, DIGIT))
        # in an address or a path nothing is glued
        hit = np.flatnonzero(glued)
        if len(hit):
            sep = np.flatnonzero(np.isin(low, [ord("/"), ord("@"), ord("=")]))
            frm, to = gaps.gap_upto(i[hit]), gaps.gap_from(j[hit])
            glued[hit] = np.searchsorted(sep, frm) == np.searchsorted(sep, to)
        always = ((tight_term | cjk_dots) & ~gap_next) | danda
        always &= fin & ~np.isin(ncls, (CLOSEB, CLOSEQ, TERM)) & ~(np.isin(ncls, (DIGIT, LOW)) & ~tight_term & np.isin(pcls, (DIGIT, LOW)))
        stop = ((spaced | glued) & ~(strong | numeric | initial | ordinal)) | always
        event(j, blk, np.where(stop, S_STOP, S_NOSTOP))
        stop_kind[j] = np.where(tight_term | cjk_dots | danda, 2, 1)
    # Greek semicolon: a question mark where the letters before it are Greek
    semi, blk = places(cls == SEMI)
    if len(semi):
        w = np.minimum(semi - block_from[blk], 120)
        near = low[np.maximum(semi[:, None] - np.arange(1, 121)[None, :], 0)]
        within = np.arange(1, 121)[None, :] <= w[:, None]
        greek = ((near >= 0x370) & (near < 0x400) & within).sum(1)
        latin = ((near < 0x250) & np.isin(cls_of[near], (UP, LOW)) & within).sum(1)
        is_greek = 2 * greek > latin
        _, fc, fin = following(semi, blk)
        go = is_greek & is_gap[np.minimum(semi + 1, top)] & fin & np.isin(fc, (UP, INVERT, OPENQ, TICK, AQ, DIGIT))
        event(semi[go], blk[go], S_STOP)
        stop_kind[semi[is_greek]] = 1
    # Thai: a blank between Thai letters
    thai = np.flatnonzero(cls == THAI)
    thai = thai[(cls[np.minimum(thai + 1, top)] == BLANK)]
    if len(thai):
        blk = block_of(thai)
        f, fc, fin = following(thai, blk)
        go = plain[blk] & fin & np.isin(fc, (THAI, INVERT, OPENQ)) & (gaps.gap_from(thai + 1) < f)
        go &= np.searchsorted(nl_at, f) == np.searchsorted(nl_at, thai)
        event(thai[go] + 1, blk[go], S_SOFT)
    # brackets, quotes and code spans, those of a block only if they pair up
    nb = len(block_from)

    def count(blk: np.ndarray) -> np.ndarray:
        return np.bincount(blk, minlength=nb)

    def adjacent(at: np.ndarray, blk: np.ndarray) -> np.ndarray:
        p = gaps.solid_upto(at - 1)
        return (p < block_from[blk]) | np.isin(c_at(p), (TERM, CLOSEB, CLOSEQ, AQ, SEMI))

    def closer_kind(at: np.ndarray, blk: np.ndarray) -> np.ndarray:
        inside = gaps.solid_upto(at - 1)
        for _ in range(3):  # through other closers
            more = (inside >= 0) & np.isin(c_at(inside), (CLOSEB, CLOSEQ, AQ))
            inside = np.where(more, gaps.solid_upto(inside - 1), inside)
        st = np.where(inside >= block_from[blk], stop_kind[np.maximum(inside, 0)], 0)
        ncls = c_at(at + 1)
        spaced = is_gap[np.minimum(at + 1, top)]
        f, fc, fin = following(at, blk)
        starts = np.isin(fc, (UP, LETTER, DIGIT, INVERT, OPENQ, OPENB, AQ, TICK, THAI, CJK, KANA))
        starts |= (fc == OTHER) & np.isin(skel_at(f), [ord("*"), ord("_")])
        starts &= spaced | (ncls == UP) | np.isin(ncls, (INVERT, TICK))
        starts |= (fc == LOW) & spaced & named(f, blk)
        tight = (st == 2) & ~spaced & ~np.isin(ncls, (TERM, CLOSEB, CLOSEQ, KANA, OTHER))
        kind = np.where(tight, K_TIGHT, np.where(starts, K_START, np.where(spaced & (fc == LOW), K_ON, K_NONE)))
        return np.where((st > 0) & fin, kind, K_NONE)

    ob, obb = places(cls == OPENB)
    if len(ob):
        cb, cbb = places(cls == CLOSEB)
        good = count(obb) == count(cbb)
        ob, obb, cb, cbb = ob[good[obb]], obb[good[obb]], cb[good[cbb]], cbb[good[cbb]]
        event(ob, obb, np.where(adjacent(ob, obb), S_OPENB_ADJ, S_OPENB))
        event(cb, cbb, S_CLOSEB + closer_kind(cb, cbb))
    tick, tickb = places(cls == TICK)
    if len(tick):
        good = (count(tickb) % 2 == 0)[tickb]
        event(tick[good], tickb[good], S_TICK)
    aq, aqb = places(cls == AQ)
    if len(aq):
        good = (count(aqb) % 2 == 0)[aqb]
        aq, aqb = aq[good], aqb[good]
        event(aq, aqb, np.where(adjacent(aq, aqb), S_AQ_ADJ, S_AQ) + closer_kind(aq, aqb))
    oq, oqb = places(cls == OPENQ)
    if len(oq):
        cq, cqb = places(cls == CLOSEQ)
        good = (count(oqb) + count(cqb)) % 2 == 0
        oq, oqb, cq, cqb = oq[good[oqb]], oqb[good[oqb]], cq[good[cqb]], cqb[good[cqb]]
        adj = adjacent(oq, oqb)
        sym = np.where(low[oq] == 0x201E, np.where(adj, S_DEQ_ADJ, S_DEQ), np.where(adj, S_OPENQ_ADJ, S_OPENQ))
        sym = np.where(low[oq] == 0x201C, np.where(adj, S_LQ_ADJ, S_LQ) + closer_kind(oq, oqb), sym)
        event(oq, oqb, sym)
        event(cq, cqb, S_CLOSEQ + closer_kind(cq, cqb))

    breaks = np.zeros(0, np.int64)
    if ev_at:
        at = np.concatenate(ev_at)
        order = np.argsort(at, kind="stable")
        at, blk, sym = at[order], np.concatenate(ev_blk)[order], np.concatenate(ev_sym)[order]
        if len(at):
            lanes = np.flatnonzero(np.append(True, np.diff(blk) != 0))
            breaks = at[run_transducer(sym, lanes)] + 1
    # units: from each cut to the next, without the blanks around them
    cuts = np.unique(np.concatenate([block_from, [n], breaks]))
    lo = gaps.solid_from(cuts[:-1])
    hi = gaps.solid_upto(cuts[1:] - 1) + 1
    ok = lo < hi
    lo, hi = lo[ok], hi[ok]
    # back to places in the texts; what has no width and follows a unit stays with it
    start, end = keep[lo], np.append(keep, len(raw))[hi]
    which = np.searchsorted(base, start, side="right") - 1
    return which, start - base[which], np.minimum(end, base[which] + lens[which]) - base[which]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most SLICE_CHARS characters (or one longer text)."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield a, k
            a, size = k, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def spans_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """unit_spans in slices: (units of each text, starts, ends)."""
    counts, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in _slices(texts):
        which, s, e = unit_spans(texts[a:b])
        counts.append(np.bincount(which, minlength=b - a))
        starts.append(s)
        ends.append(e)
    return np.concatenate(counts), np.concatenate(starts), np.concatenate(ends)


def with_units(df: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """One row per input row with non-null text: key, the kept columns and
    ``units``, an array of (sent_start, sent_end).

    Null text: no row.  Empty or blank text: a row with no units.  Text of any
    length is taken whole; repeated rows give repeated results; the other
    columns of the input, whatever their names, are not read."""
    cols = [key, *(keep or [])]
    unit = T.StructType([T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])
    schema = T.StructType([df.schema[c] for c in cols] + [T.StructField("units", T.ArrayType(unit))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, s, e = spans_of(batch.column(batch.schema.get_field_index("__text")).to_pylist())
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            units = pa.ListArray.from_arrays(
                pa.array(offsets), pa.StructArray.from_arrays([pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["sent_start", "sent_end"])
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(cols))), units], [*cols, "units"])

    chosen = df.where(F.col(text).isNotNull()).select(*cols, F.col(text).alias("__text"))
    return chosen.mapInArrow(run, schema)


def sent_ranges(chunks: DataFrame, bucket_chars: int = 65536) -> DataFrame:
    """(chunk_id, doc_id, sent_range): first and last unit of each chunk by its
    place among the distinct units of its document, counted from 0.

    A unit's place is the number of units before its group of buckets, before its
    bucket of bucket_chars characters in that group, and before it in its bucket, so
    that a document holding a third of all rows is never one task: of a document of n
    buckets no window has more than about the square root of n rows of counts.
    Chunks without units, or with null char_start or doc_id, get a null range."""
    keyed = with_units(chunks, "chunk_id", "text", ["doc_id", "char_start"])
    once = keyed.groupBy("chunk_id").agg(F.first(F.struct("doc_id", "char_start", "units")).alias("c")).select("chunk_id", "c.*")
    at = once.select("chunk_id", "doc_id", F.explode(F.transform("units", lambda u: u["sent_start"] + F.col("char_start"))).alias("at"))
    at = at.where(F.col("at").isNotNull() & F.col("doc_id").isNotNull()).withColumn("bucket", F.floor(F.col("at") / F.lit(bucket_chars)))
    places = at.groupBy("doc_id", "bucket", "at").agg(F.collect_list("chunk_id").alias("ids"))
    inside = places.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("at")) - 1)
    counts = places.groupBy("doc_id", "bucket").count()
    widest = counts.groupBy("doc_id").agg(F.ceil(F.sqrt(F.max("bucket") + 1.0)).alias("width"))
    counts = counts.join(widest, "doc_id").withColumn("group", F.floor(F.col("bucket") / F.col("width")))
    running = lambda n, keys, order: F.sum(n).over(Window.partitionBy(*keys).orderBy(order)) - F.col(n)
    groups = counts.groupBy("doc_id", "group").agg(F.sum("count").alias("n")).withColumn("ahead", running("n", ["doc_id"], "group"))
    before = counts.withColumn("within", running("count", ["doc_id", "group"], "bucket")).join(groups, ["doc_id", "group"]).select("doc_id", "bucket", (F.col("ahead") + F.col("within")).alias("before"))
    placed = inside.join(before, ["doc_id", "bucket"]).select(F.explode("ids").alias("chunk_id"), (F.col("before") + F.col("nth")).cast("int").alias("nth"))
    ranges = placed.groupBy("chunk_id").agg(F.array(F.min("nth"), F.max("nth")).alias("sent_range"))
    return once.select("chunk_id", "doc_id").join(ranges, "chunk_id", "left")


def sentence_units(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sent_start, sent_end), one row per unit of each chunk_id.

    Rows delivered again under a chunk_id count once: the text is cut where it
    lies, and only the cut places, not the texts, are shuffled to find repeats."""
    units = with_units(chunks, "chunk_id", "text").groupBy("chunk_id").agg(F.first("units").alias("units"))
    return units.select("chunk_id", F.explode("units").alias("u")).select("chunk_id", "u.sent_start", "u.sent_end")
