"""Tables that say which characters look the same.

The tables are generated from Unicode decomposition rules; only the look-alike
letters of other scripts, which no Unicode property lists, are written out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y",
    "ο": "o",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Hyphens drawn like the ASCII hyphen-minus.
HYPHENS = "‐‑﹣－"
# Visible signs that Unicode nevertheless files under Cf.
VISIBLE_FORMAT = "؀؁؂؃؄؅۝܏࣢"
#: Blocks whose compatibility forms are drawn like what they decompose to:
#: radicals, Latin and Arabic ligatures and presentation forms, width forms.
SAME_LOOK_BLOCKS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2E80, 0x2FDF), (0xFB00, 0xFDFB), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE))


@lru_cache(maxsize=1)
def invisible() -> str:
    """All characters without any width, in code-point order."""
    out = []
    for cp in [*range(0x20, 0x10000), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        selector = 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180F
        if (cat == "Cf" and ch not in VISIBLE_FORMAT) or selector or cp == 0x034F:
            out.append(ch)
    return "".join(out)


@lru_cache(maxsize=1)
def blanks() -> str:
    """Every blank other than the plain space; line breaks are not blanks."""
    return "\t" + "".join(chr(cp) for cp in range(0x80, 0x3001) if unicodedata.category(chr(cp)) == "Zs")


@lru_cache(maxsize=1)
def compat_single() -> dict[str, str]:
    """Compatibility form -> the one character it is drawn like."""
    table = {b: " " for b in blanks()} | {h: "-" for h in HYPHENS}
    for lo, hi in SAME_LOOK_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            # a bare kana voicing sign must stay a combining mark, to compose with the letter before it
            to = {"ﾞ": "゙", "ﾟ": "゚"}.get(ch) or unicodedata.normalize("NFKC", ch)
            if len(to) == 1 and to != ch and ch not in table:
                table[ch] = " " if to == "　" else to
    return table


@lru_cache(maxsize=1)
def compat_multi() -> dict[str, str]:
    """Ligature -> the letters it joins."""
    table = {}
    for lo, hi in SAME_LOOK_BLOCKS:
        for cp in range(lo, hi + 1):
            to = unicodedata.normalize("NFKC", chr(cp))
            if len(to) > 1 and " " not in to and unicodedata.category(chr(cp))[0] == "L":
                table[chr(cp)] = to
    return table


@lru_cache(maxsize=1)
def lookalike_single() -> dict[str, str]:
    """Look-alike letters, and those with marks that Unicode has composed."""
    table = dict(LOOKALIKE)
    for cp in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        nfd = unicodedata.normalize("NFD", chr(cp))
        if len(nfd) > 1 and nfd[0] in LOOKALIKE:
            to = unicodedata.normalize("NFC", LOOKALIKE[nfd[0]] + nfd[1:])
            if len(to) == 1:
                table.setdefault(chr(cp), to)
    return table
