"""Kana to Hepburn, as a vectorised function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Rows of the kana table by consonant, the irregular syllables, and how syllables with small kana begin.
_VOWELS = "aiueo"
_ROWS = {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}
_ODD = {"し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "wo", "ん": "n", "ゔ": "vu"}
_SMALL = dict(zip("ぁぃぅぇぉ", _VOWELS))
_GLIDES = {"ゃ": "a", "ゅ": "u", "ょ": "o"}
_STEMS = {"き": "ky", "し": "sh", "ち": "ch", "に": "ny", "ひ": "hy", "み": "my", "り": "ry", "ぎ": "gy", "じ": "j", "ぢ": "j", "び": "by", "ぴ": "py"}
_FOREIGN = {"ふ": ("f", "ぁぃぇぉ"), "ゔ": ("v", "ぁぃぇぉ"), "う": ("w", "ぃぇぉ"), "て": ("t", "ぃ"), "で": ("d", "ぃ"), "と": ("t", "ぅ"), "ど": ("d", "ぅ"), "し": ("sh", "ぇ"), "ち": ("ch", "ぇ"), "じ": ("j", "ぇ")}
SYLLABLES = {c: k + v for k, row in _ROWS.items() for c, v in zip(row, _VOWELS)} | _ODD | _SMALL
SYLLABLES |= {g: "y" + v for g, v in _GLIDES.items()}
SYLLABLES |= {c + g: stem + v for c, stem in _STEMS.items() for g, v in _GLIDES.items()}
SYLLABLES |= {c + s: stem + _SMALL[s] for c, (stem, small) in _FOREIGN.items() for s in small}


def to_hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in unicodedata.normalize("NFKC", text))


def _syllable(kana: str, at: int) -> tuple[str, int]:
    """Romaji and length of the syllable at a place; '' where there is none."""
    for size in (2, 1):
        if (found := SYLLABLES.get(kana[at : at + size])) and len(kana) >= at + size:
            return found, size
    return "", 1


def romaji(text: str | None, capital: bool = False) -> str | None:
    """Hepburn without long marks; characters that are not kana stay.  capital: the first letter, too."""
    if text is None:
        return None
    kana, out, at = to_hiragana(text), [], 0
    while at < len(kana):
        c = kana[at]
        if c in "っん":
            following, _ = _syllable(kana, at + 1)
            if c == "っ":
                out.append("t" if following.startswith("ch") else following[:1])
            else:
                out.append("m" if following[:1] in ("b", "m", "p") else "n")
            at += 1
        elif c == "ー":
            at += 1
        else:
            found, size = _syllable(kana, at)
            out.append(found or c)
            at += size
    done = "".join(out)
    for long, short in (("ou", "o"), ("oo", "o"), ("uu", "u")):
        done = done.replace(long, short)
    return done[:1].upper() + done[1:] if capital else done


def hepburn(column: str | Column, capital: bool = False) -> Column:
    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: romaji(t, capital))

    return convert(column)


def nfkc(column: str | Column) -> Column:
    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).replace("ヶ", "ケ").replace("ヵ", "カ"))

    return convert(column)
