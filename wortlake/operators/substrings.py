"""Row generators over query texts: start positions, shrinking substrings, windows, sentences. Positions count from 1."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlake.functions.textproc import UNSPACED, base_language

# Sentence ends, the scan length and the sentence radius.
TERMINATORS = ".!?。？！\\n"
SCAN_LENGTH, RADIUS = 20, 50
# Code points with the property White_Space, as a character class.
WHITE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Scripts that make a text Japanese or Chinese.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々〆〇・、。「」『』【】〜！？"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's argument is not inlined into each of its uses."""
    return F.element_at(F.transform(F.array(value), use), 1)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _starts(chars: Column, unspaced: Column) -> Column:
    def begins(p: Column) -> Column:
        return F.element_at(chars, p).rlike(f"[^{WHITE}]") & ((p == 1) | F.element_at(chars, F.greatest(p - 1, F.lit(1))).rlike(f"[{WHITE}]"))

    every = F.when(F.size(chars) > 0, F.sequence(F.lit(1), F.size(chars))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda p: unspaced | begins(p))


def is_unspaced(lang: Column | str) -> Column:
    return F.coalesce(base_language(lang).isin(*UNSPACED), F.lit(False))


def every_start(text: Column) -> Column:
    """All positions, for languages written without spaces. Null gives null, an empty text an empty array."""
    return bound(characters(text), lambda c: _starts(c, F.lit(True)))


def word_starts(text: Column) -> Column:
    """Positions of characters that are not white space and follow white space or begin the text."""
    return bound(characters(text), lambda c: _starts(c, F.lit(False)))


def suffixes(df: DataFrame, text: str, lang: str, per: Sequence[str], longest: int | Column) -> DataFrame:
    """(per, start, rest): up to `longest` characters from each start position, by the language's way of writing.

    Null and blank texts of spaced languages give no row. The characters are an array, read by index: a text of n
    characters costs n times the length, not n squared.
    """

    def rests(c: Column) -> Column:
        return F.transform(_starts(c["c"], c["u"]), lambda p: F.struct(p.alias("start"), F.array_join(F.slice(c["c"], p, c["n"]), "").alias("rest")))

    value = F.struct(characters(F.col(text)).alias("c"), is_unspaced(lang).alias("u"), (longest if isinstance(longest, Column) else F.lit(longest)).cast("int").alias("n"))
    return df.where(F.col(text).isNotNull()).select(*per, F.inline(bound(value, rests)))


def letter_substrings(text: Column, longest: int | None = None) -> Column:
    """The text, then without its last character, and so on down to one; `longest` leaves out those longer than any key."""
    top = F.length(text) if longest is None else F.least(F.length(text), F.lit(longest))
    return F.when(F.length(text) > 0, F.transform(F.sequence(top, F.lit(1), F.lit(-1)), lambda n: F.left(text, n))).otherwise(F.array().cast("array<string>"))


# Fixed value: where a text can be cut, at a character that is neither letter nor digit, with the word after it; the first character never starts one.
_TOKEN = r"(?s)(?:^.|[^\p{L}\p{N}])[\p{L}\p{N}]*"


def word_substrings(text: Column) -> Column:
    """The text, then cut before its last word again and again, while it has one.

    A word goes from a character that is no letter over letters and digits to the end. So the cuts are before the characters that are
    neither, and in a first word of letters before its first digit.
    """

    def prefixes(tokens: Column) -> Column:
        cut = F.transform(F.sequence(F.size(tokens), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(tokens, 1, n), ""))
        letters = F.regexp_extract(F.element_at(tokens, 1), r"^\p{L}+(?=\p{N})", 0)
        return F.when(letters != "", F.concat(cut, F.array(letters))).otherwise(cut)

    return F.when(F.length(text) > 0, bound(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), prefixes)).otherwise(F.array().cast("array<string>"))


def cjk_prefix(text: Column | str) -> Column:
    """The text up to its first character that is neither Japanese nor Chinese."""
    return F.regexp_extract(text, f"^[{CJK}]*", 0)


def window(text: Column, start: Column, length: int = SCAN_LENGTH) -> Column:
    """The scan window: `length` characters from a position; empty beyond the text."""
    return F.when((start >= 1) & (start <= F.length(text)), F.substring(text, start, F.lit(length))).otherwise("")


def sentence_around(text: Column, start: Column, size: Column, radius: int = RADIUS) -> Column:
    """STRUCT(text, offset): the sentence around an anchor, within the radius, trimmed; offset of the anchor from 0.

    It runs from after the nearest sentence end before the anchor to the nearest one after it, that included, or
    to the edge of the window.
    """
    first = F.greatest(start - radius, F.lit(1))
    left = F.regexp_extract(F.substring(text, first, start - first), rf"[^{TERMINATORS}]*\z", 0)
    right = F.regexp_extract(F.substring(text, start + size, F.lit(radius)), f"^[^{TERMINATORS}]*[{TERMINATORS}]?", 0)
    whole = F.concat(left, F.substring(text, start, size), right)
    trimmed = F.regexp_replace(whole, r"^\s+|\s+$", "")
    lost = F.length(left) - F.length(F.regexp_replace(left, r"^\s+", ""))
    return F.struct(trimmed.alias("text"), (F.length(left) - lost).alias("offset"))
