"""Visually identical text with different characters, brought to one consistent form.

Method: every value is mapped character by character to a prototype of its look, the mapped values are
grouped in SQL under Spark's UNICODE collation (sensitive to case and accents; composed and decomposed
forms and ignorable code points are equal there), one canonical member is chosen per class by a fixed
rule, and the class is joined back to the values.

The mapping is one `translate` and a few `replace` expressions, all in the JVM.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLLATION = "UNICODE"

# Letters of other scripts with the shape of a Latin letter, prototype: letters.
SAME_SHAPE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іɩι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛզ",
    "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝѡ", "x": "хχ", "y": "уγү", "ß": "βϐ",
}
# The same for Cherokee, Coptic, Lisu and small capitals (drawn like the small letter of their shape).
SAME_SHAPE_MORE = {
    "A": "ᎪⲀꓮ", "B": "ᏴⲂꓐ", "C": "ᏟⲤꓚ", "D": "Ꭰꓓ", "E": "Ꭼꓰ", "F": "ꓝ", "G": "Ꮐꓖ", "H": "ᎻⲎꓧ", "I": "Ⲓꓲ", "J": "Ꭻꓙ", "K": "ᏦⲔꓗ", "L": "ᏞꓡⳐ", "M": "ᎷⲘꓟ", "N": "Ⲛꓠ", "O": "Ⲟꓳ", "P": "ᏢⲢꓑ",
    "R": "Ꮢꓣ", "S": "Ꮪꓢ", "T": "ᎢⲦꓔ", "U": "ꓴ", "V": "Ꮩꓦ", "W": "Ꮃꓪ", "X": "Ⲭꓫ", "Y": "Ⲩꓬ", "Z": "Ꮓꓜ", "c": "ᴄⲥ", "o": "ᴏⲟ", "p": "ⲣ", "s": "ꜱ", "u": "ᴜ", "v": "ᴠ", "w": "ᴡ", "x": "ⲭ", "z": "ᴢ", "i": "Ꭵ",
}
# Kana and ideographs of one shape, prototype: the others.
SAME_SHAPE_CJK = {"ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "ー": "一", "ニ": "二", "ハ": "八", "タ": "夕", "ロ": "口囗", "カ": "力", "ト": "卜", "エ": "工", "ノ": "丿", "ム": "厶"}
#: Compatibility forms that are drawn like their decomposition; the other kinds (circled, raised...) look different.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_HYPHENS = "‐‑‒–—―−﹘﹣－⁃˗╴"
_MORE_SPACES = "\t\n\v\f\r\x85  "


def _invisible(char: str) -> bool:
    point = ord(char)
    return (
        unicodedata.category(char) in ("Cf", "Cc")
        or point in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0xFE00 <= point <= 0xFE0F
        or 0x180B <= point <= 0x180F
        or 0xE0100 <= point <= 0xE01EF
    )


@cache
def look_table() -> dict[str, str]:
    """Character to prototype, for all that change; made from Unicode's properties and the fixed values above."""
    shapes = {c: p for table in (SAME_SHAPE, SAME_SHAPE_MORE, SAME_SHAPE_CJK) for p, chars in table.items() for c in chars}
    table: dict[str, str] = {}
    for char in map(chr, [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]):
        kind, _, parts = unicodedata.decomposition(char).rpartition(">")
        if char in _MORE_SPACES or unicodedata.category(char) == "Zs":
            table[char] = " "
        elif char in _HYPHENS:
            table[char] = "-"
        elif _invisible(char):
            table[char] = ""
        else:
            seen = char
            if kind and kind + ">" in _SAME_LOOK and not parts.strip().startswith("0020"):
                seen = unicodedata.normalize("NFKD", char)
            elif 0x2E80 <= ord(char) and not kind and parts:
                seen = unicodedata.normalize("NFC", char)
            mapped = "".join(shapes.get(c, c) for c in (unicodedata.normalize("NFD", seen) if any(c in shapes for c in unicodedata.normalize("NFD", seen)) else seen))
            mapped = shapes.get(char) or unicodedata.normalize("NFC", mapped)
            if mapped != unicodedata.normalize("NFC", char):
                table[char] = mapped
    return table


def prototype(value: Column | str) -> Column:
    """The value with each character replaced by the prototype of its look, without spaces at either end.

    Null stays null; a value of invisible characters only becomes empty. Compare the result under COLLATION.
    """
    table = look_table()
    text = F.col(value) if isinstance(value, str) else value
    # Characters that stand for several (ligatures, signs like the one for number, composed Greek) are rare: only texts that hold one are spelled out character by character.
    several = {c: p for c, p in table.items() if len(p) > 1}
    spelling = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # one literal, folded to a map
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(spelling, c), c)), "")
    single = [(c, p) for c, p in table.items() if len(p) == 1]
    gone = [c for c, p in table.items() if not p]
    # What a ligature stands for may have a look of its own, so it is spelled out first.
    # translate looks characters up in a hash table; a pattern of all of them would try them one by one.
    out = F.when(F.translate(text, "".join(several), "") != text, spelled).otherwise(text)
    return F.trim(F.translate(out, "".join(c for c, _ in single) + "".join(gone), "".join(p for _, p in single)))


def with_prototype(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.collate(prototype(value), COLLATION))


def canonical_classes(spellings: DataFrame, by: Sequence[str], value: str, preferred: Sequence[str] = ()) -> DataFrame:
    """One row per class of spellings that look the same: by, `look` (collated) and `canonical`.

    The canonical member is the least by the preferred columns (nulls last), then the one most frequent
    among the rows, then the least in code points. Null values and values that look empty are left out.
    Equal spellings are counted first, map-side, so a hot spelling or class is never held in one task.
    """
    order = [F.coalesce(F.col(p).isNull(), F.lit(True)).alias(f"_n{i}") for i, p in enumerate(preferred)] + [F.col(p).alias(f"_p{i}") for i, p in enumerate(preferred)]
    counted = spellings.groupBy(*by, value, *preferred).agg(F.count("*").alias("_count"))
    looked = with_prototype(counted.where(F.col(value).isNotNull()), value, "look").where(F.length("look") > 0)
    key = F.struct(*order, (-F.col("_count")).alias("_c"), F.col(value).alias("_v"))
    return looked.groupBy(*by, "look").agg(F.min(F.struct(key.alias("_key"), F.col(value).alias("canonical"), *(F.col(p) for p in preferred))).alias("_best")).select(
        *by, "look", "_best.canonical", *(F.col(f"_best.{p}") for p in preferred)
    )


def canonical_spellings(spellings: DataFrame, by: Sequence[str], value: str, preferred: Sequence[str] = ()) -> DataFrame:
    """Each distinct (by, value) with the `canonical` spelling of its class; null and empty-looking values keep theirs."""
    classes = canonical_classes(spellings, by, value, preferred).withColumnsRenamed({b: f"_{b}" for b in by} | {p: f"_{p}" for p in preferred})
    distinct = with_prototype(spellings.select(*by, value).distinct(), value, "_look")
    joined = distinct.join(classes, [F.col(b) == F.col(f"_{b}") for b in by] + [F.col("_look") == F.col("look")], "left")
    return joined.select(*by, value, F.coalesce("canonical", value).alias("canonical"))
