"""Several values packed in one field: split into one value per row, position kept.

Method: quoted spans are replaced by indexed placeholders, the rest is split at whatever is not part of a
value, the spans come back by array lookup, and the list is exploded with positions. All of it is built
from Catalyst expressions; no Python runs on the executors and nothing is shuffled.

The placeholder of span i is U+E000 i U+E001. Both code points are private-use and thus separators, so any
of them outside quotes is turned into a space first; a collision is impossible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds of quotes, opening and closing, that enclose a value.
CURLY_QUOTES = {"„": "“", "“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "‹": "›"}
STRAIGHT_QUOTES = ('"', "'")

_OPEN, _CLOSE = "\ue000", "\ue001"

#: Inside straight quotes a backslash escapes one character and a doubled quote stands for one.
QUOTED = "|".join(
    [rf"{q}(?:[^{q}\\]|\\[\s\S]|{q}{q})*{q}" for q in STRAIGHT_QUOTES]
    + [f"{a}[^{b}]*{b}" for a, b in CURLY_QUOTES.items()]
)
#: Characters of an unquoted value.
VALUE_CHARS = r"\p{L}\p{Nd}\-_.:+"


def _unquoted(span: Column) -> Column:
    """The content of a quoted span, escapes resolved (JSON escapes, or any escaped character)."""
    quote, inner = F.substring(span, 1, 1), F.substring(span, 2, F.length(span) - 2)
    straight = quote.isin(*STRAIGHT_QUOTES)
    parsed = F.from_json(
        F.concat(F.lit("["), span, F.lit("]")),
        "array<string>",
        {"allowBackslashEscapingAnyCharacter": "true", "allowUnquotedControlChars": "true"},
    )
    return (
        F.when(straight & F.contains(inner, F.lit("\\")), F.coalesce(F.try_element_at(parsed, F.lit(1)), F.regexp_replace(inner, r"\\([\s\S])", "$1")))
        .when(straight, F.replace(inner, F.concat(quote, quote), quote))
        .otherwise(inner)
    )


def unpack(field: Column | str) -> Column:
    """The values in a packed field, in order, as ARRAY<STRING>.

    Null gives an empty array, as do empty and blank fields. Empty values are left out, equal ones are kept.
    An opening quote that is never closed counts as a separator.
    """
    text = F.coalesce(F.col(field) if isinstance(field, str) else field, F.lit(""))
    plain = F.split(text, f"[^{VALUE_CHARS}]+")
    quoted = text.rlike("[\"'" + "".join(CURLY_QUOTES) + "]")
    return F.when(quoted, F.try_element_at(F.transform(_bound(text), _restored), F.lit(1))).otherwise(F.filter(plain, lambda v: v != ""))


def _bound(text: Column) -> Column:
    """One struct (text, spans) in an array: a lambda over it refers to spans instead of computing them per element."""
    return F.array(F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(0)).alias("spans")))


def _restored(let: Column) -> Column:
    spans = let["spans"]
    outside = F.transform(F.split(let["text"], QUOTED), lambda p: F.translate(p, _OPEN + _CLOSE, "  "))
    masked = F.array_join(
        F.transform(
            outside,
            lambda p, i: F.when(i < F.size(spans), F.concat(p, F.lit(f" {_OPEN}"), i.cast("string"), F.lit(f"{_CLOSE} "))).otherwise(p),
        ),
        "",
    )
    restored = F.transform(
        F.split(masked, f"[^{VALUE_CHARS}{_OPEN}{_CLOSE}]+"),
        lambda p: F.when(
            F.startswith(p, F.lit(_OPEN)), _unquoted(F.try_element_at(spans, F.translate(p, _OPEN + _CLOSE, "").cast("int") + 1))
        ).otherwise(p),
    )
    return F.filter(restored, lambda v: v.isNotNull() & (v != ""))


def unpacked_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str], *, at_least: int = 1) -> DataFrame:
    """One row per value of the given fields: the keys, fld, pos (from 1) and val.

    Fields with fewer than `at_least` values give no row. Repeated rows give their values again.
    Only the keys and the fields are read; a clash of other columns with fld, pos and val does not matter.
    """
    packed = F.explode(F.array(*(F.struct(F.lit(f).alias("fld"), unpack(f).alias("vals")) for f in fields)))
    rows = df.select(*keys, packed.alias("_packed")).where(F.size("_packed.vals") >= at_least)
    return rows.select(*keys, F.col("_packed.fld").alias("fld"), F.posexplode("_packed.vals").alias("_p", "val")).select(
        *keys, "fld", (F.col("_p") + 1).cast("int").alias("pos"), "val"
    )
