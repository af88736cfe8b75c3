"""Text normalisation and rewriting as column builders: replacement groups, variants, chains, small helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Kana blocks that correspond code point by code point.
_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
#: Languages written without spaces.
UNSPACED = ("ja", "zh", "ko")
NUMBER = r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?"


@dataclass(frozen=True)
class Replacement:
    pattern: str
    replacement: str
    ignore_case: bool = False


@dataclass(frozen=True)
class Processor:
    """A text processor with its options: option name to column builder. The identity is always an option."""

    id: str
    options: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def base_language(lang: Column | str) -> Column:
    """The language without region or script, in lower case; null stays null."""
    return F.lower(F.element_at(F.split(F.trim(F.col(lang) if isinstance(lang, str) else lang), "[-_]"), 1))


# The tokens of a replacement template; the group is that of a name or of one or two digits.
_TOKEN = r"\$(?:\$|&|`|'|(\d{1,2})|<([^>]*)>)"


def java_pattern(item: Replacement) -> str:
    """The pattern in Java's form: named groups may be written (?P<name>...) as well."""
    return ("(?i)" if item.ignore_case else "") + item.pattern.replace("(?P<", "(?<")


@cache
def groups_of(pattern: str) -> tuple[int, frozenset[str]] | None:
    """The number of groups of a Java pattern and their names, None if it is no pattern. Asked of the JVM that will run it, while the plan is built."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("patterns are checked by the JVM of a running session")
    try:
        count = context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception:  # noqa: BLE001  PatternSyntaxException, as py4j hands it on
        return None
    return count, frozenset(re.findall(r"(?<!\\)\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern))


def reference(digits: str | None, name: str | None, count: int, names: frozenset[str]) -> str | None:
    """The group that a template's number or name refers to, None if there is no such group."""
    if name is not None:
        return name if name in names else None
    return str(int(digits)) if 1 <= int(digits) <= count else None


def has_context(template: str) -> bool:
    return any(m[0] in ("$`", "$'") for m in re.finditer(_TOKEN, template))


def java_template(template: str, count: int = 0, names: frozenset[str] = frozenset()) -> str:
    """A replacement template ($$, $&, $n, $nn, $<name>) in Java's form, for a pattern of `count` groups. Unknown references stay as they stand."""
    out, at = [], 0
    literal = lambda text: text.replace("\\", "\\\\").replace("$", "\\$")
    for m in re.finditer(_TOKEN, template):
        out.append(literal(template[at : m.start()]))
        token, at = m[0], m.end()
        if token == "$&":
            out.append("$0")
        elif token == "$$":
            out.append("\\$")
        elif (m[1] or m[2] is not None) and (found := reference(m[1], m[2], count, names)):
            # A digit that follows a number must not be read as part of it.
            follows = template[at : at + 1] if m[1] and template[at : at + 1].isdigit() else ""
            out.append((f"${{{found}}}" if m[1] is None else f"${found}") + ("\\" + follows if follows else ""))
            at += len(follows)
        else:
            out.append(literal(token))
    out.append(literal(template[at:]))
    return "".join(out)


def compile_groups(groups: Sequence[Sequence[Replacement]], *, search_original: bool = False) -> list[list[Replacement] | None]:
    """Replacement groups without invalid patterns and empty groups; None, no replacement, comes first if asked for or if any group is left."""
    valid = [kept for group in groups if (kept := [item for item in group if groups_of(java_pattern(item)) is not None])]
    return ([None] if search_original or valid else []) + valid


def replace_all(text: Column, group: Sequence[Replacement] | None) -> Column:
    """The group's replacements, one after the other, everywhere. Patterns are Java's; those whose template holds $` or $' run in `expand_context`."""
    for item in group or ():
        if has_context(item.replacement):
            text = expand_context(text, item.pattern, item.replacement, ignore_case=item.ignore_case)
        else:
            pattern = java_pattern(item)
            text = F.regexp_replace(text, pattern, java_template(item.replacement, *groups_of(pattern)))
    return text


def expand_context(text: Column | str, pattern: str, template: str, *, ignore_case: bool = False) -> Column:
    """Replacement with all template forms, the two of context as well ($` and $', the text before and after the match), which the JVM lacks: on Arrow batches."""
    compiled = regex.compile(java_pattern(Replacement(pattern, template, ignore_case)).replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!"))
    count, names = compiled.groups, frozenset(compiled.groupindex)

    def one(m) -> str:
        def token(t: re.Match) -> str:
            if t[0] in ("$$", "$&", "$`", "$'"):
                return {"$$": "$", "$&": m.group(), "$`": m.string[: m.start()], "$'": m.string[m.end() :]}[t[0]]
            found = reference(t[1], t[2], count, names)
            return t[0] if found is None else m.group(found if t[1] is None else int(found)) or ""

        return re.sub(_TOKEN, token, template)

    def expand(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else compiled.sub(one, v) for v in values.to_pylist()], pa.string())

    return arrow_udf(expand, "string")(F.col(text) if isinstance(text, str) else text)


def to_hiragana(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _HIRAGANA)


def decapitalize(text: Column) -> Column:
    return F.lower(text)


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000_000))


#: Processors before and after de-inflection, and reading normalisers, by language; "" holds for all others.
PREPROCESSORS: dict[str, tuple[Processor, ...]] = {
    "": (Processor("decapitalize", {"on": decapitalize}),),
    "ja": (Processor("katakana-to-hiragana", {"on": to_hiragana}),),
    "de": (Processor("decapitalize", {"on": decapitalize}), Processor("eszett", {"ss": lambda c: F.replace(c, F.lit("ß"), F.lit("ss"))})),
    "ru": (Processor("decapitalize", {"on": decapitalize}), Processor("yo-to-e", {"on": lambda c: F.translate(c, "ёЁ", "еЕ")})),
}
POSTPROCESSORS: dict[str, tuple[Processor, ...]] = {"": (), "de": (Processor("capitalize", {"on": capitalize}),)}
READING_NORMALIZERS: dict[str, Callable[[Column], Column]] = {"": lambda c: c, "ja": to_hiragana}


def per_language(lang: Column, table: dict, build: Callable, default: str = "") -> Column:
    """build(table[language]) chosen per row."""
    out = build(table[default])
    for language, value in table.items():
        if language != default:
            out = F.when(lang == language, build(value)).otherwise(out)
    return out


def normalize_reading(reading: Column, lang: Column | None = None, language: str = "") -> Column:
    if lang is None:
        return READING_NORMALIZERS.get(language, READING_NORMALIZERS[""])(reading)
    return per_language(lang, READING_NORMALIZERS, lambda f: f(reading))


def variants(df: DataFrame, text: str, groups: Sequence[Sequence[Replacement] | None], processors: Sequence[Processor], per: Sequence[str]) -> DataFrame:
    """Every variant of a text with the chains of steps that lead to it: (per, text, variant, chains).

    Replacement groups first, then each option of each processor; a step that changes nothing adds nothing
    to its chain, and chains that meet in one variant are merged. Null texts give no variant. Only the rows of
    one text meet in a group: their number is bounded by the options.
    """
    slots = list(groups) or [None]
    start = [F.struct(replace_all(F.col(text), g).alias("v"), F.lit(-1 if g is None else i).alias("g")) for i, g in enumerate(slots)]
    rows = df.where(F.col(text).isNotNull()).select(*per, text, F.explode(F.array(*start)).alias("_s"))
    changed = (F.col("_s.v") != F.col(text)) & (F.col("_s.g") >= 0)
    rows = rows.select(*per, text, F.col("_s.v").alias("variant"), F.when(changed, F.array(F.concat(F.lit("Text Replacement "), F.col("_s.g").cast("string")))).otherwise(F.array().cast("array<string>")).alias("chain"))
    for processor in processors:
        steps = F.array(F.struct(F.col("variant").alias("v"), F.col("chain").alias("c")), *(
            F.struct(f(F.col("variant")).alias("v"), F.when(f(F.col("variant")) == F.col("variant"), F.col("chain")).otherwise(F.concat("chain", F.array(F.lit(processor.id)))).alias("c"))
            for f in processor.options.values()
        ))
        rows = rows.select(*per, text, F.explode(F.array_distinct(steps)).alias("_s")).select(*per, text, F.col("_s.v").alias("variant"), F.col("_s.c").alias("chain"))
    return rows.groupBy(*per, text, "variant").agg(F.sort_array(F.collect_set("chain")).alias("chains"))


def cross_chains(pre: Column, post: Column) -> Column:
    """Every chain of pre followed by every chain of post."""
    return F.flatten(F.transform(pre, lambda p: F.transform(post, lambda q: F.concat(p, q))))


def split_list(text: Column | str) -> Column:
    """A space-separated list; null gives an empty array, empty parts are dropped."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def base_name(tag: Column) -> Column:
    """A tag's name up to its first colon."""
    return F.substring_index(tag, ":", 1)


def joined_terms(terms: Column | str) -> Column:
    return F.array_join(terms, " ")


def number_or_list(items: Column, single: Column) -> Column:
    """A field that is a number or a list, as a list."""
    return F.coalesce(items, F.when(single.isNotNull(), F.array(single)), F.array())


def composite_key(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def parsed_number(display: Column | str) -> Column:
    """The first number in a display value, null if there is none."""
    return F.regexp_extract(display, NUMBER, 0).try_cast("double")
