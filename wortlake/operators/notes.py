"""Notes from grouped entries: the fields of a card, and files a card application can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of content; audio, image and frequency are accepted in mappings and leave the field empty.
KINDS = ("term", "reading", "definition", "sentence", "audio", "image", "frequency")


def contents() -> dict[str, Column]:
    """What each kind is, from the columns headwords, definitions and sentence of a grouped entry."""
    texts = F.flatten(F.transform("definitions", lambda d: F.transform(F.filter(d["glossary"], lambda g: g["plain_text"].isNotNull()), lambda g: g["plain_text"])))
    return {
        "term": F.array_join(F.transform("headwords", lambda h: h["term"]), " "),
        "reading": F.array_join(F.transform("headwords", lambda h: h["reading"]), " "),
        "definition": F.array_join(texts, "<br>"),
        "sentence": F.col("sentence"),
    }


def notes(entries: DataFrame, mapping: dict[str, str], keys: list[str]) -> DataFrame:
    """One row per entry with a column for each mapped field: mapping is kind to field."""
    if unknown := set(mapping) - set(KINDS):
        raise ValueError(f"no such content: {sorted(unknown)}")
    known = contents()
    return entries.select(*keys, *(known.get(kind, F.lit("")).alias(name) for kind, name in mapping.items()))


def write_notes(rows: DataFrame, path: str, deck: str, model: str, fields: list[str]) -> None:
    """Writes JSON lines of notes (deckName, modelName, fields), ready to be posted to a card application."""
    rows.select(F.lit(deck).alias("deckName"), F.lit(model).alias("modelName"), F.struct(*fields).alias("fields")).write.mode("overwrite").json(path)
