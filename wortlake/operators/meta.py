"""Frequencies and pronunciations attached to headwords by equi-joins on the term, with the reading as a residual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX = 9223372036854775807


def _metas(metas: DataFrame, mode: str, only_dictionary: str | None) -> DataFrame:
    rows = metas.where(F.col("mode") == mode)
    if only_dictionary is not None:
        rows = rows.where(F.col("dictionary") == only_dictionary)
    return rows.select(F.col("id").alias("meta_id"), F.col("term").alias("_term"), F.col("dictionary").alias("meta_dictionary"), F.col(mode).alias("_m"))


def frequencies_of(metas: DataFrame, only_dictionary: str | None = None) -> DataFrame:
    """Frequencies by term, before any headword is looked at: (_term, for_reading, meta_id, meta_dictionary and what they say). for_reading is null where any reading will do."""
    return _metas(metas, "freq", only_dictionary).select("_term", F.col("_m.reading").alias("for_reading"), "meta_id", "meta_dictionary", F.col("_m.reading").isNotNull().alias("has_reading"), F.col("_m.value").alias("frequency"), "_m.display_value", "_m.display_value_parsed")


def pitches_of(metas: DataFrame) -> DataFrame:
    """Pitch accents by term and reading (see `frequencies_of`), one row each; empty lists give none, missing nasal and devoice lists are empty."""
    rows = _metas(metas, "pitch", None).where(F.col("_m.reading").isNotNull()).select("_term", F.col("_m.reading").alias("for_reading"), "meta_id", "meta_dictionary", F.posexplode("_m.pitches").alias("_i", "_p"))
    empty = F.array().cast("array<smallint>")
    return rows.select("_term", "for_reading", "meta_id", "meta_dictionary", F.col("_i").alias("index"), "_p.position", F.coalesce("_p.nasal", empty).alias("nasal"), F.coalesce("_p.devoice", empty).alias("devoice"), F.coalesce("_p.tags", F.array().cast("array<string>")).alias("tags"))


def transcriptions_of(metas: DataFrame) -> DataFrame:
    """Phonetic transcriptions by term and reading (see `frequencies_of`), one row each."""
    rows = _metas(metas, "ipa", None).where(F.col("_m.reading").isNotNull()).select("_term", F.col("_m.reading").alias("for_reading"), "meta_id", "meta_dictionary", F.posexplode("_m.transcriptions").alias("_i", "_p"))
    return rows.select("_term", "for_reading", "meta_id", "meta_dictionary", F.col("_i").alias("index"), "_p.ipa", F.coalesce("_p.tags", F.array().cast("array<string>")).alias("tags"))


def of_headwords(headwords: DataFrame, said: DataFrame) -> DataFrame:
    """Headwords (columns term, reading and more) with what is said of their term and, where a reading is named, of that reading."""
    joined = headwords.join(said, F.col("term") == F.col("_term"))
    return joined.where(F.col("for_reading").isNull() | (F.col("for_reading") == F.col("reading"))).drop("_term", "for_reading")


def frequencies(headwords: DataFrame, metas: DataFrame, only_dictionary: str | None = None) -> DataFrame:
    """Frequencies of headwords (columns term, reading and more): those of the term, and if they name a reading, of that reading.

    only_dictionary restricts them to the sort dictionary, as simple mode does. Null readings match only metas without reading.
    """
    return of_headwords(headwords, frequencies_of(metas, only_dictionary))


def pitches(headwords: DataFrame, metas: DataFrame) -> DataFrame:
    """Pitch accents, one row each: the reading must be equal; empty lists give none; missing nasal and devoice lists are empty."""
    return of_headwords(headwords, pitches_of(metas))


def transcriptions(headwords: DataFrame, metas: DataFrame) -> DataFrame:
    """Phonetic transcriptions, one row each; the reading must be equal."""
    return of_headwords(headwords, transcriptions_of(metas))


def listed(headwords: DataFrame, said: DataFrame, order: Sequence[str], item: Column, name: str) -> DataFrame:
    """(term, reading, name): for headwords (term, reading), which should be distinct, what is said of them in order as one text.

    The rows of a term are gathered once, and each of its readings takes its own from them: no row is made for each pair of a reading and a meta.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.struct("for_reading", item.alias("v")).alias("_v"))))
    terms = said.groupBy("_term").agg(F.transform(rows, lambda x: x["_v"]).alias("_all"))
    own = F.filter("_all", lambda x: x["for_reading"].isNull() | (x["for_reading"] == F.col("reading")))
    joined = headwords.join(terms, F.col("term") == F.col("_term")).withColumn("_own", own).where(F.size("_own") > 0)
    return joined.select("term", "reading", F.array_join(F.transform("_own", lambda x: x["v"]), "|").alias(name))


def least_frequency(headwords: DataFrame, freqs: DataFrame, dictionary: str, *, ascending: bool = True) -> DataFrame:
    """Headwords (term, reading and more) with frequency_order (see `frequency_order`), null where there is none. Frequencies are summed up by term and reading before they meet a headword."""
    value = F.min("frequency") if ascending else -F.max("frequency")
    own = freqs.where(F.col("meta_dictionary") == dictionary).groupBy("_term", "for_reading").agg(value.alias("_f"))
    every = own.where("for_reading IS NULL").select(F.col("_term").alias("_t1"), F.col("_f").alias("_f1"))
    named = own.where("for_reading IS NOT NULL").select(F.col("_term").alias("_t2"), "for_reading", F.col("_f").alias("_f2"))
    joined = headwords.join(every, F.col("term") == F.col("_t1"), "left").join(named, (F.col("term") == F.col("_t2")) & (F.col("reading") == F.col("for_reading")), "left")
    return joined.withColumn("frequency_order", F.least("_f1", "_f2")).drop("_t1", "_t2", "_f1", "_f2", "for_reading")


def frequency_order(entries: DataFrame, freqs: DataFrame, keys: list[str], dictionary: str, *, ascending: bool = True) -> DataFrame:
    """Adds frequency_order from one dictionary's frequencies: the least, or minus the greatest; entries without come last (MAX or 0)."""
    value = F.min("frequency") if ascending else -F.max("frequency")
    sort = freqs.where(F.col("meta_dictionary") == dictionary).groupBy(*keys).agg(value.alias("_f"))
    return entries.join(sort, keys, "left").withColumn("frequency_order", F.coalesce("_f", F.lit(MAX if ascending else 0))).drop("_f")


def frequency_value(frequencies: Column, dictionary: str, *, ascending: bool = True) -> Column:
    """frequency_order of an array of frequencies of one entry or definition, as `frequency_order` has it of rows."""
    values = F.transform(F.filter(frequencies, lambda f: f["meta_dictionary"] == dictionary), lambda f: f["frequency"])
    return F.coalesce(F.array_min(values), F.lit(MAX)) if ascending else F.coalesce(-F.array_max(values), F.lit(0))


def number_of(value: Column, parsed: Column) -> Column:
    """A frequency's number where it was parsed, else null."""
    return F.when(parsed, value)
