"""Keyed lookups over the lexicon: the query primitives.

Disjunctions (expression or reading) are unions of equi-joins, never an OR join, which would be a nested
loop. Keys come as a DataFrame; Catalyst broadcasts them if their size allows, else both sides are shuffled
on the key and AQE splits hot keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("expression", "reading")


def _attributed(key: Column, kind: str) -> list[Column]:
    """match_source is term if the expression contains the key, else reading; an equal column makes the match exact."""
    source = F.when(F.contains(F.col("expression"), key), "term").otherwise("reading")
    column = F.when(F.contains(F.col("expression"), key), F.col("expression")).otherwise(F.col("reading"))
    return [source.alias("match_source"), F.when(column == key, "exact").otherwise(kind).alias("match_type")]


def _up_to(sizes: Sequence[int], length: Column) -> Column:
    return F.filter(F.array(*map(F.lit, sizes)), lambda n: n <= length)


def _first_match(hits: DataFrame, per: Sequence[str]) -> DataFrame:
    """One row per id (and per query): that of the first key; of rows imported again, the last one written."""
    order = Window.partitionBy(*per, "id").orderBy("key_ord", F.desc("import_ord"))
    return hits.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def bulk_lookup(lexicon: DataFrame, keys: DataFrame, *, per: Sequence[str] = (), kind: str = "exact") -> DataFrame:
    """Rows whose expression or reading equals a key (columns key, key_ord and `per`), each attributed to its first key.

    Null and empty keys match nothing. Equal keys count as their first. The columns of keys must not clash
    with those of the lexicon.
    """
    wanted = keys.where(F.col("key") != "").groupBy(*per, "key").agg(F.min("key_ord").alias("key_ord"))
    hits = [lexicon.join(wanted, F.col(f) == F.col("key")) for f in FIELDS]
    # A row whose expression and reading both match comes twice; the first match removes that as well.
    return _first_match(hits[0].unionByName(hits[1]), per).select("*", *_attributed(F.col("key"), kind))


def prefix_lookup(lexicon: DataFrame, keys: DataFrame, *, per: Sequence[str] = (), suffix: bool = False, lengths: Sequence[int] | None = None) -> DataFrame:
    """Rows whose expression or reading starts (ends, with suffix) with a key, each attributed to its first key.

    The values are cut to every key length that occurs and joined on equality: no row is compared with a key
    it does not start with. lengths: the key lengths, if known; else the distinct ones are asked for (they are
    bounded by the longest key).
    """
    wanted = keys.where(F.col("key") != "").groupBy(*per, "key").agg(F.min("key_ord").alias("key_ord"))
    sizes = sorted(lengths or [r[0] for r in wanted.select(F.length("key")).distinct().collect()])
    if not sizes:
        return bulk_lookup(lexicon, keys, per=per)
    cut = F.right if suffix else F.left
    hits = []
    for f in FIELDS:
        at = F.explode(_up_to(sizes, F.length(f)))
        hits.append(lexicon.withColumn("_n", at).withColumn("_cut", cut(F.col(f), F.col("_n"))).join(wanted, F.col("_cut") == F.col("key")).drop("_n", "_cut"))
    return _first_match(hits[0].unionByName(hits[1]), per).select("*", *_attributed(F.col("key"), "suffix" if suffix else "prefix"))


def pair_lookup(lexicon: DataFrame, pairs: DataFrame, dictionaries: DataFrame | None = None) -> DataFrame:
    """Rows equal to a request (req_ord, term, req_reading) in both columns; no dedup; enabled dictionaries only if given."""
    rows = lexicon if dictionaries is None else members(lexicon, dictionaries)
    return rows.join(pairs, (F.col("expression") == F.col("term")) & (F.col("reading") == F.col("req_reading")))


def sequence_lookup(lexicon: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of a requested (req_sequence, req_dictionary); not filtered by enabled dictionaries; match_source is sequence."""
    hit = (F.col("sequence") == F.col("req_sequence")) & (F.col("dictionary") == F.col("req_dictionary"))
    return lexicon.join(requests, hit).withColumn("match_source", F.lit("sequence"))


def meta_lookup(metas: DataFrame, keys: DataFrame, dictionaries: DataFrame | None = None) -> DataFrame:
    """Term metas of the keys (key, key_ord), of enabled dictionaries if given. key_ord is that of the whole request."""
    rows = metas if dictionaries is None else members(metas, dictionaries)
    return rows.join(keys, F.col("term") == F.col("key"))


def tag_lookup(tags: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (req_name, req_dictionary, and more columns) with its first tag row or nulls."""
    first = tags.groupBy("name", "dictionary").agg(F.min_by(F.struct("category", "tag_order", "notes", "score"), "import_ord").alias("_tag"))
    return requests.join(first, (F.col("req_name") == F.col("name")) & (F.col("req_dictionary") == F.col("dictionary")), "left").select(*requests.columns, "_tag.*")


def members(rows: DataFrame, dictionaries: DataFrame, column: str = "dictionary") -> DataFrame:
    """Rows of the dictionaries in the column `name` of the given table."""
    return rows.join(dictionaries.select(F.col("name").alias("_member")), F.col(column) == F.col("_member"), "left_semi")


def enabled_map(options: DataFrame) -> DataFrame:
    """Enabled dictionaries with dictionary_index, their rank among the enabled ones from 0. One row per dictionary: a small table."""
    rank = Window.partitionBy(F.lit(0)).orderBy("ord", "name")
    return options.where("enabled").withColumn("dictionary_index", F.row_number().over(rank) - 1)


def secondary(enabled: DataFrame) -> DataFrame:
    """The enabled dictionaries that allow secondary searches, with their index kept."""
    return enabled.where("allow_secondary_searches")


def with_dictionary(rows: DataFrame, enabled: DataFrame, column: str = "dictionary") -> DataFrame:
    """Adds alias (the name itself where missing or empty) and dictionary_index (the number of dictionaries where missing)."""
    total = enabled.agg(F.count("*")).first()[0]
    known = enabled.select(F.col("name").alias("_name"), F.col("alias").alias("_alias"), F.col("dictionary_index").alias("_index"))
    joined = rows.join(known, F.col(column) == F.col("_name"), "left")
    alias = F.coalesce(F.when(F.col("_alias") != "", F.col("_alias")), F.col(column))
    return joined.withColumn("alias", alias).withColumn("dictionary_index", F.coalesce("_index", F.lit(total))).drop("_name", "_alias", "_index")
