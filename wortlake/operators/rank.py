"""Orders: entries by ten keys, definitions, metas, and the plain ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlake.operators.entries import shortest_chain


def entry_order() -> list[Column]:
    """The keys of an entry row; terms by length in bytes, the longer first, then by code points; the id makes it total."""
    return [
        F.desc("match_primary_reading"),
        F.desc("max_length"),
        F.asc("text_chain_size"),
        F.asc("inflection_size"),
        F.desc("exact_count"),
        F.asc("frequency_order"),
        F.asc("dictionary_index"),
        F.desc("score"),
        F.desc(F.octet_length("term")),
        F.asc("term"),
        F.desc("n_definitions"),
        F.asc("entry_id"),
    ]


def chain_sizes(entries: DataFrame) -> DataFrame:
    """Adds text_chain_size and inflection_size, the lengths of the shortest chains."""
    rules = F.transform("inflections", lambda i: i["rules"])
    return entries.withColumn("text_chain_size", shortest_chain(F.col("text_chains"))).withColumn("inflection_size", shortest_chain(rules))


def rank_entries(entries: DataFrame, per: Sequence[str]) -> DataFrame:
    """Adds entry_rank from 1 per query. Ranking needs only a query's own entries together. An entry that stands in several groups is ordered by their entry_key."""
    last = ["entry_key"] if "entry_key" in entries.columns else []
    return entries.withColumn("entry_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*entry_order(), *last)))


def sort_headwords(headwords: Column) -> Column:
    """Headword structs (term...) pairwise: the longer term in bytes first, then by code points."""

    def compare(a: Column, b: Column) -> Column:
        x, y = F.octet_length(a["term"]), F.octet_length(b["term"])
        return F.when(x > y, -1).when(x < y, 1).when(a["term"] < b["term"], -1).when(a["term"] > b["term"], 1).otherwise(0)

    return F.array_sort(headwords, compare)


def number_definitions(definitions: DataFrame, per: Sequence[str]) -> DataFrame:
    """Adds pos from 1: definitions by frequency_order, dictionary index, score (descending), number of headword indices (descending), those indices, index."""
    keys = ["frequency_order"] if "frequency_order" in definitions.columns else []
    order = Window.partitionBy(*per).orderBy(*keys, "dictionary_index", F.desc("score"), F.desc(F.size("headword_indices")), "headword_indices", "index")
    return definitions.withColumn("pos", F.row_number().over(order))


def meta_order(metas: DataFrame, per: Sequence[str]) -> DataFrame:
    """Adds meta_rank from 1: by headword index, dictionary index, index."""
    return metas.withColumn("meta_rank", F.row_number().over(Window.partitionBy(*per).orderBy("headword_index", "dictionary_index", "index", "meta_id")))


def by_definition_id(entries: DataFrame) -> DataFrame:
    return entries.orderBy("id")


def by_request(rows: DataFrame) -> DataFrame:
    return rows.orderBy("req_ord", "import_ord")


def by_length(keys: DataFrame, key: str = "key") -> DataFrame:
    """Keys by length in bytes, the longest first."""
    return keys.orderBy(F.desc(F.octet_length(key)), key)
