"""Entries from matches: construction, keep-longest dedup, and the merging of chains.

An entry is a row: query, the term's columns, a rank that keeps the order in which matches came, and
nested chains. Groups are made per query and id or headword, never over a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(matches: DataFrame) -> DataFrame:
    """Adds the entry's columns to matches (with original, deinflected, match_source, glossary...).

    The reading defaults to the term, a null or negative sequence becomes -1, lengths are in bytes, and exact_count
    is 1 where the term itself is the de-inflected text.
    """
    reading = F.coalesce(F.when(F.col("reading") != "", F.col("reading")), F.col("expression"))
    sequence = F.when(F.col("sequence") >= 0, F.col("sequence")).otherwise(F.lit(-1))
    return matches.withColumns(
        {
            "reading": reading,
            "sequence": F.coalesce(sequence, F.lit(-1)),
            "max_length": F.octet_length("original"),
            "exact_count": (F.col("expression") == F.col("deinflected")).cast("int"),
        }
    )


def keep_longest(matches: DataFrame, per: Sequence[str], of: str = "id") -> DataFrame:
    """Per query and id (or another column of) only the matches of the longest transformed text, in bytes; equal lengths are merged into one row.

    The merged row has inflections, an array of (source, rules) merged by `merge_inflections`' rule, the
    distinct text chains, and the greatest original length of all matches as longest_original. Columns that belong to the id are taken as any.
    """
    keys = [*per, of]
    # max_by over (length) alone would lose ties, so chains carry their length and the longest are kept after grouping.
    chain = F.struct(F.octet_length("transformed").alias("size"), F.col("source").alias("source"), F.array_sort("rules").alias("key"), F.col("rules").alias("rules"), F.col("text_chain").alias("text_chain"))
    rest = [c for c in matches.columns if c not in (*keys, "source", "rules", "text_chain", "transformed", "original", "deinflected")]
    grouped = matches.groupBy(*keys).agg(
        F.collect_set(chain).alias("_chains"),
        F.max_by(F.struct(*rest, "original", "deinflected"), F.struct(F.octet_length("transformed"), F.octet_length("original"), F.col("deinflected"))).alias("_row"),
        F.max(F.octet_length("original")).alias("longest_original"),
    )
    longest = F.array_max(F.transform("_chains", lambda c: c["size"]))
    kept = grouped.withColumn("_top", longest).withColumn("_chains", F.filter("_chains", lambda c: c["size"] == F.col("_top")))
    return kept.select(
        *keys,
        "_row.*",
        "longest_original",
        merged_inflections(F.col("_chains")).alias("inflections"),
        F.array_sort(F.array_distinct(F.transform("_chains", lambda c: F.array_sort(c["text_chain"])))).alias("text_chains"),
    )


def merged_inflections(chains: Column) -> Column:
    """Chains (source, key, rules) merged where their rules are equal in any order: differing sources become both."""
    keys = F.array_sort(F.array_distinct(F.transform(chains, lambda c: c["key"])))

    def merged(key: Column) -> Column:
        same = F.filter(chains, lambda c: c["key"] == key)
        sources = F.array_distinct(F.transform(same, lambda c: c["source"]))
        return F.struct(F.when(F.size(sources) > 1, "both").otherwise(F.element_at(sources, 1)).alias("source"), F.array_min(F.transform(same, lambda c: c["rules"])).alias("rules"))

    return F.transform(keys, merged)


def same_elements(a: Column, b: Column) -> Column:
    """Equality of arrays as multisets."""
    return F.array_sort(a) == F.array_sort(b)


def matched_length(matches: DataFrame, per: Sequence[str]) -> DataFrame:
    """Per query the greatest original length of its matches, in bytes."""
    return matches.groupBy(*per).agg(F.max(F.octet_length("original")).alias("matched_length"))


def shortest_chain(chains: Column) -> Column:
    """The least length in an array of arrays, 0 if it has none."""
    return F.coalesce(F.array_min(F.transform(chains, lambda c: F.size(c))), F.lit(0))
