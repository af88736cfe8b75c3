"""Grouping modes (simple, group, merge, split): entries to groups, with their headwords and definitions as rows of their own, and tags."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlake.functions import textproc

MODES = ("simple", "group", "merge", "split")
#: The order of entries within a group: the longest source first, then by id.
ORDER = ("entry_ord", "id")


@dataclass(frozen=True)
class Groups:
    """Grouped entries as tables that meet on entry_key: numbers, headwords (headword_index from 0), definitions (index from 0, with the entry_id of their entry), term tags of headwords.

    Nothing is nested, so a group with a third of all rows is never one row or one task's list: its numbers are combined map-side, and its
    definitions are numbered by a window, which sorts on disk. `nested` makes whole entries of them.
    """

    entries: DataFrame
    headwords: DataFrame
    definitions: DataFrame
    term_tags: DataFrame
    several: bool = False
    alone: bool = False

    def nested(self, with_glossary: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The entries with arrays headwords and definitions, for groups whose definitions fit a row. with_glossary adds the glossaries to definitions."""
        heads = nest(self.headwords, "headwords", "headword_index", ("term", "reading", "primary_term", "sources"))
        defs = nest(with_glossary(self.definitions), "definitions", "index", DEFINITION)
        return self.entries.join(heads, "entry_key").join(defs, "entry_key")


#: The fields of a definition with its glossary; as rows they have import_ord and glossary_key for it, so that what is grouped and sorted stays narrow.
DEFINITION = ("id", "dictionary", "dictionary_index", "score", "is_primary", "glossary", "definition_tags", "sequences", "headword_indices")


def nest(rows: DataFrame, name: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(entry_key, name): the rows of each entry as an array of structs in order."""
    items = F.sort_array(F.collect_list(F.struct(order, F.struct(order, *fields).alias("_v"))))
    return rows.groupBy("entry_key").agg(F.transform(items, lambda x: x["_v"]).alias(name))


def with_key(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds entry_key, one string for the columns a group has in common (nulls are equal)."""
    return entries.withColumn("entry_key", F.to_json(F.struct(*by)))


def group_entries(entries: DataFrame, per: Sequence[str], *, several: bool = False, dedup: Column | None = None, summed: DataFrame | None = None, tag_names: DataFrame | None = None) -> Groups:
    """Entries grouped by entry_key.

    score is the greatest, dictionary_index the least, alias that of the last entry in order, is_primary whether any
    is; max_length, inflections and text_chains are the greatest and the shortest of the primary entries.
    several: whether a group can have several headwords (merge mode); they are merged by term and normalised reading, the first index
    wins. dedup: a condition for entries of whose groups definitions of one dictionary and glossary are merged: primary if any is, sequences, headwords and
    tags united. summed: the same entries with those that differ in nothing but their rows as one, for the numbers and headwords: id is their least, last_id their
    greatest with its alias, n how many they are. tag_names: their term tags (entry_key, dictionary, tag_name).
    """
    rows = entries.withColumn("_at", F.struct(*ORDER))
    totals = rows if summed is None else summed.withColumn("_at", F.struct(*ORDER))
    primary = F.col("is_primary")
    heads = totals.groupBy("entry_key", "expression", "norm_reading").agg(
        F.min("_at").alias("_first"),
        F.min_by("reading", "_at").alias("reading"),
        F.bool_or(primary & (F.col("match_source") == "term")).alias("primary_term"),
        F.sort_array(F.collect_set("match_source")).alias("sources"),
    )
    number = F.row_number().over(Window.partitionBy("entry_key").orderBy("_first", "expression", "norm_reading")) - 1 if several else F.lit(0)
    heads = heads.withColumn("headword_index", number).drop("_first")
    if several:
        known = heads.select(F.col("entry_key").alias("_k"), F.col("expression").alias("_e"), F.col("norm_reading").alias("_n"), "headword_index")
        placed = rows.join(known, (F.col("entry_key") == F.col("_k")) & F.col("expression").eqNullSafe(F.col("_e")) & F.col("norm_reading").eqNullSafe(F.col("_n"))).drop("_k", "_e", "_n")
    else:
        placed = rows.withColumn("headword_index", F.lit(0))
    definitions = placed.select(*per, "entry_key", "id", "dictionary", "dictionary_index", "score", "is_primary", "import_ord", *(c for c in ("glossary_key",) if c in rows.columns), "definition_tags", F.array("sequence").alias("sequences"), F.array("headword_index").alias("headword_indices"), "_at", *([dedup.alias("_merged")] if dedup is not None else []))
    if dedup is not None:
        definitions = _deduped(definitions, per)
    placing = Window.partitionBy("entry_key").orderBy("_at")
    definitions = definitions.withColumns({"index": F.row_number().over(placing) - 1, "entry_id": F.first("id").over(placing)}).drop("_at")
    first = F.min_by(F.struct("expression", "reading", "id"), "_at")
    numbers = totals.groupBy(*per, "entry_key").agg(
        *(F.first(c).alias(c) for c in ("expression", "norm_reading") if not several),
        first.alias("_f"),
        F.max("score").alias("score"),
        F.min("dictionary_index").alias("dictionary_index"),
        F.max_by("alias", "_at" if summed is None else F.struct("entry_ord", "last_id")).alias("alias"),
        F.bool_or("is_primary").alias("is_primary"),
        F.coalesce(F.max(F.when(primary, F.col("max_length"))), F.lit(0)).alias("max_length"),
        F.min_by("inflections", F.when(primary, F.struct(F.size("inflections"), "_at"))).alias("inflections"),
        F.min_by("text_chains", F.when(primary, F.struct(F.size("text_chains"), "_at"))).alias("text_chains"),
        F.bool_or("match_primary_reading").alias("match_primary_reading"),
        # The primary source: the source text of the first primary entry.
        F.min_by("original", F.when(primary, F.col("_at"))).alias("original"),
        *([F.max("longest_original").alias("longest_original")] if "longest_original" in rows.columns else []),
        *([] if several else [F.max((primary & (F.col("match_source") == "term")).cast("int")).alias("exact_count"), F.lit(1).alias("n_headwords")]),
        *([] if dedup is not None else [(F.count("*") if summed is None else F.sum("n")).alias("n_definitions")]),
    )
    numbers = numbers.select("*", F.col("_f.expression").alias("term"), F.col("_f.reading").alias("reading"), F.col("_f.id").alias("entry_id")).drop("_f")
    if several:
        numbers = numbers.join(heads.groupBy("entry_key").agg(F.count_if("primary_term").cast("int").alias("exact_count"), F.count("*").cast("int").alias("n_headwords")), "entry_key")
    if dedup is not None:
        numbers = numbers.join(definitions.groupBy("entry_key").agg(F.count("*").alias("n_definitions")), "entry_key")
    tags = placed.select("entry_key", "headword_index", "dictionary", F.explode("term_tags").alias("tag_name")) if tag_names is None else tag_names.withColumn("headword_index", F.lit(0))
    tags = tags.distinct()
    return Groups(numbers, heads.select("entry_key", "headword_index", F.col("expression").alias("term"), "norm_reading", "reading", "primary_term", "sources"), definitions, tags, several)


def alone(entries: DataFrame, per: Sequence[str]) -> Groups:
    """Each entry (with a unique entry_key) as a group of its own: what `group_entries` makes of them, row by row. The numbers have dictionary and term_tags as well."""
    is_term = F.col("match_source") == "term"
    numbers = entries.select(
        *per, "entry_key", "expression", "norm_reading", "score", "dictionary_index", "alias", "is_primary", "max_length", "inflections", "text_chains", "match_primary_reading", "original", "longest_original",
        is_term.cast("int").alias("exact_count"), F.lit(1).alias("n_headwords"), F.lit(1).cast("bigint").alias("n_definitions"), F.col("expression").alias("term"), "reading", F.col("id").alias("entry_id"), "dictionary", "term_tags",
    )
    heads = entries.select("entry_key", F.lit(0).alias("headword_index"), F.col("expression").alias("term"), "norm_reading", "reading", is_term.alias("primary_term"), F.array("match_source").alias("sources"))
    definitions = entries.select(
        *per, "entry_key", "id", "dictionary", "dictionary_index", "score", "is_primary", "import_ord", "definition_tags", F.array("sequence").alias("sequences"), F.array(F.lit(0)).alias("headword_indices"), F.lit(0).alias("index"), F.col("id").alias("entry_id")
    )
    tags = entries.select("entry_key", F.lit(0).alias("headword_index"), "dictionary", F.explode(F.array_distinct("term_tags")).alias("tag_name"))
    return Groups(numbers, heads, definitions, tags, alone=True)


def _deduped(rows: DataFrame, per: Sequence[str]) -> DataFrame:
    """Definitions with one dictionary and glossary merged where _merged holds; the others stay apart by their id."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    apart = F.when(~F.col("_merged"), F.col("id")).alias("_apart")
    merged = rows.groupBy(*per, "entry_key", "dictionary", "glossary_key", apart).agg(
        F.min_by(F.struct("id", "import_ord", "dictionary_index"), "_at").alias("_d"), F.max("score").alias("score"), F.bool_or("is_primary").alias("is_primary"), united("sequences"), united("headword_indices"), united("definition_tags"), F.min("_at").alias("_at")
    )
    return merged.select(*per, "entry_key", "_d.id", "dictionary", "_d.dictionary_index", "score", "is_primary", "_d.import_ord", "glossary_key", "definition_tags", "sequences", "headword_indices", "_at")


def by_headword(entries: DataFrame, per: Sequence[str]) -> DataFrame:
    """Group mode's entry_key: entries of one term, normalised reading and inflection chains; different chains stay apart."""
    return with_key(entries, [*per, "expression", "norm_reading", "inflections"])


def by_sequence(entries: DataFrame, lexicon: DataFrame, per: Sequence[str], main: str, secondary: DataFrame | None = None) -> DataFrame:
    """Merge mode: the rows of each merged entry, with `merge_key`.

    Entries of the main dictionary with a sequence make groups by it. Each group gets the related rows of that sequence
    and dictionary that it does not hold (not primary), then the ungrouped entries with one of its headwords, then the
    rows of secondary dictionaries with one of its headwords. The other entries are grouped by headword. The rows of entries and lexicon need
    no glossary.
    """
    related_key = F.concat(F.lit("seq:"), F.col("sequence").cast("string"))
    in_main = (F.col("dictionary") == main) & (F.col("sequence") >= 0)
    main_rows = entries.where(in_main).withColumn("merge_key", related_key)
    groups = main_rows.select(*per, "lang", "merge_key", "sequence").distinct()
    columns = main_rows.columns
    related = _as_secondary(lexicon.where(F.col("dictionary") == main).join(groups, "sequence"), columns)
    together = main_rows.unionByName(_absent(related, main_rows, [*per, "merge_key", "id"]))
    ungrouped = entries.where(~F.coalesce(in_main, F.lit(False)))
    ungrouped = _absent(ungrouped, together, [*per, "id"])
    heads = together.select(*per, "merge_key", "expression", "norm_reading").distinct()
    absorbed = ungrouped.join(heads, [*per, "expression", "norm_reading"]).select(*columns)
    left = _absent(ungrouped, absorbed, [*per, "id"]).withColumn("merge_key", F.concat(F.lit("head:"), F.to_json(F.struct("expression", "norm_reading", "inflections"))))
    merged = together.unionByName(absorbed)
    if secondary is not None:
        pairs = merged.select(*per, "lang", "merge_key", "expression", "reading").distinct()
        more = lexicon.join(secondary.select(F.col("name").alias("_second")), F.col("dictionary") == F.col("_second"), "left_semi")
        found = _as_secondary(more.join(pairs, ["expression", "reading"]), columns)
        merged = merged.unionByName(_absent(found, merged, [*per, "merge_key", "id"]))
    return merged.unionByName(left.select(*columns))


def _absent(rows: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(present.select(*keys).distinct(), list(keys), "left_anti")


def _as_secondary(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the lexicon as entries that are not primary."""
    reading = F.coalesce(F.nullif("reading", F.lit("")), F.col("expression"))
    given = {
        "reading": reading,
        "norm_reading": textproc.normalize_reading(reading, F.col("lang")),
        "sequence": F.when(F.col("sequence") >= 0, F.col("sequence")).otherwise(F.lit(-1)),
        "is_primary": F.lit(False),
        "match_source": F.lit("term"),
        "match_type": F.lit("exact"),
        "match_primary_reading": F.lit(False),
        "original": F.col("expression"),
        "deinflected": F.col("expression"),
        "max_length": F.lit(0),
        "longest_original": F.lit(0),
        "exact_count": F.lit(0),
        "key": F.col("expression"),
        "key_ord": F.lit(0),
        "entry_ord": F.lit(1 << 30),
        "inflections": F.array().cast("array<struct<source:string,rules:array<string>>>"),
        "text_chains": F.array().cast("array<array<string>>"),
    }
    return rows.select(*(F.col(c) if c in rows.columns and c not in given else given[c].alias(c) if c in given else F.lit(None).alias(c) for c in columns))


def merge_sources(sources: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Sources equal in all fields become one; it is primary if any of them is."""
    return sources.groupBy(*fields).agg(F.bool_or("is_primary").alias("is_primary"))


def merge_headwords(entries: DataFrame, per: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Headwords (per, term, norm_reading) with headword_index, by first appearance from 0, and their distinct sources."""
    first = entries.groupBy(*per, "expression", "norm_reading").agg(F.min(F.struct(*order)).alias("_first"), F.sort_array(F.collect_set("match_source")).alias("sources"))
    rank = Window.partitionBy(*per).orderBy("_first", "expression", "norm_reading")
    return first.withColumn("headword_index", F.row_number().over(rank) - 1).drop("_first")


def merge_similar_tags(tags: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Tags of one name and category become one: order the least, score the greatest, dictionaries and notes united."""
    return tags.groupBy(*per, "name", "category").agg(
        F.min("tag_order").alias("tag_order"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_set("dictionary")).alias("dictionaries"),
        F.sort_array(F.collect_set(F.when(F.col("notes") != "", F.col("notes")))).alias("content"),
    )


def ordered_tags(tags: Column) -> Column:
    """An array of tag structs by order, then name."""
    return F.array_sort(tags, lambda a, b: F.when(a["tag_order"] < b["tag_order"], -1).when(a["tag_order"] > b["tag_order"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))


def tag_groups(owners: DataFrame, owner: str, names: str) -> DataFrame:
    """The distinct tag names of each owner and dictionary: (owner, dictionary, names)."""
    return owners.select(owner, "dictionary", F.explode(names).alias("_n")).groupBy(owner, "dictionary").agg(F.sort_array(F.collect_set("_n")).alias("names"))


def tags_by_dictionary(tags: DataFrame) -> DataFrame:
    """(_dict, _known): the first tag written of each name, as a map per dictionary; for rows that have one dictionary each, see `tags_of`."""
    first = tags.groupBy("name", "dictionary").agg(F.min_by(F.struct("category", "tag_order"), "import_ord").alias("t")).where("name IS NOT NULL AND dictionary IS NOT NULL")
    return first.groupBy(F.col("dictionary").alias("_dict")).agg(F.map_from_entries(F.collect_list(F.struct("name", "t"))).alias("_known"))


def tags_of(names: Column) -> Column:
    """An array of tag names (of rows with _known) as an array of (tag_order, name, category), each once: what `expand_tags` and `merge_similar_tags` make of the tags of one dictionary."""

    def known(n: Column) -> Column:
        t = F.try_element_at("_known", F.substring_index(n, ":", 1))
        return F.struct(F.coalesce(t["tag_order"], F.lit(0)).cast("bigint").alias("tag_order"), n.alias("name"), F.coalesce(F.when(t["category"] != "", t["category"]), F.lit("default")).alias("category"))

    return F.transform(F.filter(F.array_distinct(names), lambda n: n != ""), known)


def expand_tags(names: DataFrame, tags: DataFrame, name: str = "tag_name", dictionary: str = "dictionary") -> DataFrame:
    """Tag names with their tag: looked up by base name and dictionary, the first row written; category default where there is none or it is empty."""
    first = tags.groupBy(F.col("name").alias("_base"), F.col("dictionary").alias("_dict")).agg(F.min_by(F.struct("category", "tag_order", "notes", "score"), "import_ord").alias("_t"))
    hit = (F.substring_index(F.col(name), ":", 1) == F.col("_base")) & (F.col(dictionary) == F.col("_dict"))
    return names.join(first, hit, "left").select(
        *names.columns,
        F.coalesce(F.when(F.col("_t.category") != "", F.col("_t.category")), F.lit("default")).alias("category"),
        F.coalesce("_t.tag_order", F.lit(0)).alias("tag_order"),
        F.coalesce("_t.score", F.lit(0)).alias("tag_score"),
        F.when(F.col("_t.notes") != "", F.array("_t.notes")).otherwise(F.array().cast("array<string>")).alias("content"),
    )
