"""The lookup pipeline: query texts to candidates, matches, entries, groups, enrichment, order, segments.

One lazily built plan serves all query texts at once. A query is a row (query_id, text, lang); what the steps
group and rank never spans more than one query. Up to the groups the rows are narrow: keys, flags and numbers. Glossaries and tags are
read for the rows that were found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wortlake.functions import textproc
from wortlake.operators import deinflect, entries, filters, lookup, meta, modes, packed, rank, segment, substrings
from wortlake.options import EngineError, LookupOptions
from wortlake.sources.store import last_written
from wortlake.sources.tables import table

LANGUAGES = sorted({*textproc.PREPROCESSORS, *(r[1] for r in deinflect.RULES)} - {""})


@dataclass(frozen=True)
class Lexicon:
    """The tables of a lexicon. terms may hold several versions of an id; the one with the greatest import_ord, which must be unique, is the live one.

    With `current`, terms has one row per id already, as the tables of a store have, and no version is looked for. Without a column
    import_ord terms must be current.
    """

    terms: DataFrame
    metas: DataFrame
    tags: DataFrame
    options: DataFrame
    current: bool = False

    @classmethod
    def of(cls, spark: SparkSession, root: str, *, current: bool = False) -> Lexicon:
        metas = table(spark, root, "term_meta")
        return cls(table(spark, root, "terms"), last_written(metas, ["id"], ["term", "mode", "dictionary"]), table(spark, root, "tags"), table(spark, root, "dictionary_options"), current)

    @property
    def enabled(self) -> DataFrame:
        return lookup.enabled_map(self.options)

    @property
    def ordered(self) -> DataFrame:
        return self.terms if "import_ord" in self.terms.columns else self.terms.withColumn("import_ord", F.lit(0).cast("bigint"))

    @property
    def live(self) -> DataFrame:
        """The live rows without their wide columns: (id, import_ord, expression, reading, sequence, dictionary, rules, has_content, forms, score, definition_tags and term_tags as they are packed).

        Of the glossary only kinds and forms are read, so the scan prunes its texts.
        """
        kinds = F.col("glossary.kind")
        rows = self.ordered.select(
            "id", "import_ord", "expression", "reading", "sequence", "dictionary", "rules", F.coalesce(F.array_contains(kinds, "Content"), F.lit(False)).alias("has_content"),
            F.when(F.array_contains(kinds, "Deinflection"), F.arrays_zip(kinds, F.col("glossary.form_of"), F.col("glossary.rules")).cast(deinflect.FORMS)).alias("forms"),
            F.coalesce("score", F.lit(0)).alias("score"), "definition_tags", "term_tags",
        )
        return rows if self.current or "import_ord" not in self.terms.columns else last_written(rows, ["id"], ["import_ord"])

    def with_options(self) -> DataFrame:
        """The live rows of enabled dictionaries, with what their options say."""
        enabled = self.enabled.select(F.col("name").alias("dictionary"), "alias", "dictionary_index", "parts_of_speech_filter", "use_deinflections")
        return self.live.drop("score", "definition_tags", "term_tags").join(enabled, "dictionary")

    def members(self, *, tagged: bool) -> DataFrame:
        """What distinguishes the live rows with content of one kind (see `index`); tagged: with score and unpacked tags."""
        more = [F.col("score"), packed.unpack("definition_tags").alias("definition_tags"), packed.unpack("term_tags").alias("term_tags")] if tagged else []
        sequence = F.coalesce(F.when(F.col("sequence") >= 0, F.col("sequence")), F.lit(-1))
        enabled = self.enabled.select(F.col("name").alias("dictionary"), "alias", "dictionary_index", "parts_of_speech_filter")
        rows = _flagged(self.live.where("has_content").join(enabled, "dictionary"))
        return rows.select(F.struct(*KIND).alias("kind"), "id", "import_ord", "dictionary", "dictionary_index", F.coalesce(F.nullif("alias", F.lit("")), F.col("dictionary")).alias("alias"), sequence.alias("sequence"), *more)

    def fetched(self, rows: DataFrame) -> DataFrame:
        """Rows (with id and import_ord) with score, unpacked tags, and glossary_key, which is equal for glossaries of equal content (see `with_glossary`)."""
        key = F.sha2(F.to_json(deinflect.is_content(F.col("glossary"))), 256)
        wide = self.ordered.select("id", "import_ord", F.coalesce("score", F.lit(0)).alias("score"), F.col("definition_tags").alias("_d"), F.col("term_tags").alias("_t"), key.alias("glossary_key"))
        joined = rows.join(wide, ["id", "import_ord"])
        # Unpacked after the join, so that only rows that were found are.
        return joined.withColumns({"definition_tags": packed.unpack("_d"), "term_tags": packed.unpack("_t")}).drop("_d", "_t")

    def with_glossary(self, definitions: DataFrame) -> DataFrame:
        """Definitions with the content of their glossary, read for them alone."""
        return definitions.join(self.ordered.select("id", "import_ord", deinflect.is_content(F.col("glossary")).alias("glossary")), ["id", "import_ord"])


def pieces(queries: DataFrame, options: LookupOptions, *, longest: int | None = None) -> DataFrame:
    """(query_id, lang, original): the substrings of each text by the language's way of writing (or options.search_resolution letter), of what can become
    a key of `longest` characters (null: of the whole text)."""
    if options.match_type != "exact":
        raise EngineError(f"the pipeline looks up whole keys only, not by {options.match_type}: see lookup.prefix_lookup")
    texts = queries.select("query_id", textproc.base_language("lang").alias("lang"), F.col("text"))
    if options.remove_non_japanese:
        texts = texts.withColumn("text", F.when(F.col("lang").isin("ja", "zh", "yue"), substrings.cjk_prefix("text")).otherwise(F.col("text")))
    letters = by_letters(F.col("lang"), options)
    reach = F.col("text") if longest is None else within(F.col("text"), F.lit(longest), letters)
    cut = F.when(letters, substrings.letter_substrings(reach)).otherwise(substrings.word_substrings(reach))
    return texts.where("text <> ''").select("query_id", "lang", F.explode(cut).alias("original"))


def expanded(rows: DataFrame, options: LookupOptions) -> DataFrame:
    """Substrings (lang, original and more) as candidates: with replacements and processors, de-inflected, with the processors after it.

    Adds transformed, deinflected, conditions, rules, text_chain and source.
    """
    empty = F.array().cast("array<string>")
    given = [c for c in rows.columns]
    rows = rows.withColumn("_t", F.explode(_variants(F.col("original"), F.col("lang"), options)))
    rows = rows.select(*given, F.col("_t.v").alias("transformed"), F.col("_t.v").alias("deinflected"), F.lit(0).cast("bigint").alias("conditions"), empty.alias("rules"), F.col("_t.c").alias("text_chain"), F.lit("algorithm").alias("source"))
    if options.deinflect:
        rows = deinflect.deinflections(rows, "lang")
        post = textproc.per_language(F.col("lang"), textproc.POSTPROCESSORS, lambda ps: _steps(F.col("deinflected"), ps))
        rows = rows.withColumn("_p", F.explode(post)).withColumn("deinflected", F.col("_p.v")).withColumn("text_chain", F.concat("text_chain", "_p.c")).drop("_p")
    return rows.where("deinflected <> ''")


def candidates(queries: DataFrame, options: LookupOptions, *, longest: int | None = None) -> DataFrame:
    """(query_id, lang, original, transformed, deinflected, conditions, rules, text_chain, source), distinct per query: `pieces`, `expanded`."""
    return expanded(pieces(queries, options, longest=longest), options)


def _steps(text, processors):
    """Every way through the processors as an array of (v, c): at most two per option, unrolled."""
    out = [(text, F.array().cast("array<string>"))]
    for p in processors:
        out += [(f(v), F.when(f(v) == v, c).otherwise(F.concat(c, F.array(F.lit(p.id))))) for v, c in list(out) for f in p.options.values()]
    return F.array_distinct(F.array(*(F.struct(v.alias("v"), c.alias("c")) for v, c in out)))


def _labelled(steps, label: str):
    return F.transform(steps, lambda s: F.struct(s["v"].alias("v"), F.concat(F.array(F.lit(label)), s["c"]).alias("c")))


def _variants(text, lang, options: LookupOptions):
    groups = textproc.compile_groups([[textproc.Replacement(*r) for r in g] for g in options.text_replacements])
    starts = [textproc.replace_all(text, g) for g in groups] or [text]
    per = [textproc.per_language(lang, textproc.PREPROCESSORS, lambda ps, t=t: _steps(t, ps)) for t in starts]
    labelled = [per[0]] + [_labelled(p, f"Text Replacement {i}") for i, p in enumerate(per[1:])]
    return F.array_distinct(F.concat(*labelled)) if len(labelled) > 1 else labelled[0]


#: What candidates can tell live rows apart by: rows of one kind are found by the same candidates, in the same way.
KIND = ("expression", "reading", "flags", "parts_of_speech_filter")


def _flagged(live: DataFrame) -> DataFrame:
    return live.withColumn("flags", deinflect.rule_flags(packed.unpack("rules"))).drop("rules")


def index(live: DataFrame) -> DataFrame:
    """The kinds of live rows that have content to show by lookup key, with their dictionary's options, dictionary hops resolved.

    A headword with a tenth of all rows is a few kinds, and "form of" leads from many keys to it: rows are matched by their kind, and only what is kept meets
    the rows themselves (`Lexicon.members`).
    """
    flagged = _flagged(live)
    kinds = flagged.where("has_content").select(*KIND).distinct()
    return deinflect.keyed_lexicon(kinds, deinflect.forms_said(flagged)).withColumn("kind", F.struct(*KIND))


def matches(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Candidates with the kinds under their key that pass the part-of-speech filter."""
    hits = keyed.join(found, F.col("key") == F.col("deinflected"))
    passed = hits.where(deinflect.passes_pos(F.col("conditions"), F.col("key_flags"), F.col("key_pos_filter")))
    hopped = F.col("hop").isNotNull()
    source = F.when(hopped & (F.size("rules") == 0), "dictionary").when(hopped, "both").otherwise("algorithm")
    chained = passed.withColumns({"source": source, "rules": F.concat("rules", F.coalesce("hop", F.array().cast("array<string>")))})
    return chained.drop("key", "key_flags", "key_pos_filter", "hop", "conditions", "flags", "parts_of_speech_filter")


def cut(rows: DataFrame) -> DataFrame:
    """Rows computed once where a plan reads them several times: a checkpoint in the cluster's shared folder, if one is set."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def as_kinds(found: DataFrame) -> DataFrame:
    """Matches as entries: one per query and kind, longest transformed text first, with what only the match tells. Which match is kept is the same for
    all rows of a kind; `as_entries` adds them."""
    source = F.when(F.contains("expression", F.col("deinflected")), "term").otherwise("reading")
    built = found.withColumns({"match_source": source, "max_length": F.octet_length("original"), "exact_count": (F.col("expression") == F.col("deinflected")).cast("int")})
    return entries.keep_longest(built.drop("expression", "reading"), ["query_id", "lang"], "kind")


def spelled(rows: DataFrame, primary: str = "") -> DataFrame:
    """Entries of kinds with what follows from their kind and source; added after joins, which move only what it follows from."""
    reading = F.coalesce(F.when(F.col("kind.reading") != "", F.col("kind.reading")), F.col("kind.expression"))
    rows = rows.withColumns({"expression": F.col("kind.expression"), "reading": reading})
    return rows.withColumns(
        {
            "norm_reading": textproc.normalize_reading(F.col("reading"), F.col("lang")),
            "is_primary": F.lit(True),
            "match_primary_reading": F.lit(bool(primary)) & (F.col("reading") == F.lit(primary)),
            "entry_ord": -F.octet_length("original"),
        }
    )


def as_entries(kinds: DataFrame, members: DataFrame, primary: str = "") -> DataFrame:
    """Entries of kinds with their rows: one per query and id, with what else the members have."""
    return spelled(kinds.join(members, "kind"), primary).select(*ENTRY, *(c for c in members.columns if c not in ("kind", *ENTRY)))


#: The narrow columns of an entry.
ENTRY = ("query_id", "lang", "id", "import_ord", "expression", "reading", "norm_reading", "dictionary", "dictionary_index", "alias", "sequence", "is_primary", "match_primary_reading", "match_source", "original", "deinflected", "max_length", "exact_count", "longest_original", "inflections", "text_chains", "entry_ord")


#: Types of what a lexicon may lack, and the order of metas within an entry.
_PITCH = "struct<reading:string,pitches:array<struct<position:int,nasal:array<smallint>,devoice:array<smallint>,tags:array<string>>>>"
_IPA = "struct<reading:string,transcriptions:array<struct<ipa:string,tags:array<string>>>>"
_TAG = {"category": "string", "tag_order": "bigint", "notes": "string", "score": "bigint", "dictionary": "string", "import_ord": "bigint"}
META_ORDER = ("headword_index", "dictionary_index", "index", "meta_id")


def _with_missing(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in rows.columns})


def with_hidden_main(lexicon: Lexicon, options: LookupOptions) -> tuple[Lexicon, LookupOptions]:
    """For merge mode: a main dictionary that is not enabled is searched all the same, as the last one, and left out of the result."""
    enabled = [r["name"] for r in lexicon.enabled.select("name").collect()]
    searched, hidden = filters.auto_excluded(options.main_dictionary, enabled)
    if not options.main_dictionary or not hidden:
        return lexicon, options
    given = {"name": F.lit(options.main_dictionary), "alias": F.lit(options.main_dictionary), "enabled": F.lit(True), "allow_secondary_searches": F.lit(False), "parts_of_speech_filter": F.lit(True), "use_deinflections": F.lit(True)}
    added = lexicon.options.agg((F.max("ord") + 1).alias("ord")).select(*(c.alias(n) for n, c in given.items()), "ord")
    shown = lexicon.options.where(F.col("name").isin(enabled)).select(*added.columns)
    return replace(lexicon, options=shown.unionByName(added)), replace(options, excluded=(*options.excluded, *hidden))


@dataclass(frozen=True)
class Found:
    """The result of a lookup as tables that meet on entry_key.

    entries: one row per entry, ranked per query. headwords, definitions (pos: their order from 1), frequencies and pronunciations
    (in META_ORDER), tags (owner: d, h or p with what it is a tag of). Nothing is nested; `nested` makes one row of each entry.
    """

    entries: DataFrame
    headwords: DataFrame
    definitions: DataFrame
    frequencies: DataFrame
    pronunciations: DataFrame
    tags: DataFrame
    lexicon: Lexicon
    #: What is said of a term and perhaps a reading, once for however many entries have it: frequencies and pronunciations as `meta.frequencies_of` has them.
    said: dict[str, DataFrame]
    #: The definitions with tag_list (tag_order, name, category) and redundant; the names of the headwords' tags.
    tagged_definitions: DataFrame
    headword_tags: DataFrame
    known_tags: DataFrame
    several: bool
    alone: bool
    simple: bool

    def with_listed(self, entries: DataFrame, items: dict[str, Column]) -> DataFrame:
        """Entries with frequencies and pronunciations of all their headwords in META_ORDER, each as one text of these items. They are gathered per term: there are
        as many rows as headwords, not as headwords times metas."""
        heads = self.headwords.select("entry_key", "headword_index", "term", "reading")
        words = distinct = heads.select("term", "reading").distinct()
        for kind, item in items.items():
            words = words.join(meta.listed(distinct, self.said[kind], META_ORDER[1:], item, kind), ["term", "reading"], "left")
        words = words.where(reduce(Column.__or__, (F.col(k).isNotNull() for k in items)))
        if not self.several:
            return entries.join(words, ["term", "reading"], "left")
        listing = {k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(k).isNotNull(), F.struct("headword_index", F.col(k).alias("v"))))), lambda x: x["v"]), "|") for k in items}
        return entries.join(heads.join(words, ["term", "reading"]).groupBy("entry_key").agg(*(c.alias(k) for k, c in listing.items())), "entry_key", "left")

    def with_tags(self, entries: DataFrame) -> DataFrame:
        """Entries with tag_list, (owner, tag_order, name, category) of their headwords in order; null or empty for those without."""
        if self.alone:
            known = entries.join(self.known_tags, F.col("dictionary") == F.col("_dict"), "left")
            of_head = F.transform(modes.tags_of(F.col("term_tags")), lambda t: F.struct(F.lit("h0").alias("owner"), t["tag_order"].alias("tag_order"), t["name"].alias("name"), t["category"].alias("category")))
            return known.withColumn("tag_list", F.sort_array(of_head)).drop("_dict", "_known")
        listed = F.sort_array(F.collect_list(F.struct(_owner("h", F.col("headword_index")).alias("owner"), "tag_order", "name", "category")))
        return entries.join(self.headword_tags.groupBy("entry_key").agg(listed.alias("tag_list")), "entry_key", "left")

    def nested(self) -> DataFrame:
        """One row per entry with arrays headwords, definitions, frequencies and pronunciations; for entries whose definitions fit a row."""
        tag = ("name", "category", "tag_order", "score", "dictionaries", "content", "redundant")
        tags = self.tags.groupBy("entry_key", "owner").agg(F.transform(F.sort_array(F.collect_list(F.struct("tag_order", "name", "category", F.struct(*tag).alias("_v")))), lambda t: t["_v"]).alias("tags"))
        none = F.array().cast(tags.schema["tags"].dataType)

        def owned(rows: DataFrame, owner) -> DataFrame:
            return rows.withColumn("owner", owner).join(tags, ["entry_key", "owner"], "left").withColumn("tags", F.coalesce("tags", none)).drop("owner")

        heads = modes.nest(owned(self.headwords, _owner("h", F.col("headword_index"))), "headwords", "headword_index", ("term", "reading", "primary_term", "sources", "tags"))
        defs = modes.nest(owned(self.lexicon.with_glossary(self.definitions), _owner("d", F.col("index"))), "definitions", "pos", ("index", *modes.DEFINITION, "frequency_order", "tags"))
        said = owned(self.pronunciations, _said())
        metas = {"frequencies": self.frequencies, "pronunciations": said}
        out = self.entries.drop("dictionary", "term_tags").join(heads, "entry_key").join(defs, "entry_key")
        for name, rows in metas.items():
            fields = [c for c in rows.columns if c not in ("entry_key", *META_ORDER)]
            listed = rows.groupBy("entry_key").agg(F.sort_array(F.collect_list(F.struct(*META_ORDER, *fields))).alias(name))
            out = out.join(listed, "entry_key", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
        return out


def enrich(groups: modes.Groups, lexicon: Lexicon, options: LookupOptions, per: list[str], *, simple: bool = False) -> Found:
    """Groups with frequencies, pronunciations, expanded tags and the order of definitions, their entries ranked per query.

    Metas come from the enabled dictionaries that are not excluded, ordered by META_ORDER. Tags are expanded and grouped per owner:
    those of definitions (redundant where the part-of-speech tags repeat those of the definition before), of headwords and of pronunciations. Simple mode has no tags and
    only the frequencies of the sort dictionary.
    """
    sort, ascending = options.sort_frequency_dictionary, options.sort_frequency_order == "ascending"
    heads = groups.headwords.select("entry_key", "headword_index", "term", "reading")
    shown = lexicon.enabled.where(~F.col("name").isin(*options.excluded)) if options.excluded else lexicon.enabled
    shown = shown.select(F.col("name").alias("meta_dictionary"), F.coalesce(F.nullif("alias", F.lit("")), F.col("name")).alias("meta_alias"), "dictionary_index")
    metas = _with_missing(lexicon.metas, {"pitch": _PITCH, "ipa": _IPA})
    metas = metas.where((F.col("dictionary") == sort) & (F.col("mode") == "freq") if sort else F.lit(False)) if simple else metas

    def of_enabled(rows: DataFrame) -> DataFrame:
        return rows.join(shown, "meta_dictionary")

    def listed(rows: DataFrame, *fields) -> DataFrame:
        return meta.of_headwords(heads, rows).select("entry_key", *META_ORDER, "meta_dictionary", "meta_alias", *fields)

    freqs = of_enabled(meta.frequencies_of(metas).withColumn("index", F.lit(0)))
    frequencies = listed(freqs, "has_reading", "frequency", "display_value", "display_value_parsed")
    pitches = meta.pitches_of(metas).withColumns({"kind": F.lit("pitch"), "ipa": F.lit(None).cast("string")})
    spoken = meta.transcriptions_of(metas).withColumns({"kind": F.lit("ipa"), "position": F.lit(None).cast("int"), "nasal": F.array().cast("array<smallint>"), "devoice": F.array().cast("array<smallint>")})
    spoken = of_enabled(pitches.unionByName(spoken))
    said = listed(spoken, "kind", "position", "nasal", "devoice", "ipa", F.col("tags").alias("tag_names"))

    definitions = groups.definitions
    if sort:
        ordered = meta.least_frequency(heads, freqs, sort, ascending=ascending).where("frequency_order IS NOT NULL").select("entry_key", "headword_index", "frequency_order")
        one = meta.least_frequency(heads.select("term", "reading").distinct(), freqs, sort, ascending=ascending).where("frequency_order IS NOT NULL")
        of_entries = ordered.groupBy("entry_key").agg(F.min("frequency_order").alias("frequency_order")) if groups.several else ordered.drop("headword_index")
        numbers = groups.entries.join(of_entries, "entry_key", "left") if groups.several else groups.entries.join(one, ["term", "reading"], "left")
        if groups.several:
            used = definitions.select("entry_key", "index", F.explode("headword_indices").alias("headword_index"))
            of_definitions = used.join(ordered, ["entry_key", "headword_index"]).groupBy("entry_key", "index").agg(F.min("frequency_order").alias("frequency_order"))
            definitions = definitions.join(of_definitions, ["entry_key", "index"], "left")
        else:
            definitions = definitions.withColumn("frequency_order", F.lit(None).cast("bigint"))
    else:
        definitions, numbers = (r.withColumn("frequency_order", F.lit(0).cast("bigint")) for r in (definitions, groups.entries))
    last = F.lit(meta.MAX if sort and ascending else 0)
    definitions, numbers = (r.withColumn("frequency_order", F.coalesce("frequency_order", last)) for r in (definitions, numbers))

    names = definitions.select("entry_key", _owner("d", F.col("index")).alias("owner"), "dictionary", F.explode("definition_tags").alias("tag_name"))
    names = names.unionByName(groups.term_tags.select("entry_key", _owner("h", F.col("headword_index")).alias("owner"), "dictionary", "tag_name"))
    names = names.unionByName(said.select("entry_key", _said().alias("owner"), F.col("meta_dictionary").alias("dictionary"), F.explode("tag_names").alias("tag_name")))
    names = names.where(F.lit(not simple) & (F.col("tag_name") != ""))
    names = names.where(~F.col("dictionary").isin(*options.excluded)) if options.excluded else names
    tags = tagged(names, lexicon, ["entry_key", "owner"])
    # Redundant part-of-speech tags: those of a definition that repeat the ones of the definition before it, of the same dictionary.
    pos = tags.where((F.col("category") == "partOfSpeech") & F.startswith("owner", F.lit("d"))).groupBy("entry_key", "owner").agg(F.sort_array(F.collect_set("name")).alias("_names"))
    spoken_of = definitions.select("entry_key", "index", "dictionary", _owner("d", F.col("index")).alias("owner")).join(pos, ["entry_key", "owner"], "left")
    repeated = filters.flag_redundant(spoken_of.withColumn("_names", F.coalesce("_names", F.array().cast("array<string>"))), ["entry_key"], ["index"], "_names")
    repeated = repeated.where("redundant").select("entry_key", "owner", "redundant")
    tags = tags.join(repeated, ["entry_key", "owner"], "left").withColumn("redundant", F.coalesce("redundant", F.lit(False)) & (F.col("category") == "partOfSpeech"))

    known = modes.tags_by_dictionary(_with_missing(lexicon.tags, _TAG))
    listing = modes.tags_of(F.col("definition_tags")) if not simple else F.array().cast("array<struct<tag_order:bigint,name:string,category:string>>")
    # One headword has one frequency: it orders no definition of an entry before another, so the definitions are in order without it.
    definitions = definitions.withColumn("pos", F.lit(1)) if groups.alone else rank.number_definitions(definitions, ["entry_key"])
    shown_tags = definitions.join(known, F.col("dictionary") == F.col("_dict"), "left").withColumn("tag_list", listing).drop("_dict", "_known")
    parts = F.array_sort(F.transform(F.filter("tag_list", lambda t: t["category"] == "partOfSpeech"), lambda t: t["name"]))
    shown_tags = shown_tags.withColumn("redundant", F.lit(False)) if groups.alone else filters.flag_redundant(shown_tags.withColumn("_names", parts), ["entry_key"], ["index"], "_names").drop("_names")
    if sort and not groups.several:
        definitions = definitions.drop("frequency_order").join(of_entries, "entry_key", "left").withColumn("frequency_order", F.coalesce("frequency_order", last))
    of_terms = groups.term_tags.where(~F.col("dictionary").isin(*options.excluded)) if options.excluded else groups.term_tags
    of_terms = of_terms.where(F.lit(not simple) & (F.col("tag_name") != "")).join(known, F.col("dictionary") == F.col("_dict"), "left").select("entry_key", "headword_index", F.explode(modes.tags_of(F.array("tag_name"))).alias("_t"))
    of_terms = of_terms.groupBy("entry_key", "headword_index", "_t.name", "_t.category").agg(F.min("_t.tag_order").alias("tag_order"))
    shown_rules = F.transform("inflections", lambda i: i.withField("rules", deinflect.display_rules(i["rules"])))
    ranked = rank.rank_entries(rank.chain_sizes(numbers.withColumn("inflections", shown_rules)), per)
    return Found(ranked, groups.headwords, definitions, frequencies, said.drop("tag_names"), tags, lexicon, {"frequencies": freqs, "pronunciations": spoken}, shown_tags, of_terms, known, groups.several, groups.alone, simple)


def tagged(names: DataFrame, lexicon: Lexicon, per: list[str]) -> DataFrame:
    """Tag names (per, dictionary, tag_name) as tags: expanded, then those of one name and category merged per owner."""
    expanded = modes.expand_tags(names, _with_missing(lexicon.tags, _TAG))
    expanded = expanded.select(*per, "dictionary", F.col("tag_name").alias("name"), "category", "tag_order", F.col("tag_score").alias("score"), F.try_element_at("content", F.lit(1)).alias("notes"))
    return modes.merge_similar_tags(expanded, per)


def _owner(kind: str, index):
    return F.concat(F.lit(kind), index.cast("string"))


def _said():
    return F.concat_ws(":", F.lit("p"), "kind", F.col("headword_index").cast("string"), F.col("index").cast("string"), "meta_id")


def find(queries: DataFrame, lexicon: Lexicon, mode: str = "group", options: LookupOptions = LookupOptions(), *, keep: bool = True) -> Found:
    """The entries of each query, as tables.

    keep: whether what was found is computed once for all of them (see `cut`); without, for plans that read one of the tables.

    Modes: simple and split leave entries as they are (one headword, one definition each), group merges by headword, merge
    by sequence of the main dictionary. Queries without entries give no row. matched_length is that of all matches of the query, before anything is left out.
    """
    if mode not in modes.MODES:
        raise ValueError(f"no such mode: {mode}")
    if mode == "merge":
        lexicon, options = with_hidden_main(lexicon, options)
    per = ["query_id"]
    live = lexicon.with_options()
    longest = KeyFacts.of(lexicon, options).longest
    kinds, members = as_kinds(matches(candidates(queries, options, longest=longest), index(live))), lexicon.members(tagged=mode != "merge")
    kinds = cut(kinds) if keep and mode == "group" else kinds
    found = as_entries(kinds, members, options.primary_reading)
    if mode == "merge":
        main = options.main_dictionary or lexicon.enabled.orderBy("dictionary_index").first()["name"]
        shown = live.where("has_content").withColumn("alias", F.coalesce(F.nullif("alias", F.lit("")), F.col("dictionary")))
        found = modes.by_sequence(cut(found), shown, per, main, lookup.secondary(lexicon.enabled))
    rows = lexicon.fetched(found) if mode == "merge" else found
    rows = cut(rows) if mode == "merge" or keep and mode != "group" else rows
    if mode == "merge":
        groups = modes.group_entries(modes.with_key(rows, [*per, "merge_key"]), per, several=True, dedup=F.startswith("merge_key", F.lit("seq:")))
    elif mode == "group":
        # A group holds whole kinds, so that only its definitions need their rows one by one.
        summed = members.groupBy("kind").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.max_by("alias", "id").alias("alias"), F.max("score").alias("score"), F.min("dictionary_index").alias("dictionary_index"), F.count("*").alias("n"))
        names = members.select("kind", "dictionary", F.explode("term_tags").alias("tag_name")).distinct()
        keyed = lambda more: modes.by_headword(spelled(kinds.join(more, "kind"), options.primary_reading), per)
        groups = modes.group_entries(modes.by_headword(rows, per), per, summed=keyed(summed), tag_names=keyed(names).select("entry_key", "dictionary", "tag_name"))
    else:
        groups = modes.alone(modes.with_key(rows, [*per, "lang", "id"]), per)
    lengths = F.max("longest_original").over(Window.partitionBy(*per))
    groups = replace(groups, entries=groups.entries.withColumn("matched_length", lengths).drop("longest_original"))
    if options.excluded:
        groups = filters.exclude_groups(groups, options.excluded)
    return enrich(groups, lexicon, options, per, simple=mode == "simple")


def find_terms(queries: DataFrame, lexicon: Lexicon, mode: str = "group", options: LookupOptions = LookupOptions()) -> DataFrame:
    """The entries of each query, ranked: one row per entry with headwords, definitions, frequencies, pronunciations, tags, scores, matched_length and entry_rank. See `find`."""
    return find(queries, lexicon, mode, options).nested()


def search_at(texts: DataFrame, lexicon: Lexicon, options: LookupOptions = LookupOptions(), *, keep: bool = True) -> Found:
    """Search at one position of each text (query_id, text, lang, position from 1): what the scan window there finds, with the sentence around each entry's match.

    Positions beyond the text find nothing. Texts of one language whose longest found source is the same have the same entries, so those are looked
    up once: entry_query is the query of the shared tables, and entries of several texts have one entry_key.
    """
    scanned = texts.select("query_id", "lang", substrings.window(F.col("text"), F.col("position")).alias("text"))
    sources = cut(longest_sources(scanned, lexicon, options))
    distinct = sources.select("entry_query").distinct()
    found = find(distinct.select(F.col("entry_query").alias("query_id"), F.col("entry_query.source").alias("text"), F.col("entry_query.lang").alias("lang")), lexicon, "group", options, keep=keep)
    around = substrings.sentence_around(F.col("text"), F.col("position"), F.length("original"))
    shared = sources.join(found.entries.withColumnRenamed("query_id", "entry_query"), "entry_query")
    placed = shared.join(texts.select("query_id", "text", "position"), "query_id").withColumn("sentence", around).drop("text", "position")
    return replace(found, entries=placed)


def longest_sources(queries: DataFrame, lexicon: Lexicon, options: LookupOptions) -> DataFrame:
    """(query_id, entry_query): the longest substring of each text that has entries, with the language. What `pieces` cuts of that is what it cuts of the text from there on, so
    it stands for the text in a lookup."""
    facts = KeyFacts.of(lexicon, options)
    keys = cut(index(lexicon.with_options()).select("key", "key_flags", "key_pos_filter").distinct())
    held = pieces(queries, options, longest=facts.longest)
    found = looked_up(expanded(held.select("lang", "original").distinct(), options), keys, F.col("deinflected") == F.col("key"), facts.small and keys.count() * 2 * ROW < BROADCAST)
    matched = found.where(deinflect.passes_pos(F.col("conditions"), F.col("key_flags"), F.col("key_pos_filter"))).select(F.col("lang").alias("_lang"), F.col("original").alias("_original")).distinct()
    own = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("original") == F.col("_original"))
    longest = F.max_by("original", F.length("original"))
    return held.join(matched, own).groupBy("query_id", "lang").agg(longest.alias("source")).select("query_id", F.struct("source", "lang").alias("entry_query"))


def _folded(text):
    """Equal for texts that processors make equal: the processors keep what this folds, and change nothing else."""
    return F.translate(F.replace(F.lower(textproc.to_hiragana(text)), F.lit("ß"), F.lit("ss")), "ёς", "еσ")


def _characters(side: int, languages: Sequence[str]) -> str:
    return "".join(sorted({c for r in deinflect.RULES if r[1] in languages for c in r[side]}))


def taken(languages: Sequence[str]) -> str:
    """The characters that rules of these languages take away, with those that processors turn into them."""
    own = _characters(2, languages)
    return "".join(sorted({*own, *own.upper(), *own.translate(str.maketrans(textproc._HIRAGANA, textproc._KATAKANA)), *"ßẞёЁ"}))


_WORD = r"[\p{L}\p{N}]"


def within(text, longest, letters, languages: Sequence[str] = LANGUAGES):
    """The text up to what can become a key of `longest` characters.

    Chains of rules have any length, but what they take away are characters of `taken`: a text that becomes a key begins with at
    most `longest` others. Cuts are at the end of a run of those, and of a word where texts are cut by words, so that none begins a
    candidate that the text does not have.
    """
    after = F.substring(text, longest + 1, F.length(text))
    run = F.when(letters, F.regexp_extract(after, f"^[{taken(languages)}]*", 0)).otherwise(F.regexp_extract(after, f"^{_WORD}*", 0))
    return F.concat(F.left(text, longest), run)


@dataclass(frozen=True)
class KeyFacts:
    """What is known of the keys of a lexicon before a plan is made: the length of the longest, plain or folded (None with text replacements, which can make
    anything of a text), whether a key may consist only of what rules leave in languages without spaces, and whether tables of them may be broadcast."""

    longest: int | None = None
    bare: bool = True
    small: bool = False

    @classmethod
    def of(cls, lexicon: Lexicon, options: LookupOptions) -> KeyFacts:
        """One small job over two columns."""
        keys = lexicon.terms.select(F.explode(F.array("expression", "reading")).alias("key"))
        longest = F.max(F.greatest(F.length("key"), F.length(_folded(F.col("key")))))
        longest, bare, size = keys.agg(longest, F.bool_or(F.col("key").rlike(f"^[{_characters(3, textproc.UNSPACED)}]+$")), F.approx_count_distinct("key") * (F.avg(F.octet_length("key")) + ROW)).first()
        return cls(None if options.text_replacements else longest or 0, bool(bare), (size or 0) < BROADCAST)


#: The bytes up to which a table of keys is broadcast, and what a row takes beside its key. Beyond, both sides are shuffled: what texts are exploded to must never be
#: broadcast, though the planner takes it for as small as the texts.
BROADCAST, ROW = 16 << 20, 64


def looked_up(rows: DataFrame, keys: DataFrame, on, small: bool, how: str = "inner") -> DataFrame:
    """Rows made of texts joined to a table of keys, which is broadcast if its size was found to be small."""
    return rows.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def by_letters(lang, options: LookupOptions):
    return F.coalesce(lang.isin(*textproc.UNSPACED), F.lit(False)) | F.lit(options.search_resolution == "letter")


def _lengths(keys: DataFrame) -> DataFrame:
    """(f, reach): each key folded, and its length, the greater of both forms."""
    return keys.select(_folded(F.col("key")).alias("f"), F.greatest(F.length("key"), F.length(_folded(F.col("key")))).alias("reach"))


def reachable(starts: DataFrame, keys: DataFrame, options: LookupOptions, small: bool = False) -> DataFrame:
    """The starts (with text) with `most`: how many of its first characters a key can share with it, at most.

    Keys are known by their first 1, 2 and 4 characters: a text shares with a key as much as the longest key of its first four
    characters has, or 3, 1 or 0 of them. The tables of one and two are small, the third is at most as large as the keys and joined to what the others leave. Texts that share
    nothing stay if rules can take them away as a whole.
    """
    folded, lengths = _folded(F.left("text", F.lit(4))), _lengths(keys)
    out = starts
    for n in (1, 2, 4):
        heads = lengths.where(F.length("f") >= n).groupBy(F.left("f", F.lit(n)).alias(f"_h{n}")).agg(F.max("reach").alias(f"_r{n}"))
        out = looked_up(out, heads, F.left(folded, F.lit(n)) == F.col(f"_h{n}"), small, "left").drop(f"_h{n}")
        if n == 2 and not options.deinflect:
            out = out.where("_r1 IS NOT NULL")
    most = F.when(F.col("_r4").isNotNull(), F.col("_r4")).when(F.col("_r2").isNotNull(), F.least(F.lit(3), F.col("_r2"))).when(F.col("_r1").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return out.withColumn("most", most).drop("_r1", "_r2", "_r4")


def _first_word(text):
    """A text, folded, up to the first separator after its first character; empty if there is none. Rules neither take nor leave separators, so a text
    that goes beyond one becomes only keys that begin so too."""
    return F.regexp_extract(_folded(text), rf"(?s)^.{_WORD}*[^\p{{L}}\p{{N}}]", 0)


def spread(texts: DataFrame) -> DataFrame:
    """Texts over all cores: a text becomes hundreds of stretches, so few input splits would leave cores idle.

    Only inputs of less than a split of 64 MB per core are shuffled (by the planner's estimate, no job is run for it).
    """
    cores = texts.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return texts.repartition(cores * 4, "query_id") if estimate < cores * (64 << 20) else texts


_BEGINS, _WHITE = rf"(?<![^{substrings.WHITE}])", substrings.WHITE


def stretches(rows: DataFrame, pattern: str) -> DataFrame:
    """(query_id, lang, text): what group 1 of a pattern holds, wherever it matches, distinct per text. One pass over the text, looking ahead."""
    return rows.select("query_id", "lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("text"))


def by_words(texts: DataFrame, keys: DataFrame, facts: KeyFacts) -> DataFrame:
    """Of texts cut by words the single words, a vocabulary, and longer stretches where the first word with its separator begins a key of several words."""
    run = rf".{{0,{max(facts.longest - 1, 0)}}}"
    words = stretches(texts, rf"{_BEGINS}([^{_WHITE}]{_WORD}*)")
    several = stretches(texts, rf"(?s){_BEGINS}(?=([^{_WHITE}]{_WORD}*[^\p{{L}}\p{{N}}]{run}{_WORD}*)).")
    joined = _lengths(keys).select(_first_word(F.col("f")).alias("_m"), "reach").where("_m <> ''").groupBy("_m").agg(F.max("reach").alias("_reach"))
    several = looked_up(several, joined, _first_word(F.col("text")) == F.col("_m"), facts.small).select("query_id", "lang", within(F.col("text"), F.col("_reach"), F.lit(False)).alias("text"))
    return words.unionByName(several)


def by_characters(texts: DataFrame, keys: DataFrame, facts: KeyFacts, options: LookupOptions) -> DataFrame:
    """(query_id, lang, original): of texts without spaces the substrings from every position that can become a key, see `reachable`."""
    every = stretches(texts, rf"(?s)(?=(.{{1,{max(facts.longest, 1)}}}[{taken(textproc.UNSPACED)}]*)).")
    placed = reachable(every, keys, options, facts.small)
    if not options.deinflect:
        return placed.select("query_id", "lang", F.explode(substrings.letter_substrings(F.left("text", F.col("most")))).alias("original"))
    placed = (placed if facts.bare else placed.where("most > 0")).withColumn("text", within(F.col("text"), F.col("most"), F.lit(True), textproc.UNSPACED)).where("text <> ''")
    return placed.select("query_id", "lang", F.explode(deinflect.inflected_prefixes(F.col("text"), F.col("lang"), F.col("most"), facts.bare)).alias("original"))


def search_keys(texts: DataFrame, lexicon: Lexicon, options: LookupOptions = LookupOptions(), *, prune: bool = True) -> DataFrame:
    """(query_id, original): the source texts in each text that have entries, from every start position.

    Words, stretches and substrings are made distinct over all texts before anything is looked up: each is de-inflected and matched once, and
    what was found is joined back to the texts. With text replacements, which can make anything of a text, or without prune every stretch to
    the end of the text is looked at.
    """
    return _search_keys(texts, lexicon, options, prune=prune).select("query_id", "original").distinct()


def _search_keys(texts: DataFrame, lexicon: Lexicon, options: LookupOptions, *, prune: bool = True) -> DataFrame:
    """`search_keys` with lang."""
    keyed = index(lexicon.with_options())
    # Of the lexicon only its keys are needed, with the flags they have: far fewer rows than terms.
    keys = cut(keyed.select("key", "key_flags", "key_pos_filter").distinct())
    facts = KeyFacts.of(lexicon, options) if prune else KeyFacts()
    longest = facts.longest
    texts = spread(texts.select("query_id", textproc.base_language("lang").alias("lang"), "text").where("text <> ''"))
    unspaced, names = substrings.is_unspaced("lang"), keys.select("key").distinct()
    whole, parts = [], None
    if longest is None:
        whole = [stretches(texts.where(unspaced), "(?s)(?=(.+))."), stretches(texts.where(~unspaced), rf"(?s){_BEGINS}(?=([^{_WHITE}].*)).")]
    else:
        spaced = texts.where(~unspaced)
        letter = rf"(?s){_BEGINS}(?=([^{_WHITE}].{{0,{longest}}}[{taken(LANGUAGES)}]*))."
        whole = [stretches(spaced, letter) if options.search_resolution == "letter" else by_words(spaced, names, facts)]
        parts = cut(by_characters(texts.where(unspaced), names, facts, options))
    occurring = cut(reduce(DataFrame.unionByName, whole))
    distinct = occurring.select("lang", "text").distinct()
    held = pieces(distinct.select(F.col("text").alias("query_id"), "lang", "text"), options, longest=longest).withColumnRenamed("query_id", "text")
    originals = held.select("lang", "original") if parts is None else held.select("lang", "original").unionByName(parts.select("lang", "original"))
    # A key stands here once for each of its flags, so the rows themselves are counted.
    found = looked_up(expanded(originals.distinct(), options), keys, F.col("deinflected") == F.col("key"), facts.small and keys.count() * 2 * ROW < BROADCAST)
    matched = found.where(deinflect.passes_pos(F.col("conditions"), F.col("key_flags"), F.col("key_pos_filter"))).select(F.col("lang").alias("_lang"), F.col("original").alias("_original")).distinct()
    own = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("original") == F.col("_original"))
    holding = held.join(matched, own).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"), "original").distinct()
    rows = occurring.join(holding, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("text") == F.col("_text"))).select("query_id", "lang", "original")
    return (rows if parts is None else rows.unionByName(parts.join(matched, own).select("query_id", "lang", "original"))).distinct()


def search(texts: DataFrame, lexicon: Lexicon, options: LookupOptions = LookupOptions()) -> DataFrame:
    """Segments of each text (query_id, text, lang): seg_pos, segment, matched. Texts without any entry give no row."""
    keys = search_keys(texts, lexicon, options)
    return segment.longest_match(spread(texts.select("query_id", "text")), keys, ["query_id"])


def search_entries(texts: DataFrame, lexicon: Lexicon, options: LookupOptions = LookupOptions()) -> tuple[DataFrame, Found]:
    """The segments of each text, and what is found for them in group mode, once per distinct source text and language.

    The segments have entry_query, which is the query_id of their entries; it is null for those without. Of entries with the same first headword and
    definition within a segment the first is kept. Entries are looked up for all sources found in the texts, whether the scan takes them or not: they are a
    vocabulary, while the segments, a row for each character that matches nothing, are neither stored nor shuffled for it.
    """
    keys = cut(_search_keys(texts, lexicon, options))
    segments = segment.longest_match(spread(texts.select("query_id", textproc.base_language("lang").alias("lang"), "text")), keys.select("query_id", "original").distinct(), ["query_id"], keep=["lang"])
    keyed = segments.withColumn("entry_query", F.when(F.col("matched"), F.struct("segment", "lang"))).drop("lang")
    distinct = keys.select(F.struct(F.col("original").alias("segment"), "lang").alias("entry_query")).distinct()
    found = find(distinct.select(F.col("entry_query").alias("query_id"), F.col("entry_query.segment").alias("text"), F.col("entry_query.lang").alias("lang")), lexicon, "group", options)
    return keyed, replace(found, entries=segment.dedup_segments(found.entries, ["query_id"], ["entry_rank"]))


def with_entries(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments with the entries (entry_query and more) of theirs, or nulls. Entries of a small vocabulary are broadcast behind a check of their size; else only the
    segments that match are shuffled."""
    entries = cut(entries)
    if entries.agg(F.count("*") * 4 * ROW).first()[0] < BROADCAST:
        return segments.join(F.broadcast(entries), "entry_query", "left")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in entries.schema if f.name != "entry_query"]
    rest = segments.where("entry_query IS NULL")
    return segments.where("entry_query IS NOT NULL").join(entries, "entry_query", "left").unionByName(rest.select("*", *missing))
