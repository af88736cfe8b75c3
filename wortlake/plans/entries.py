"""Queries of entries, groups, metas, filters, orders, segments and notes over the lexicon tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlake.functions import textproc
from wortlake.operators import deinflect, entries, filters, lookup, meta, modes, notes, packed, rank, segment
from wortlake.plans import pipeline
from wortlake.plans.general import _values_sql
from wortlake.plans.lookups import DEINFLECTED, EN, LEX, deinflected_words, enabled, lexicon
from wortlake.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


_NORM = f"translate({{}}, '{textproc._KATAKANA}', '{textproc._HIRAGANA}')"
_MAIN = "(SELECT name FROM en JOIN summaries ON title = name WHERE sequenced ORDER BY dictionary_index LIMIT 1)"
_CONTENT = "list_filter(glossary, lambda g: g.kind = 'Content')"
LEXE = f"""{LEX}, {EN}, lexe AS (SELECT id, expression, coalesce(nullif(reading, ''), expression) AS reading, {_NORM.format("coalesce(nullif(reading, ''), expression)")} AS norm_reading, dictionary,
    dictionary_index, coalesce(nullif(alias, ''), dictionary) AS alias, CASE WHEN sequence >= 0 THEN sequence ELSE -1 END AS sequence, coalesce(score, 0) AS score, {_CONTENT} AS content, lex.reading AS raw_reading, allow_secondary_searches
  FROM lex JOIN en ON en.name = lex.dictionary WHERE len({_CONTENT}) > 0)"""
ENTRIES = f"""{LEXE}, e AS (SELECT DISTINCT h.headword_id AS query_id, h.headword AS key, l.*, CASE WHEN contains(expression, h.headword) THEN 'term' ELSE 'reading' END AS match_source,
    strlen(h.headword) AS max_length, CASE WHEN expression = h.headword THEN 1 WHEN expression IS NULL THEN NULL ELSE 0 END AS exact_count
  FROM headwords h JOIN lexe l ON l.expression = h.headword OR l.raw_reading = h.headword)"""


def exact_entries(spark: SparkSession, root: str, *, wide: bool = True) -> DataFrame:
    """Every headword as a query of its own, without de-inflection: the entries of its exact matches among live rows with content; readings are normalised as in ja."""
    lexicon = pipeline.Lexicon.of(spark, root)
    keys = table(spark, root, "headwords").select(F.col("headword_id").alias("query_id"), F.col("headword").alias("key"), F.lit(0).alias("key_ord"))
    hits = lookup.bulk_lookup(lexicon.with_options().where("has_content"), keys, per=["query_id"])
    empty = F.array().cast("array<string>")
    reading = F.coalesce(F.nullif("reading", F.lit("")), F.col("expression"))
    hits = hits.withColumns({"original": F.col("key"), "deinflected": F.col("key"), "alias": F.coalesce(F.nullif("alias", F.lit("")), F.col("dictionary")), "norm_reading": textproc.to_hiragana(reading)})
    built = entries.build(hits).withColumns(
        {
            "is_primary": F.lit(True),
            "match_primary_reading": F.lit(False),
            "inflections": F.array(F.struct(F.lit("algorithm").alias("source"), empty.alias("rules"))),
            "text_chains": F.array(empty),
            "entry_ord": -F.col("max_length"),
            "longest_original": F.col("max_length"),
            "lang": F.lit("ja"),
        }
    ).select(*pipeline.ENTRY)
    return lexicon.fetched(built) if wide else built


def grouped(spark: SparkSession, root: str, *, dedup: bool = False) -> modes.Groups:
    keyed = modes.with_key(exact_entries(spark, root), ["query_id", "expression", "norm_reading"])
    return modes.group_entries(keyed, ["query_id"], dedup=F.lit(True) if dedup else None)


def _definitions(groups: modes.Groups) -> DataFrame:
    """The definitions with the headword of their group, where it has one."""
    return groups.definitions.join(groups.headwords.select("entry_key", F.col("term").alias("expression"), "norm_reading"), "entry_key")


def main_dictionary(spark: SparkSession, root: str) -> str:
    """The first enabled dictionary that is sequenced."""
    sequenced = table(spark, root, "summaries").where("sequenced").select(F.col("title").alias("name"))
    return enabled(spark, root).join(sequenced, "name").orderBy("dictionary_index").first()["name"]


@query("k55_entries", f"WITH {ENTRIES} SELECT query_id, id, reading, norm_reading, alias, dictionary_index, sequence, score, match_source, max_length, exact_count FROM e")
def _(spark, root):
    return exact_entries(spark, root).select("query_id", "id", "reading", "norm_reading", "alias", "dictionary_index", "sequence", "score", "match_source", "max_length", "exact_count")


@query(
    "k56_keep_longest",
    f"""WITH RECURSIVE {LEX}, {DEINFLECTED} SELECT lang, word, id, count(DISTINCT list_sort(list_filter(string_split(chain, '<'), lambda x: x <> ''))) AS n_inflections
    FROM deinflected d JOIN lex ON expression = d.text GROUP BY ALL""",
)
def _(spark, root):
    terms = lexicon(spark, root).select("id", "expression")
    found = deinflected_words(spark, root).join(terms, F.col("deinflected") == F.col("expression"))
    chained = found.withColumns({"transformed": F.col("original"), "source": F.lit("algorithm"), "text_chain": F.array().cast("array<string>")})
    kept = entries.keep_longest(chained.withColumn("word", F.col("original")), ["lang", "word"])
    return kept.select("lang", "word", "id", F.size("inflections").cast("bigint").alias("n_inflections"))


@query("k60_matched_length", f"WITH {ENTRIES} SELECT query_id, CAST(max(max_length) AS INTEGER) AS matched_length FROM e GROUP BY query_id")
def _(spark, root):
    return entries.matched_length(exact_entries(spark, root), ["query_id"])


@query(
    "k61_group_by_headword",
    f"""WITH {ENTRIES} SELECT query_id, expression, norm_reading, max(score) AS score, min(dictionary_index) AS dictionary_index, arg_max(alias, id) AS alias, max(max_length) AS max_length, count(*) AS n_definitions,
      CAST(max(CASE WHEN match_source = 'term' THEN 1 ELSE 0 END) AS INTEGER) AS exact_count FROM e GROUP BY query_id, expression, norm_reading""",
)
def _(spark, root):
    # A null term is no headword of its own, so its matches are by reading and count none.
    return grouped(spark, root).entries.select("query_id", "expression", "norm_reading", "score", "dictionary_index", "alias", "max_length", "n_definitions", "exact_count")



_MERGED = f"""{ENTRIES}, main AS (SELECT {_MAIN} AS name),
  mr AS (SELECT query_id, id, expression, reading, norm_reading, 'seq:' || sequence AS merge_key, sequence, true AS is_primary FROM e WHERE dictionary = (SELECT name FROM main) AND sequence >= 0),
  rel AS (SELECT g.query_id, l.id, l.expression, l.reading, l.norm_reading, g.merge_key, l.sequence, false FROM lexe l JOIN (SELECT DISTINCT query_id, merge_key, sequence FROM mr) g ON l.sequence = g.sequence
    WHERE l.dictionary = (SELECT name FROM main) AND NOT EXISTS (SELECT 1 FROM mr WHERE mr.query_id = g.query_id AND mr.merge_key = g.merge_key AND mr.id = l.id)),
  together AS (SELECT * FROM mr UNION ALL SELECT * FROM rel),
  ung AS (SELECT query_id, id, expression, reading, norm_reading, sequence FROM e WHERE NOT coalesce(dictionary = (SELECT name FROM main) AND sequence >= 0, false) AND NOT EXISTS (SELECT 1 FROM together t WHERE t.query_id = e.query_id AND t.id = e.id)),
  absorbed AS (SELECT u.query_id, u.id, u.expression, u.reading, u.norm_reading, h.merge_key, u.sequence, true AS is_primary FROM ung u JOIN (SELECT DISTINCT query_id, merge_key, expression, norm_reading FROM together) h
    ON u.query_id = h.query_id AND u.expression = h.expression AND u.norm_reading = h.norm_reading),
  both_ AS (SELECT * FROM together UNION ALL SELECT * FROM absorbed),
  second AS (SELECT p.query_id, l.id, l.expression, l.reading, l.norm_reading, p.merge_key, l.sequence, false FROM lexe l JOIN (SELECT DISTINCT query_id, merge_key, expression, reading FROM both_) p ON l.expression = p.expression AND l.raw_reading = p.reading
    WHERE l.allow_secondary_searches AND NOT EXISTS (SELECT 1 FROM both_ b WHERE b.query_id = p.query_id AND b.merge_key = p.merge_key AND b.id = l.id)),
  merged AS (SELECT * FROM both_ UNION ALL SELECT * FROM second UNION ALL
    SELECT query_id, id, expression, reading, norm_reading, 'head', sequence, true FROM ung u WHERE NOT EXISTS (SELECT 1 FROM absorbed a WHERE a.query_id = u.query_id AND a.id = u.id))"""


def merged(spark: SparkSession, root: str) -> DataFrame:
    second = lookup.secondary(enabled(spark, root))
    known = pipeline.Lexicon.of(spark, root).with_options().where("has_content").withColumn("alias", F.coalesce(F.nullif("alias", F.lit("")), F.col("dictionary")))
    return modes.by_sequence(pipeline.cut(exact_entries(spark, root, wide=False)), known, ["query_id"], main_dictionary(spark, root), second)


def merged_groups(spark: SparkSession, root: str) -> modes.Groups:
    rows = pipeline.cut(pipeline.Lexicon.of(spark, root).fetched(merged(spark, root).where("merge_key LIKE 'seq:%'")))
    return modes.group_entries(modes.with_key(rows, ["query_id", "merge_key"]), ["query_id", "merge_key"], several=True, dedup=F.lit(True))


@query("k62_merge_by_sequence", f"WITH {_MERGED} SELECT query_id, merge_key, id, is_primary FROM merged")
def _(spark, root):
    key = F.when(F.col("merge_key").startswith("seq:"), F.col("merge_key")).otherwise("head")
    return merged(spark, root).select("query_id", key.alias("merge_key"), "id", "is_primary")


@query(
    "k63_merged_entries",
    f"""WITH {_MERGED} SELECT query_id, merge_key, count(DISTINCT (expression, norm_reading)) AS n_headwords, bool_or(is_primary) AS is_primary FROM merged WHERE merge_key <> 'head' GROUP BY ALL""",
)
def _(spark, root):
    return merged_groups(spark, root).entries.select("query_id", "merge_key", F.col("n_headwords").cast("bigint").alias("n_headwords"), "is_primary")


@query("k64_definitions", f"WITH {ENTRIES} SELECT query_id, expression, id, CAST(row_number() OVER (PARTITION BY query_id, expression, norm_reading ORDER BY id) - 1 AS INTEGER) AS index FROM e")
def _(spark, root):
    return _definitions(grouped(spark, root)).select("query_id", "expression", "id", "index")


@query(
    "k65_definition_dedup",
    f"""WITH {ENTRIES} SELECT query_id, expression, norm_reading, dictionary, count(DISTINCT sequence) AS n_sequences, min(id) AS id FROM e GROUP BY query_id, expression, norm_reading, dictionary, CAST(content AS VARCHAR)""",
)
def _(spark, root):
    rows = _definitions(grouped(spark, root, dedup=True))
    return rows.select("query_id", "expression", "norm_reading", "dictionary", F.size("sequences").cast("bigint").alias("n_sequences"), "id")


@query(
    "k66_headword_index",
    f"""WITH {ENTRIES}, h AS (SELECT query_id, expression, norm_reading, min(id) AS first, count(DISTINCT match_source) AS n_sources FROM e GROUP BY query_id, expression, norm_reading)
    SELECT query_id, expression, norm_reading, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS INTEGER) AS headword_index, n_sources FROM h""",
)
def _(spark, root):
    heads = modes.merge_headwords(exact_entries(spark, root), ["query_id"], ["entry_ord", "id"])
    return heads.select("query_id", "expression", "norm_reading", "headword_index", F.size("sources").cast("bigint").alias("n_sources"))


@query("k68_merge_sources", f"WITH {ENTRIES} SELECT query_id, original, deinflected, match_source, true AS is_primary FROM (SELECT DISTINCT query_id, key AS original, key AS deinflected, match_source FROM e)")
def _(spark, root):
    return modes.merge_sources(exact_entries(spark, root), ["query_id", "original", "deinflected", "match_source"])


_TAGS = """merged_tags AS (SELECT name, category, min(tag_order) AS tag_order, max(score) AS score, list_sort(list_distinct(list(dictionary) FILTER (dictionary IS NOT NULL))) AS dictionaries,
  list_sort(list_distinct(coalesce(list(notes) FILTER (notes <> ''), []))) AS content FROM tags GROUP BY name, category)"""


@query("k69_merge_similar_tags", f"WITH {_TAGS} SELECT name, category, tag_order, score, array_to_string(coalesce(dictionaries, []), '|') AS dictionaries, array_to_string(content, '|') AS content FROM merged_tags")
def _(spark, root):
    tags = modes.merge_similar_tags(table(spark, root, "tags"))
    return tags.withColumns({"dictionaries": F.array_join("dictionaries", "|"), "content": F.array_join("content", "|")})


@query("k70_ordered_tags", f"WITH {_TAGS} SELECT category, string_agg(name, ' ' ORDER BY tag_order, name) AS names FROM merged_tags WHERE name IS NOT NULL GROUP BY category")
def _(spark, root):
    tags = modes.merge_similar_tags(table(spark, root, "tags").where("name IS NOT NULL"))
    groups = tags.groupBy("category").agg(modes.ordered_tags(F.collect_list(F.struct("tag_order", "name"))).alias("t"))
    return groups.select("category", F.array_join(F.transform("t", lambda x: x["name"]), " ").alias("names"))


@query(
    "k71_tag_groups",
    f"SELECT expression, dictionary, string_agg(v, ' ' ORDER BY v) AS names FROM (SELECT DISTINCT expression, dictionary, v FROM (SELECT expression, dictionary, unnest({_values_sql('term_tags')}) AS v FROM terms)) GROUP BY expression, dictionary",
)
def _(spark, root):
    owners = table(spark, root, "terms").select("expression", "dictionary", packed.unpack("term_tags").alias("n"))
    return modes.tag_groups(owners, "expression", "n").withColumn("names", F.array_join("names", " "))


@query(
    "k72_expand_tags",
    f"""WITH n AS (SELECT DISTINCT v AS tag_name, dictionary FROM (SELECT dictionary, unnest({_values_sql('definition_tags')}) AS v FROM terms)), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, dictionary ORDER BY import_ord) AS r FROM tags) WHERE r = 1)
    SELECT tag_name, n.dictionary, coalesce(nullif(category, ''), 'default') AS category, coalesce(tag_order, 0) AS tag_order, coalesce(score, 0) AS tag_score, coalesce(notes, '') AS content FROM n LEFT JOIN first f ON f.name = split_part(tag_name, ':', 1) AND f.dictionary = n.dictionary""",
)
def _(spark, root):
    names = table(spark, root, "terms").select("dictionary", F.explode(packed.unpack("definition_tags")).alias("tag_name")).distinct()
    return modes.expand_tags(names, table(spark, root, "tags")).withColumn("content", F.array_join("content", "|"))


_METAS = "metas AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY term) AS r FROM term_meta) WHERE r = 1)"


def heads(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "headwords").select("headword_id", F.col("headword").alias("term"), "reading")


def metas(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "term_meta").dropDuplicates(["id"])


_FREQ = f"{_METAS}, f AS (SELECT headword_id, m.id AS meta_id, m.dictionary AS meta_dictionary, freq.reading IS NOT NULL AS has_reading, freq.value AS frequency FROM headwords h JOIN metas m ON m.term = h.headword AND mode = 'freq' AND (freq.reading IS NULL OR freq.reading = h.reading))"


@query("k73_frequency_order", f"WITH {_FREQ} SELECT h.headword_id, coalesce(v, 9223372036854775807) AS frequency_order FROM headwords h LEFT JOIN (SELECT headword_id, min(frequency) AS v FROM f WHERE meta_dictionary = (SELECT min(dictionary) FROM term_meta WHERE mode = 'freq') GROUP BY headword_id) USING (headword_id)")
def _(spark, root):
    name = metas(spark, root).where("mode = 'freq'").agg(F.min("dictionary")).first()[0]
    found = meta.frequencies(heads(spark, root), metas(spark, root), name)
    return meta.frequency_order(heads(spark, root), found, ["headword_id"], name).select("headword_id", "frequency_order")


@query("k73_frequency_order_desc", f"WITH {_FREQ} SELECT h.headword_id, coalesce(-v, 0) AS frequency_order FROM headwords h LEFT JOIN (SELECT headword_id, max(frequency) AS v FROM f WHERE meta_dictionary = (SELECT min(dictionary) FROM term_meta WHERE mode = 'freq') GROUP BY headword_id) USING (headword_id)")
def _(spark, root):
    name = metas(spark, root).where("mode = 'freq'").agg(F.min("dictionary")).first()[0]
    found = meta.frequencies(heads(spark, root), metas(spark, root), name)
    return meta.frequency_order(heads(spark, root), found, ["headword_id"], name, ascending=False).select("headword_id", "frequency_order")


@query("k75_frequencies", f"WITH {_FREQ} SELECT * FROM f")
def _(spark, root):
    return meta.frequencies(heads(spark, root), metas(spark, root)).select("headword_id", "meta_id", "meta_dictionary", "has_reading", "frequency")


@query("k78_sort_frequencies", f"WITH {_FREQ} SELECT headword_id, meta_id, frequency FROM f WHERE meta_dictionary = (SELECT min(dictionary) FROM term_meta WHERE mode = 'freq')")
def _(spark, root):
    name = metas(spark, root).where("mode = 'freq'").agg(F.min("dictionary")).first()[0]
    return meta.frequencies(heads(spark, root), metas(spark, root), name).select("headword_id", "meta_id", "frequency")


_PITCH = f"""{_METAS}, p AS (SELECT headword_id, meta_id, meta_dictionary, CAST(i AS INTEGER) - 1 AS index, pitches[i] AS x FROM (SELECT headword_id, m.id AS meta_id, m.dictionary AS meta_dictionary, pitch.pitches AS pitches, unnest(range(1, len(pitch.pitches) + 1)) AS i
  FROM headwords h JOIN metas m ON m.term = h.headword AND mode = 'pitch' AND pitch.reading = h.reading))"""


@query("k76_pitches", f"WITH {_PITCH} SELECT headword_id, meta_id, index, x.position AS position, array_to_string(coalesce(x.nasal, []), ',') AS nasal, array_to_string(coalesce(x.devoice, []), ',') AS devoice, array_to_string(coalesce(x.tags, []), ',') AS tags FROM p")
def _(spark, root):
    rows = meta.pitches(heads(spark, root), metas(spark, root))
    return rows.select("headword_id", "meta_id", "index", "position", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("nasal", "devoice", "tags")))


@query("k77_transcriptions", f"WITH {_METAS} SELECT headword_id, meta_id, t.ipa AS ipa, array_to_string(coalesce(t.tags, []), ',') AS tags FROM (SELECT headword_id, m.id AS meta_id, unnest(ipa.transcriptions) AS t FROM headwords h JOIN metas m ON m.term = h.headword AND mode = 'ipa' AND ipa.reading = h.reading)")
def _(spark, root):
    return meta.transcriptions(heads(spark, root), metas(spark, root)).select("headword_id", "meta_id", "ipa", F.array_join("tags", ",").alias("tags"))


@query("k79_exclude_dictionaries", f"WITH {ENTRIES} SELECT query_id, expression, norm_reading, count(*) AS n_definitions FROM e WHERE dictionary <> {_MAIN} GROUP BY query_id, expression, norm_reading")
def _(spark, root):
    kept = filters.exclude_groups(grouped(spark, root), [main_dictionary(spark, root)])
    return kept.entries.select("query_id", "expression", "norm_reading", "n_definitions")


@query("k81_prune_headwords", f"WITH {_MERGED} SELECT query_id, merge_key, count(DISTINCT (m.expression, m.norm_reading)) AS n_headwords FROM merged m JOIN lexe l USING (id) WHERE merge_key <> 'head' AND dictionary <> (SELECT name FROM main) GROUP BY query_id, merge_key")
def _(spark, root):
    kept = filters.exclude_groups(merged_groups(spark, root), [main_dictionary(spark, root)])
    return kept.entries.select("query_id", "merge_key", F.col("n_headwords").cast("bigint").alias("n_headwords"))


@query("k82_exclude_tags", f"WITH {_TAGS} SELECT name, category FROM merged_tags WHERE NOT list_contains(coalesce(dictionaries, []), (SELECT min(title) FROM summaries))")
def _(spark, root):
    name = table(spark, root, "summaries").agg(F.min("title")).first()[0]
    return filters.exclude_tags(modes.merge_similar_tags(table(spark, root, "tags")), [name]).select("name", "category")


@query(
    "k83_redundant_tags",
    f"""WITH d AS (SELECT import_ord, dictionary, list_sort({_values_sql('definition_tags')}) AS t, expression, reading, sequence FROM terms)
    SELECT import_ord, coalesce(len(t) > 0 AND lag(dictionary) OVER w = dictionary AND lag(t) OVER w = t, false) AS redundant FROM d WINDOW w AS (PARTITION BY expression, reading, sequence ORDER BY import_ord)""",
)
def _(spark, root):
    rows = table(spark, root, "terms").select("import_ord", "dictionary", "expression", "reading", "sequence", packed.unpack("definition_tags").alias("t"))
    return filters.flag_redundant(rows, ["expression", "reading", "sequence"], ["import_ord"], "t").select("import_ord", "redundant")


@query(
    "k84_entry_rank",
    f"""WITH {ENTRIES}, g AS (SELECT query_id, expression AS term, norm_reading, max(score) AS score, min(dictionary_index) AS di, max(max_length) AS ml, count(*) AS n, max(CASE WHEN match_source = 'term' THEN 1 ELSE 0 END) AS ec, min(id) AS entry_id FROM e GROUP BY query_id, expression, norm_reading)
    SELECT query_id, entry_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ml DESC, ec DESC, di, score DESC, strlen(term) DESC NULLS LAST, term NULLS FIRST, n DESC, entry_id) AS INTEGER) AS entry_rank FROM g""",
)
def _(spark, root):
    rows = grouped(spark, root).entries.withColumn("frequency_order", F.lit(0))
    return rank.rank_entries(rank.chain_sizes(rows), ["query_id"]).select("query_id", "entry_id", "entry_rank")


@query("k85_definition_order", f"WITH {ENTRIES} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id, expression, norm_reading ORDER BY dictionary_index, score DESC, id) AS INTEGER) AS pos FROM e")
def _(spark, root):
    return rank.number_definitions(grouped(spark, root).definitions, ["entry_key"]).select("query_id", "id", "pos")


@query("k86_meta_order", f"WITH {EN}, {_PITCH} SELECT headword_id, meta_id, index, CAST(row_number() OVER (PARTITION BY headword_id ORDER BY dictionary_index, index, meta_id) AS INTEGER) AS meta_rank FROM p JOIN en ON name = meta_dictionary")
def _(spark, root):
    options = enabled(spark, root).select(F.col("name").alias("meta_dictionary"), "dictionary_index")
    rows = meta.pitches(heads(spark, root), metas(spark, root)).join(options, "meta_dictionary").withColumn("headword_index", F.lit(0))
    return rank.meta_order(rows, ["headword_id"]).select("headword_id", "meta_id", "index", "meta_rank")


@query("k87_by_definition_id", f"WITH {ENTRIES} SELECT query_id, id FROM e ORDER BY id")
def _(spark, root):
    return rank.by_definition_id(exact_entries(spark, root)).select("query_id", "id")


@query("k90_keys_by_length", "SELECT headword AS key, strlen(headword) AS bytes FROM headwords ORDER BY bytes DESC, key")
def _(spark, root):
    return rank.by_length(table(spark, root, "headwords").select(F.col("headword").alias("key"))).select("key", F.octet_length("key").cast("bigint").alias("bytes"))


@query("k93_source_keys", f"WITH {ENTRIES} SELECT query_id, key AS original, count(DISTINCT id) AS n_entries FROM e GROUP BY query_id, key")
def _(spark, root):
    rows = segment.source_keys(exact_entries(spark, root).withColumn("entry_id", F.col("id")), ["query_id"])
    return rows.select("query_id", "original", F.size("entry_ids").cast("bigint").alias("n_entries"))


@query("k95_segment_dedup", f"WITH {ENTRIES} SELECT expression AS term, id AS entry_id, min(query_id) AS query_id FROM e WHERE expression IS NOT NULL GROUP BY expression, id")
def _(spark, root):
    rows = exact_entries(spark, root).select("query_id", F.col("expression").alias("term"), F.col("id").alias("entry_id"))
    return segment.dedup_segments(rows, [], ["query_id"]).select("term", "entry_id", "query_id")


@query(
    "k17_notes",
    f"""WITH {ENTRIES}, d AS (SELECT query_id, expression, norm_reading, min(id) AS entry_id, arg_min(reading, id) AS reading, array_to_string(flatten(list(list_transform(list_filter(content, lambda g: g.plain_text IS NOT NULL), lambda g: g.plain_text) ORDER BY id)), '<br>') AS definition
      FROM e GROUP BY query_id, expression, norm_reading) SELECT query_id, entry_id, coalesce(expression, '') AS "Expression", coalesce(reading, '') AS "Reading", definition AS "Meaning", '' AS "Picture" FROM d""",
)
def _(spark, root):
    rows = grouped(spark, root).nested(pipeline.Lexicon.of(spark, root).with_glossary).withColumn("sentence", F.lit(""))
    return notes.notes(rows, {"term": "Expression", "reading": "Reading", "definition": "Meaning", "image": "Picture"}, ["query_id", "entry_id"])
