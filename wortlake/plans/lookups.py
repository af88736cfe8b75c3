"""Queries of storage, lookups and texts over the lexicon tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlake.functions import textproc
from wortlake.functions.textproc import Processor, Replacement
from wortlake.operators import deinflect, lookup, packed, substrings
from wortlake.plans.general import _values_sql
from wortlake.sources import store
from wortlake.sources.tables import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


# SQL shared by several queries. Everything is stated anew here, not derived from the DataFrame code.
LEX = "lex AS (SELECT * EXCLUDE _r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY import_ord DESC) AS _r FROM terms) WHERE _r = 1)"
EN = "en AS (SELECT *, row_number() OVER (ORDER BY ord, name) - 1 AS dictionary_index FROM dictionary_options WHERE enabled)"
WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LANG = "lower(regexp_extract(trim(lang, ' '), '^[^-_]*'))"


def lexicon(spark: SparkSession, root: str) -> DataFrame:
    return store.last_written(table(spark, root, "terms"), ["id"], ["import_ord"])


def keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "headwords").select(F.col("headword").alias("key"), F.col("headword_id").alias("key_ord"))


def enabled(spark: SparkSession, root: str) -> DataFrame:
    return lookup.enabled_map(table(spark, root, "dictionary_options"))


@query("k03_upsert_terms", f"WITH {LEX} SELECT id, import_ord, score FROM lex")
def _(spark, root):
    return lexicon(spark, root).select("id", "import_ord", "score")


@query("k04_upsert_metas", "SELECT id, term, mode, dictionary FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY term DESC, mode DESC, dictionary DESC) AS r FROM term_meta) WHERE r = 1")
def _(spark, root):
    return store.last_written(table(spark, root, "term_meta").select("id", "term", "mode", "dictionary"), ["id"], ["term", "mode", "dictionary"])


@query(
    "k05_upsert_kanji",
    "SELECT kanji_char, dictionary, onyomi, kunyomi FROM (SELECT *, row_number() OVER (PARTITION BY kanji_char, dictionary ORDER BY onyomi DESC NULLS LAST, kunyomi DESC NULLS LAST) AS r FROM kanji) WHERE r = 1",
)
def _(spark, root):
    return store.last_written(table(spark, root, "kanji").select("kanji_char", "dictionary", "onyomi", "kunyomi"), ["kanji_char", "dictionary"], ["onyomi", "kunyomi"])


@query("k05_upsert_tags", "SELECT id, name, dictionary, import_ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY import_ord DESC) AS r FROM tags) WHERE r = 1")
def _(spark, root):
    return store.last_written(table(spark, root, "tags"), ["id"], ["import_ord"]).select("id", "name", "dictionary", "import_ord")


@query(
    "k06_summary_counts",
    """SELECT dictionary, count(*) FILTER (kind = 'terms') AS n_terms, count(*) FILTER (kind = 'freq') AS n_freq, count(*) FILTER (kind = 'pitch') AS n_pitch,
      count(*) FILTER (kind = 'ipa') AS n_ipa, count(*) FILTER (kind = 'kanji') AS n_kanji, count(*) FILTER (kind = 'tag_meta') AS n_tag_meta
    FROM (SELECT dictionary, 'terms' AS kind FROM terms UNION ALL SELECT dictionary, mode FROM term_meta UNION ALL SELECT dictionary, 'kanji' FROM kanji UNION ALL SELECT dictionary, 'tag_meta' FROM tags)
    GROUP BY dictionary""",
)
def _(spark, root):
    return store.summarise(*(table(spark, root, t) for t in ("terms", "term_meta", "kanji", "tags")))


@query("k07_reversed_keys", "SELECT import_ord, list_aggregate(list_reverse(regexp_extract_all(expression, '(?s).')), 'string_agg', '') AS expression_reverse FROM terms WHERE expression <> ''")
def _(spark, root):
    return table(spark, root, "terms").where("expression <> ''").select("import_ord", F.reverse("expression").alias("expression_reverse"))


@query("k13_summaries_by_date", "SELECT title, revision, import_date, counts.terms AS declared_terms FROM summaries ORDER BY import_date, title")
def _(spark, root):
    return table(spark, root, "summaries").orderBy("import_date", "title").select("title", "revision", "import_date", F.col("counts.terms").alias("declared_terms"))


@query("k15_delete_dictionary", "SELECT import_ord, dictionary FROM terms WHERE dictionary IS NULL OR dictionary <> (SELECT min(title) FROM summaries)")
def _(spark, root):
    name = table(spark, root, "summaries").agg(F.min("title")).first()[0]
    return store.delete_dictionary(table(spark, root, "terms"), name).select("import_ord", "dictionary")


def _hits_sql(condition: str) -> str:
    return f"""WITH {LEX}, hits AS (SELECT l.*, h.headword AS key, h.headword_id AS key_ord FROM lex l JOIN headwords h ON {condition.format(f='expression')}
      UNION ALL SELECT l.*, h.headword, h.headword_id FROM lex l JOIN headwords h ON {condition.format(f='reading')}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY key_ord) AS r FROM hits) WHERE r = 1)
    SELECT id, key, key_ord, CASE WHEN contains(expression, key) THEN 'term' ELSE 'reading' END AS match_source,
      CASE WHEN CASE WHEN contains(expression, key) THEN expression ELSE reading END = key THEN 'exact' ELSE '%s' END AS match_type FROM best"""


_HIT = ("id", "key", "key_ord", "match_source", "match_type")


@query("k20_exact_lookup", _hits_sql("l.{f} = h.headword") % "exact")
def _(spark, root):
    return lookup.bulk_lookup(lexicon(spark, root), keys(spark, root)).select(*_HIT)


@query("k21_prefix_lookup", _hits_sql("left(l.{f}, length(h.headword)) = h.headword") % "prefix")
def _(spark, root):
    return lookup.prefix_lookup(lexicon(spark, root), keys(spark, root)).select(*_HIT)


@query("k21_prefix_observed", _hits_sql("l.{f} = h.headword") % "prefix")
def _(spark, root):
    """What the equality candidates of the original leave of a prefix lookup: full matches only."""
    return lookup.bulk_lookup(lexicon(spark, root), keys(spark, root), kind="prefix").select(*_HIT)


@query("k22_suffix_lookup", _hits_sql("right(l.{f}, length(h.headword)) = h.headword") % "suffix")
def _(spark, root):
    return lookup.prefix_lookup(lexicon(spark, root), keys(spark, root), suffix=True).select(*_HIT)


@query("k22_suffix_observed", _hits_sql("l.{f} = h.headword") % "suffix")
def _(spark, root):
    """Reversed keys against reversed columns for equality: the same rows as the exact lookup."""
    terms = lexicon(spark, root).withColumns({"_e": F.reverse("expression"), "_r": F.reverse("reading")}).withColumns({"expression": F.col("_e"), "reading": F.col("_r")})
    reversed_keys = keys(spark, root).withColumn("key", F.reverse("key"))
    return lookup.bulk_lookup(terms, reversed_keys, kind="suffix").select("id", F.reverse("key").alias("key"), "key_ord", "match_source", "match_type")


@query("k23_match_attribution", f"WITH q AS ({_hits_sql('left(l.{f}, length(h.headword)) = h.headword') % 'prefix'}) SELECT match_source, match_type, count(*) AS n FROM q GROUP BY ALL")
def _(spark, root):
    return lookup.prefix_lookup(lexicon(spark, root), keys(spark, root)).groupBy("match_source", "match_type").agg(F.count("*").alias("n"))


@query(
    "k24_pair_lookup",
    "SELECT h.headword_id AS req_ord, t.import_ord, t.dictionary FROM terms t JOIN headwords h ON t.expression = h.headword AND t.reading = h.reading WHERE t.dictionary IN (SELECT name FROM dictionary_options WHERE enabled)",
)
def _(spark, root):
    pairs = table(spark, root, "headwords").select(F.col("headword_id").alias("req_ord"), F.col("headword").alias("term"), F.col("reading").alias("req_reading"))
    return lookup.pair_lookup(table(spark, root, "terms"), pairs, enabled(spark, root)).select("req_ord", "import_ord", "dictionary")


@query(
    "k25_sequence_lookup",
    """WITH req AS (SELECT DISTINCT t.sequence, t.dictionary FROM terms t JOIN headwords h ON t.expression = h.headword AND t.reading = h.reading)
    SELECT t.import_ord, t.sequence, t.dictionary, 'sequence' AS match_source FROM terms t JOIN req r ON t.sequence = r.sequence AND t.dictionary = r.dictionary""",
)
def _(spark, root):
    terms = table(spark, root, "terms").select("import_ord", "expression", "reading", "sequence", "dictionary")
    pairs = table(spark, root, "headwords").select(F.col("headword").alias("expression"), "reading")
    requests = terms.join(pairs, ["expression", "reading"]).select(F.col("sequence").alias("req_sequence"), F.col("dictionary").alias("req_dictionary")).distinct()
    return lookup.sequence_lookup(terms, requests).select("import_ord", "sequence", "dictionary", "match_source")


@query("k26_meta_lookup", "SELECT m.id, h.headword_id AS key_ord, m.mode, m.dictionary FROM term_meta m JOIN headwords h ON m.term = h.headword WHERE m.dictionary IN (SELECT name FROM dictionary_options WHERE enabled)")
def _(spark, root):
    return lookup.meta_lookup(table(spark, root, "term_meta"), keys(spark, root), enabled(spark, root)).select("id", "key_ord", "mode", "dictionary")


_NAMES = f"names AS (SELECT DISTINCT split_part(v, ':', 1) AS req_name, dictionary AS req_dictionary FROM (SELECT dictionary, unnest({_values_sql('definition_tags')}) AS v FROM terms))"


def tag_names(spark: SparkSession, root: str) -> DataFrame:
    values = table(spark, root, "terms").select(F.col("dictionary").alias("req_dictionary"), F.explode(packed.unpack("definition_tags")).alias("v"))
    return values.select(textproc.base_name(F.col("v")).alias("req_name"), "req_dictionary").distinct()


@query(
    "k27_tag_lookup",
    f"""WITH {_NAMES}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, dictionary ORDER BY import_ord) AS r FROM tags) WHERE r = 1)
    SELECT req_name, req_dictionary, category, tag_order, notes, score FROM names LEFT JOIN first ON name = req_name AND dictionary = req_dictionary""",
)
def _(spark, root):
    return lookup.tag_lookup(table(spark, root, "tags"), tag_names(spark, root))


@query("k28_enabled_members", "SELECT import_ord, dictionary FROM terms WHERE dictionary IN (SELECT name FROM dictionary_options WHERE enabled)")
def _(spark, root):
    return lookup.members(table(spark, root, "terms").select("import_ord", "dictionary"), enabled(spark, root))


@query("k29_enabled_map", f"WITH {EN} SELECT name, alias, CAST(dictionary_index AS INTEGER) AS dictionary_index, use_deinflections, parts_of_speech_filter FROM en")
def _(spark, root):
    return enabled(spark, root).select("name", "alias", "dictionary_index", "use_deinflections", "parts_of_speech_filter")


@query("k30_secondary_dictionaries", f"WITH {EN} SELECT name, CAST(dictionary_index AS INTEGER) AS dictionary_index FROM en WHERE allow_secondary_searches")
def _(spark, root):
    return lookup.secondary(enabled(spark, root)).select("name", "dictionary_index")


@query(
    "k31_alias_and_index",
    f"""WITH {EN} SELECT d.dictionary, coalesce(nullif(alias, ''), d.dictionary) AS alias, CAST(coalesce(dictionary_index, (SELECT count(*) FROM en)) AS BIGINT) AS dictionary_index
    FROM (SELECT DISTINCT dictionary FROM terms) d LEFT JOIN en ON name = d.dictionary""",
)
def _(spark, root):
    return lookup.with_dictionary(table(spark, root, "terms").select("dictionary").distinct(), enabled(spark, root)).withColumn("dictionary_index", F.col("dictionary_index").cast("bigint"))


@query("k32_every_start", f"SELECT doc_id, length(text) AS n_starts, CAST(length(text) AS HUGEINT) * (length(text) + 1) // 2 AS sum_starts FROM documents WHERE text <> '' AND {LANG} IN ('ja', 'zh', 'ko')")
def _(spark, root):
    documents = table(spark, root, "documents").where((F.col("text") != "") & substrings.is_unspaced("lang"))
    starts = documents.select("doc_id", F.explode(substrings.every_start(F.col("text"))).alias("start"))
    return starts.groupBy("doc_id").agg(F.count("*").alias("n_starts"), F.sum("start").alias("sum_starts"))


@query("k33_word_starts", f"SELECT doc_id, len(regexp_extract_all(text, '[^{WS}]+')) AS n_starts, length(text) - length(regexp_extract(text, '[^{WS}]+[{WS}]*$')) + 1 AS last_start FROM documents WHERE regexp_matches(text, '[^{WS}]')")
def _(spark, root):
    documents = table(spark, root, "documents").where(F.col("text").isNotNull())
    starts = documents.select("doc_id", F.explode(substrings.word_starts(F.col("text"))).alias("start"))
    return starts.groupBy("doc_id").agg(F.count("*").alias("n_starts"), F.max("start").alias("last_start"))


@query("k34_letter_substrings", "SELECT headword_id, CAST(n AS INTEGER) AS n, left(headword, n) AS sub FROM (SELECT headword_id, headword, unnest(range(1, length(headword) + 1)) AS n FROM headwords)")
def _(spark, root):
    rows = table(spark, root, "headwords").select("headword_id", F.explode(substrings.letter_substrings(F.col("headword"))).alias("sub"))
    return rows.select("headword_id", F.length("sub").alias("n"), "sub")


@query(
    "k35_word_substrings",
    r"""WITH RECURSIVE t AS (SELECT DISTINCT expression AS text, expression AS sub FROM terms WHERE expression <> ''
      UNION ALL SELECT text, regexp_replace(sub, '[^\p{L}][\p{L}\p{N}]*$', '') FROM t WHERE regexp_matches(sub, '[^\p{L}][\p{L}\p{N}]*$') AND regexp_replace(sub, '[^\p{L}][\p{L}\p{N}]*$', '') <> '')
    SELECT text, sub FROM t""",
)
def _(spark, root):
    texts = table(spark, root, "terms").select(F.col("expression").alias("text")).distinct()
    return texts.select("text", F.explode(substrings.word_substrings(F.col("text"))).alias("sub"))


@query("k36_cjk_prefix", r"SELECT doc_id, regexp_extract(text, '^[\p{Han}\p{Hiragana}\p{Katakana}ー々〆〇・、。「」『』【】〜！？]*') AS prefix FROM documents WHERE text IS NOT NULL")
def _(spark, root):
    return table(spark, root, "documents").where(F.col("text").isNotNull()).select("doc_id", substrings.cjk_prefix("text").alias("prefix"))


_ANCHORS = "a AS (SELECT doc_id, text, strpos(text, headword) AS s, length(headword) AS n FROM documents JOIN headwords USING (headword_id) WHERE strpos(text, headword) > 0)"


def anchors(spark: SparkSession, root: str) -> DataFrame:
    heads = table(spark, root, "headwords").select("headword_id", "headword")
    joined = table(spark, root, "documents").select("doc_id", "text", "lang", "headword_id").join(heads, "headword_id")
    return joined.withColumns({"start": F.expr("locate(headword, text)"), "size": F.length("headword")}).where("start > 0")


@query("k37_scan_window", f"WITH {_ANCHORS} SELECT doc_id, substr(text, s, 20) AS scanned FROM a")
def _(spark, root):
    return anchors(spark, root).select("doc_id", substrings.window(F.col("text"), F.col("start")).alias("scanned"))


@query(
    "k38_sentence_around",
    rf"""WITH {_ANCHORS}, p AS (SELECT doc_id, regexp_extract(substr(text, greatest(s - 50, 1), s - greatest(s - 50, 1)), '[^.!?。？！\n]*$') AS l, substr(text, s, n) AS w,
      regexp_extract(substr(text, s + n, 50), '^[^.!?。？！\n]*[.!?。？！\n]?') AS r FROM a)
    SELECT doc_id, regexp_replace(l || w || r, '^[ \t\n\x{{0B}}\f\r]+|[ \t\n\x{{0B}}\f\r]+$', '', 'g') AS sentence, CAST(length(regexp_replace(l, '^[ \t\n\x{{0B}}\f\r]+', '')) AS INTEGER) AS anchor FROM p""",
)
def _(spark, root):
    around = anchors(spark, root).select("doc_id", substrings.sentence_around(F.col("text"), F.col("start"), F.col("size")).alias("s"))
    return around.select("doc_id", F.col("s.text").alias("sentence"), F.col("s.offset").alias("anchor"))


GROUPS = [[Replacement("ß", "ss"), Replacement("([aeo])ff", "$1f")], [Replacement("(", "broken"), Replacement("SH", "<$&>", ignore_case=True)], [Replacement("(?<vowel>[aeiou])(l)", "$<vowel>$9-$2$<none>")], [Replacement("x", "[$`]")]]


@query("k41_replacement_groups", r"""SELECT headword_id, g, CASE g WHEN 0 THEN headword WHEN 1 THEN regexp_replace(replace(headword, 'ß', 'ss'), '([aeo])ff', '\1f', 'g') WHEN 2 THEN regexp_replace(headword, '(?i)SH', '<\0>', 'g') WHEN 3 THEN regexp_replace(headword, '([aeiou])(l)', '\1$9-\2$<none>', 'g')
  ELSE array_to_string(list_transform(range(1, length(headword) + 1), lambda i: CASE WHEN substr(headword, i, 1) = 'x' THEN '[' || left(headword, i - 1) || ']' ELSE substr(headword, i, 1) END), '') END AS text FROM headwords, (SELECT unnest([0, 1, 2, 3, 4]) AS g)""")
def _(spark, root):
    groups = textproc.compile_groups(GROUPS)
    texts = F.array(*(F.struct(F.lit(i).alias("g"), textproc.replace_all(F.col("headword"), g).alias("text")) for i, g in enumerate(groups)))
    return table(spark, root, "headwords").select("headword_id", F.inline(texts))


@query("k42_template_context", """SELECT headword_id, array_to_string(list_transform(range(1, length(headword) + 1), lambda i: CASE WHEN regexp_matches(substr(headword, i, 1), '[aeiouаеиоу]')
  THEN '<' || left(headword, i - 1) || '|' || substr(headword, i, 1) || '|' || substr(headword, i + 1) || '>' ELSE substr(headword, i, 1) END), '') AS text FROM headwords""")
def _(spark, root):
    return table(spark, root, "headwords").select("headword_id", textproc.expand_context("headword", "[aeiouаеиоу]", "<$`|$&|$'>").alias("text"))


@query(
    "k43_text_variants",
    """WITH s AS (SELECT DISTINCT expression AS text FROM terms WHERE expression IS NOT NULL),
    r AS (SELECT text, text AS v, '' AS c FROM s UNION SELECT text, replace(text, 'ß', 'ss'), CASE WHEN contains(text, 'ß') THEN 'Text Replacement 1' ELSE '' END FROM s),
    l AS (SELECT * FROM r UNION SELECT text, lower(v), CASE WHEN lower(v) = v THEN c ELSE trim(c || '+decapitalize', '+') END FROM r)
    SELECT text, v AS variant, string_agg(c, '|' ORDER BY c) AS chains FROM l GROUP BY text, v""",
)
def _(spark, root):
    texts = table(spark, root, "terms").select(F.col("expression").alias("text")).distinct()
    made = textproc.variants(texts, "text", textproc.compile_groups([[Replacement("ß", "ss")]]), [Processor("decapitalize", {"on": F.lower})], [])
    return made.select("text", "variant", F.array_join(F.array_sort(F.transform("chains", lambda c: F.array_join(c, "+"))), "|").alias("chains"))


@query("k45_normalized_reading", "SELECT DISTINCT reading, translate(reading, '" + textproc._KATAKANA + "', '" + textproc._HIRAGANA + "') AS normalized FROM terms WHERE reading IS NOT NULL")
def _(spark, root):
    return table(spark, root, "terms").where("reading IS NOT NULL").select("reading", textproc.normalize_reading(F.col("reading"), language="ja").alias("normalized")).distinct()


@query("k46_tag_base_names", f"WITH {_NAMES} SELECT DISTINCT req_name AS base FROM names")
def _(spark, root):
    return tag_names(spark, root).select(F.col("req_name").alias("base")).distinct()


@query("k47_split_list", "SELECT import_ord, len(list_filter(string_split(coalesce(rules, ''), ' '), lambda x: x <> '')) AS n, array_to_string(list_filter(string_split(coalesce(rules, ''), ' '), lambda x: x <> ''), '/') AS joined FROM terms")
def _(spark, root):
    parts = table(spark, root, "terms").select("import_ord", textproc.split_list("rules").alias("p"))
    return parts.select("import_ord", F.size("p").cast("bigint").alias("n"), F.array_join("p", "/").alias("joined"))


@query("k47_display_number", rf"SELECT id, freq.display_value AS shown, TRY_CAST(nullif(regexp_extract(freq.display_value, '{textproc.NUMBER}'), '') AS DOUBLE) AS number FROM term_meta WHERE mode = 'freq'")
def _(spark, root):
    return table(spark, root, "term_meta").where("mode = 'freq'").select("id", F.col("freq.display_value").alias("shown"), textproc.parsed_number("freq.display_value").alias("number"))


_RULES = ", ".join(f"('{i}', '{lang}', '{a}', '{b}', {ci}, {co})" for i, lang, a, b, ci, co, _ in deinflect.RULES)
WORDS = f"words AS (SELECT DISTINCT lang, word FROM (SELECT {LANG} AS lang, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL))"
DEINFLECTED = f"""rules(rid, rlang, a, b, ci, co) AS (VALUES {_RULES}), {WORDS},
  deinflected AS (SELECT lang, word, word AS text, CAST(0 AS BIGINT) AS cond, '' AS chain FROM words
    UNION ALL SELECT lang, word, left(text, length(text) - length(a)) || b, CAST(co AS BIGINT), rid || CASE WHEN chain = '' THEN '' ELSE '<' || chain END
    FROM deinflected JOIN rules ON rlang = lang AND suffix(text, a) WHERE (chain = '' OR (cond & ci) <> 0) AND length(text) + length(b) > length(a))"""


def words(spark: SparkSession, root: str) -> DataFrame:
    """The distinct words of all documents by language."""
    documents = table(spark, root, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    return documents.select(textproc.base_language("lang").alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()


def deinflected_words(spark: SparkSession, root: str) -> DataFrame:
    found = deinflect.as_candidates(words(spark, root), "word", ["lang"])
    return deinflect.deinflections(found, "lang")


@query("k48_deinflect", f"WITH RECURSIVE {DEINFLECTED} SELECT lang, word, text, cond AS conditions, chain FROM deinflected")
def _(spark, root):
    return deinflected_words(spark, root).select("lang", F.col("original").alias("word"), F.col("deinflected").alias("text"), "conditions", F.array_join("rules", "<").alias("chain"))


@query("k49_no_deinflect", f"WITH {WORDS} SELECT lang, word AS text, CAST(0 AS BIGINT) AS conditions FROM words")
def _(spark, root):
    return deinflect.as_candidates(words(spark, root), "word", ["lang"]).select("lang", F.col("deinflected").alias("text"), "conditions")


_FLAGS = " | ".join(f"CASE WHEN list_contains(r, '{k}') THEN {v} ELSE 0 END" for k, v in deinflect.CONDITIONS.items())
_POS = f"""t AS (SELECT DISTINCT expression, dictionary, flags, pos FROM (SELECT expression, dictionary, ({_FLAGS}) AS flags, coalesce(parts_of_speech_filter, false) AS pos
  FROM (SELECT expression, dictionary, {_values_sql("rules")} AS r FROM terms) JOIN dictionary_options ON name = dictionary AND enabled))"""


@query(
    "k51_pos_filter",
    f"WITH RECURSIVE {DEINFLECTED}, {_POS} SELECT lang, word, chain, t.dictionary, count(*) AS n FROM deinflected d JOIN t ON t.expression = d.text WHERE NOT pos OR cond = 0 OR (cond & CAST(flags AS BIGINT)) <> 0 GROUP BY ALL",
)
def _(spark, root):
    options = enabled(spark, root).select(F.col("name").alias("dictionary"), "parts_of_speech_filter")
    terms = table(spark, root, "terms").join(options, "dictionary").select("expression", "dictionary", deinflect.rule_flags(packed.unpack("rules")).alias("flags"), "parts_of_speech_filter").distinct()
    hits = deinflected_words(spark, root).join(terms, F.col("deinflected") == F.col("expression"))
    kept = hits.where(deinflect.passes_pos(F.col("conditions"), F.col("flags"), F.col("parts_of_speech_filter")))
    return kept.groupBy("lang", F.col("original").alias("word"), F.array_join("rules", "<").alias("chain"), "dictionary").agg(F.count("*").alias("n"))


@query(
    "k52_dictionary_hop",
    """WITH keyed AS (SELECT import_ord, expression AS key FROM terms WHERE expression <> '' UNION SELECT import_ord, reading FROM terms WHERE reading <> ''),
    said AS (SELECT DISTINCT k.key, g.form_of AS form_of, array_to_string(coalesce(g.rules, []), '+') AS rules FROM (SELECT import_ord, unnest(glossary) AS g FROM terms) f JOIN keyed k ON k.import_ord = f.import_ord WHERE g.kind = 'Deinflection' AND g.form_of <> '')
    SELECT s.key, s.rules, count(*) AS n_reached FROM said s JOIN keyed k ON k.key = s.form_of GROUP BY s.key, s.rules""",
)
def _(spark, root):
    """The rows that each key reaches by what a glossary says it is a form of."""
    terms = table(spark, root, "terms").select("import_ord", "expression", "reading", F.arrays_zip("glossary.kind", "glossary.form_of", "glossary.rules").cast(deinflect.FORMS).alias("forms"))
    keyed = deinflect.keyed_lexicon(terms.withColumns({"flags": F.lit(0).cast("bigint"), "parts_of_speech_filter": F.lit(False), "use_deinflections": F.lit(True)}))
    return keyed.where("hop IS NOT NULL").groupBy("key", F.array_join("hop", "+").alias("rules")).agg(F.count("*").alias("n_reached"))


@query("k53_only_content", "SELECT import_ord, len(list_filter(glossary, lambda g: g.kind = 'Content')) AS n_content FROM terms WHERE len(list_filter(glossary, lambda g: g.kind = 'Content')) > 0")
def _(spark, root):
    return deinflect.only_content(table(spark, root, "terms").select("import_ord", "glossary")).select("import_ord", F.size("glossary").cast("bigint").alias("n_content"))


@query("k54_display_rules", "WITH RECURSIVE shown(rid, d) AS (VALUES " + ", ".join(f"('{r[0]}', '{r[6]}')" for r in deinflect.RULES) + f"), {DEINFLECTED}, c AS (SELECT DISTINCT chain FROM deinflected), s AS (SELECT chain, string_split(chain, '<') AS ids, unnest(range(1, len(string_split(chain, '<')) + 1)) AS i FROM c) SELECT chain, coalesce(string_agg(d, '<' ORDER BY i), '') AS display FROM s LEFT JOIN shown ON rid = ids[i] GROUP BY chain")
def _(spark, root):
    return deinflected_words(spark, root).select("rules").distinct().select(F.array_join("rules", "<").alias("chain"), F.array_join(deinflect.display_rules(F.col("rules")), "<").alias("display")).distinct()
