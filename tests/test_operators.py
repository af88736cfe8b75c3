import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from wortlake.functions import textproc
from wortlake.functions.textproc import Processor, Replacement
from wortlake.operators import deinflect, entries, filters, lookup, modes, notes, rank, segment, substrings
from wortlake.options import CardTarget, DictionaryOptions, EngineError, LookupOptions, Profile, ProfileError, Settings, StoreError, sort_order
from wortlake.plans import pipeline
from wortlake.sources import archive, store


def one(spark, column, **values):
    names = {k: "string" if isinstance(v, str) or v is None else "int" for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in names.items())).select(column.alias("x")).first().x


def test_substrings(spark):
    assert one(spark, substrings.letter_substrings(F.col("t")), t="abcd") == ["abcd", "abc", "ab", "a"]
    assert one(spark, substrings.letter_substrings(F.col("t"), 2), t="日本語") == ["日本", "日"]
    assert one(spark, substrings.word_substrings(F.col("t")), t="A big x1 dog") == ["A big x1 dog", "A big x1", "A big", "A"]
    assert one(spark, substrings.word_substrings(F.col("t")), t="") == [] and one(spark, substrings.letter_substrings(F.col("t")), t=None) == []
    assert one(spark, substrings.word_starts(F.col("t")), t=" ab  c\nd　e") == [2, 6, 8, 10]
    assert one(spark, substrings.every_start(F.col("t")), t="a😀b") == [1, 2, 3]
    assert one(spark, substrings.cjk_prefix("t"), t="今勉強中ですok") == "今勉強中です"
    assert one(spark, substrings.window(F.col("t"), F.lit(3), 2), t="abcdef") == "cd" and one(spark, substrings.window(F.col("t"), F.lit(9), 2), t="abc") == ""
    text = "One. Two is here! Three"
    assert tuple(one(spark, substrings.sentence_around(F.col("t"), F.lit(6), F.lit(3)), t=text)) == ("Two is here!", 0)
    assert tuple(one(spark, substrings.sentence_around(F.col("t"), F.lit(3), F.lit(1)), t="a\nb c")) == ("b c", 0)


def test_suffixes(spark):
    df = spark.createDataFrame([(1, "ab cd", "en-x"), (2, "日本", "ja"), (3, None, "en"), (4, "", "ja"), (5, " x", None)], "i int, t string, l string")
    got = sorted(tuple(r) for r in substrings.suffixes(df, "t", "l", ["i"], 3).collect())
    assert got == [(1, 1, "ab "), (1, 4, "cd"), (2, 1, "日本"), (2, 2, "本"), (5, 2, "x")]


def test_long_text_is_linear(spark):
    df = spark.createDataFrame([(1, "word " * 30_000, "en")], "i int, t string, l string")
    assert substrings.suffixes(df, "t", "l", ["i"], 20).count() == 30_000


def test_templates(spark):
    assert textproc.java_template("$& $$ $1 $<n> \\", 1, frozenset({"n"})) == "$0 \\$ $1 ${n} \\\\"
    replaced = lambda pattern, template, text, fold=False: one(spark, textproc.replace_all(F.col("t"), [Replacement(pattern, template, fold)]), t=text)
    assert replaced("(?<x>a)b", "[$<x>|$<y>]", "cab") == "c[a|$<y>]" == replaced("(?P<x>a)b", "[$<x>|$<y>]", "cab")
    assert replaced("(a)", "<$9>", "a") == "<$9>" and replaced("(a)", "$12", "a") == "$12" and replaced("(a)", "$01", "a") == "a" and replaced("(a)", "$1\\", "a") == "a\\" and replaced("(a)", "$0", "a") == "$0"
    assert replaced("(?<x>A)", "[$`|$'|$<x>|$2]", "bac", True) == "b[b|c|a|$2]c" and replaced("(a)" + "(b)" * 10, "$113", "a" + "b" * 10) == "b3"
    assert one(spark, textproc.replace_all(F.col("t"), [Replacement("(B)", "[$&$1$$]", True)]), t="abc") == "a[bb$]c"
    assert one(spark, textproc.expand_context("t", "b", "<$`|$&|$'|$$>"), t="abc") == "a<a|b|c|$>c"
    assert textproc.compile_groups([[Replacement("(", "x")], []]) == [] and textproc.compile_groups([], search_original=True) == [None]
    assert textproc.compile_groups([[Replacement("a", "b")]]) == [None, [Replacement("a", "b")]]


def test_variants(spark):
    df = spark.createDataFrame([("Aß",), (None,), ("x",)], "t string")
    made = textproc.variants(df, "t", textproc.compile_groups([[Replacement("ß", "ss")]]), [Processor("low", {"on": F.lower})], [])
    got = {(r.t, r.variant): r.chains for r in made.collect()}
    assert got[("Aß", "ass")] == [["Text Replacement 1", "low"]] and got[("Aß", "Aß")] == [[]] and got[("x", "x")] == [[]] and len(got) == 5
    crossed = textproc.cross_chains(F.array(F.array(F.lit("a")), F.array(F.lit("b"))), F.array(F.array(F.lit("c"))))
    assert one(spark, crossed, t="") == [["a", "c"], ["b", "c"]]


def naive_deinflect(word, lang):
    out, level = set(), {(word, 0, ())}
    while level:
        out |= level
        level = {
            (text[: len(text) - len(given)] + left, cond_out, (rule_id, *ids))
            for text, cond, ids in level
            for rule_id, rule_lang, given, left, cond_in, cond_out, _ in deinflect.RULES
            if rule_lang == lang and text.endswith(given) and (not ids or cond & cond_in) and text[: len(text) - len(given)] + left
        }
    return out


def test_deinflect_equals_step_by_step(spark):
    draw = random.Random(2)
    words = {("".join(draw.choice(["a", "s", "es", "ed", "ing", "ly", "た", "ない", "なくて", "る", "くて", "食べ", "て", "いる"]) for _ in range(draw.randrange(1, 5))), draw.choice(["en", "ja", "xx"])) for _ in range(150)}
    words |= {("hablándomelo", "es"), ("занимавшийся", "ru"), ("schönsten", "de"), ("parlerions", "fr"), ("書かせられていませんでした", "ja")}
    df = deinflect.as_candidates(spark.createDataFrame(sorted(words), "w string, lang string"), "w", ["lang"])
    got = {(r.original, r.lang, r.deinflected, r.conditions, tuple(r.rules)) for r in deinflect.deinflections(df, "lang").collect()}
    assert got == {(w, lang, *x) for w, lang in words for x in naive_deinflect(w, lang)}


def test_known_inflections():
    bases = {("works", "en"): "work", ("happinesses", "en"): "happy", ("stopped", "en"): "stop", ("häuser", "de"): "häus", ("sagtest", "de"): "sagen", ("luces", "es"): "luz", ("comiendo", "es"): "comer", ("chevaux", "fr"): "cheval", ("finissons", "fr"): "finir",
             ("книгами", "ru"): "книга", ("занимался", "ru"): "занимать", ("食べさせられなかった", "ja"): "食べる", ("書いています", "ja"): "書く", ("高くない", "ja"): "高い", ("勉強しました", "ja"): "勉強する"}
    chains = deinflect._chains(deinflect.RULES)
    for (word, lang), base in bases.items():
        assert base in {text for text, _, _ in chains(word, lang)}, word
    assert not any(ids for _, _, ids in chains("works", None))


def test_endless_rules_are_refused():
    loop = [("a", "en", "x", "y", 1, 1, ""), ("b", "en", "y", "x", 1, 1, "")]
    for rules in ([("grow", "en", "a", "aa", 1, 1, "")], loop, [("empty", "en", "", "x", 0, 1, "")], [("none", "en", "x", "", 0, 0, "")]):
        with pytest.raises(ValueError):
            deinflect.check_rules(rules)
    deinflect.check_rules([("grow once", "en", "a", "aa", 0, 1, ""), ("shrink", "en", "bb", "b", 1, 1, "")])


def test_pos_filter_and_hop(spark):
    assert one(spark, deinflect.passes_pos(F.lit(1), F.lit(2), F.lit(True)), t="") is False and one(spark, deinflect.passes_pos(F.lit(1), F.lit(2), F.lit(None).cast("boolean")), t="") is True
    schema = "id string, expression string, reading string, flags bigint, parts_of_speech_filter boolean, use_deinflections boolean, glossary array<struct<kind:string,plain_text:string,html:string,form_of:string,rules:array<string>>>"
    rows = [("a", "went", None, 2, False, True, [("Deinflection", None, None, "go", ["past"])]), ("b", "go", "go", 2, True, True, [("Content", "to go", None, None, None)])]
    got = {(r.id, r.key, None if r.hop is None else tuple(r.hop)) for r in deinflect.keyed_lexicon(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "went", None), ("b", "go", None), ("b", "went", ("past",))}


LEX = "import_ord bigint, id string, expression string, reading string"


def test_lookup_first_match_wins(spark):
    lexicon = spark.createDataFrame([(1, "a", "two", "one"), (2, "b", None, "one"), (3, "c", "twofold", "x"), (4, "a", "two", "one")], LEX)
    keys = spark.createDataFrame([("one", 1), ("two", 2), ("", 3), (None, 4), ("two", 0)], "key string, key_ord int")
    got = {r.id: (r.key, r.match_source, r.match_type, r.import_ord) for r in lookup.bulk_lookup(lexicon, keys).collect()}
    assert got == {"a": ("two", "term", "exact", 4), "b": ("one", "reading", "exact", 2)}
    got = {r.id: (r.key, r.match_type) for r in lookup.prefix_lookup(lexicon, keys).collect()}
    assert got == {"a": ("two", "exact"), "b": ("one", "exact"), "c": ("two", "prefix")}
    assert lookup.prefix_lookup(lexicon, keys.limit(0)).count() == 0 and lookup.bulk_lookup(lexicon.limit(0), keys).count() == 0


def test_many_keys(spark):
    lexicon = spark.createDataFrame([(1, "a", "k94", "r")], LEX)
    keys = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "key string, key_ord int")
    assert [r.key_ord for r in lookup.bulk_lookup(lexicon, keys).collect()] == [94]


def test_enabled_rank(spark):
    options = spark.createDataFrame([("A", "", True, True, 1), ("B", "", False, True, 2), ("C", "see", True, False, 3)], "name string, alias string, enabled boolean, allow_secondary_searches boolean, ord int")
    known = lookup.enabled_map(options)
    assert {r.name: r.dictionary_index for r in known.collect()} == {"A": 0, "C": 1}
    rows = lookup.with_dictionary(spark.createDataFrame([("A",), ("C",), ("Z",), (None,)], "dictionary string"), known)
    assert {(r.dictionary, r.alias, r.dictionary_index) for r in rows.collect()} == {("A", "A", 0), ("C", "see", 1), ("Z", "Z", 2), (None, None, 2)}


def naive_segments(text, keys):
    out, at = [], 0
    while at < len(text):
        size = max((len(k) for k in keys if k and text.startswith(k, at)), default=0)
        out.append((text[at : at + (size or 1)], size > 0))
        at += size or 1
    return out


def test_longest_match(spark):
    draw = random.Random(4)
    texts = [("今勉強中です", ["今", "勉強", "勉強中"]), ("a.b\\E*c\n", [".b", "\\E", "*"])] + [
        ("".join(draw.choice("ab.日😀") for _ in range(30)), ["".join(draw.choice("ab.日😀") for _ in range(draw.randrange(1, 4))) for _ in range(6)]) for _ in range(40)
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(99, "no keys")], "q int, text string")
    keys = spark.createDataFrame([(i, k) for i, (_, ks) in enumerate(texts) for k in ks], "q int, original string")
    got = {}
    for r in segment.longest_match(df, keys, ["q"]).orderBy("q", "seg_pos").collect():
        got.setdefault(r.q, []).append((r.segment, r.matched))
    assert got == {i: naive_segments(t, ks) for i, (t, ks) in enumerate(texts)}
    short = {}
    for r in segment.longest_match_regex(df, keys, ["q"]).orderBy("q", "seg_pos").collect():
        short.setdefault(r.q, []).append(r.segment)
    assert short == {i: [s for s, _ in naive_segments(t, ks)] for i, (t, ks) in enumerate(texts)}


def test_keep_longest_and_chains(spark):
    rows = [("q", "1", "abc", "abc", ["r"], "algorithm", ["x"]), ("q", "1", "abc", "abc", ["r"], "dictionary", ["y"]), ("q", "1", "ab", "ab", ["z"], "algorithm", [])]
    df = spark.createDataFrame(rows, "q string, id string, transformed string, original string, rules array<string>, source string, text_chain array<string>").withColumn("deinflected", F.col("original"))
    (r,) = entries.keep_longest(df, ["q"]).collect()
    assert [tuple(i) for i in r.inflections] == [("both", ["r"])] and r.text_chains == [["x"], ["y"]] and r.original == "abc"
    assert one(spark, entries.same_elements(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))), t="") is True
    assert one(spark, entries.shortest_chain(F.array(F.array(F.lit("a")), F.array())), t="") == 0
    assert one(spark, entries.shortest_chain(F.array().cast("array<array<string>>")), t="") == 0


def test_bytes_order(spark):
    heads = F.array(F.struct(F.lit("abcd").alias("term")), F.struct(F.lit("日本").alias("term")))
    assert [h.term for h in one(spark, rank.sort_headwords(heads), t="")] == ["日本", "abcd"]


def test_tag_merge(spark):
    tags = spark.createDataFrame([("n", "pos", 3, 2, "A", "x"), ("n", "pos", 1, 7, "B", "x"), ("n", "pos", 2, 1, "A", "")], "name string, category string, tag_order bigint, score bigint, dictionary string, notes string")
    (r,) = modes.merge_similar_tags(tags).collect()
    assert (r.tag_order, r.score, r.dictionaries, r.content) == (1, 7, ["A", "B"], ["x"])
    assert filters.exclude_tags(modes.merge_similar_tags(tags), ["B"]).count() == 0


def test_last_written(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, import_ord int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("c", 3, "z"), ("c", 4, "zz")], "id string, import_ord int, v string")
    assert {r.id: r.v for r in store.upsert(old, new, ["id"]).collect()} == {"a": "new", "b": "y", "c": "zz"}
    assert {r.id for r in store.delete_dictionary(old.withColumnRenamed("v", "dictionary"), "x").collect()} == {"b"}


def test_auto_exclude():
    assert filters.auto_excluded("m", ["a"]) == (["a", "m"], ["m"]) and filters.auto_excluded("a", ["a"]) == (["a"], [])


INDEX = {"title": "Wörter / one", "minimumVersion": "1.2", "revision": "1", "format": 3, "sequenced": True}
TERMS = [["gato", "gato", "n anim", "n", 5, ["cat", {"type": "structured-content", "content": ["x ", {"tag": "ul", "content": [{"tag": "li", "content": "a & b"}, {"tag": "li", "content": {"tag": "a", "href": "u", "content": "link"}}]}]}], 1, "t"], ["gatos", "", "", "", 0, [["gato", ["plural"]]], 2, ""], ["go", None, None, "", -1, [], 3, None]]


def banks(tmp_path):
    folder, zipped = str(tmp_path / "folder"), str(tmp_path / "two.zip")
    archive.write_folder(folder, INDEX, term_bank=TERMS, tag_bank=[["n", "partOfSpeech", 1, "noun", 0]], kanji_meta_bank=[["犬", "freq", 12]], kanji_bank=[["犬", "ケン", "", "t", ["dog"], {"strokes": "4"}]], term_meta_bank=[["gato", "freq", 7], ["gato", "freq", {"reading": "gato", "frequency": {"value": 9, "displayValue": "9㋕"}}], ["gato", "pitch", {"reading": "gato", "pitches": [{"position": 1}]}]])
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("index.json", json.dumps(INDEX | {"title": "Two"}))
        z.writestr("term_bank_1.json", json.dumps(TERMS[:1]))
    return [folder, zipped]


def test_import_into_store(spark, tmp_path):
    paths = banks(tmp_path)
    kept = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):  # again: nothing changes
        options = archive.import_dictionaries(spark, paths, kept)
        terms = {(r.dictionary, r.expression): r for r in kept.table("terms").collect()}
        assert len(terms) == 4 and terms[("Wörter / one", "gato")].score == 5 and terms[("Two", "gato")].sequence == 1
    cat = terms[("Wörter / one", "gato")].glossary
    assert [g.kind for g in cat] == ["Content", "Content"] and cat[0].plain_text == "cat" and cat[0].html is None
    assert (cat[1].plain_text, cat[1].html) == ("x\n• a & b\n• link", 'x <ul><li>a &amp; b</li><li><a href="u">link</a></li></ul>')
    assert [(r.kanji_char, r.freq.value) for r in kept.table("kanji_meta").collect()] == [("犬", 12)] and not (tmp_path / "store" / store.STAGING / "banks").exists()
    form = terms[("Wörter / one", "gatos")].glossary[0]
    assert (form.kind, form.form_of, form.rules) == ("Deinflection", "gato", ["plural"])
    freqs = sorted((r.freq.reading or "", r.freq.value) for r in kept.table("term_meta").where("mode = 'freq'").collect())
    assert freqs == [("", 7), ("gato", 9)] and kept.table("kanji").first().stats == {"strokes": "4"} and kept.table("kanji").first().kunyomi is None
    assert [o.name for o in kept.settings().profile.dictionaries] == [o.name for o in options] and kept.settings().profile.main_dictionary
    assert [r.title for r in kept.summaries().collect()] and kept.table("tags").first().name == "n"
    assert kept.summaries().first().minimum_version == "1.2"
    kept.views()
    assert spark.sql("SELECT count(*) FROM terms").first()[0] == 4
    kept.delete("Wörter / one")
    assert {r.dictionary for r in kept.table("terms").collect()} == {"Two"} and "Wörter / one" not in {d.name for d in kept.settings().profile.dictionaries}
    kept.wipe()
    assert not (tmp_path / "store").exists()


def test_paths(tmp_path):
    with pytest.raises(StoreError):
        store.resolve(str(tmp_path / "no" / "such"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(StoreError):
        store.resolve(str(tmp_path / "file"))
    assert store.resolve(str(tmp_path)).name == store.FOLDER
    with pytest.raises(EngineError):
        archive.check_paths([str(tmp_path / "none.zip")])


def test_profiles():
    settings = Settings()
    settings.profile.merge_dictionaries([DictionaryOptions("A"), DictionaryOptions.of_profile("B")])
    made = settings.create_profile("New")
    assert [d.name for d in made.dictionaries] == ["A", "B"] and made.main_dictionary == "A"
    with pytest.raises(ProfileError):
        settings.create_profile("New")
    assert settings.create_profile().name == "Profile 1" and settings.by_name("New") is made
    assert Settings.from_json(settings.to_json()) == settings
    settings.remove_by_index([0])
    assert [d.name for d in settings.profile.dictionaries] == ["B"] and settings.profile.main_dictionary == "" and len(made.dictionaries) == 2
    settings.remove_dictionaries(["A"], everywhere=True)
    assert [d.name for d in made.dictionaries] == ["B"] and sort_order(" Descending ") == "descending"
    with pytest.raises(EngineError):
        sort_order("up")


def test_cards():
    target = CardTarget({"D": 1}, {"M": ["Word", "Reading", "Meaning"]}).select("D", 0).configured()
    assert target.fields == {"term": "Word", "reading": "Reading", "definition": "Meaning"}
    for bad in (lambda: target.select(4, 0), lambda: target.select("D", "X"), lambda: target.map_fields({"term": "None"})):
        with pytest.raises(EngineError):
            bad()


def small_lexicon(spark):
    glossary = "glossary array<struct<kind:string,plain_text:string,html:string,form_of:string,rules:array<string>>>"
    schema = f"import_ord bigint, id string, expression string, reading string, sequence bigint, dictionary string, definition_tags string, term_tags string, rules string, score bigint, {glossary}, file_path string"
    text = lambda t: [("Content", t, None, None, None)]
    rows = [
        (1, "1", "cat", "cat", 1, "A", "n", "", "n", 5, text("animal"), ""), (2, "2", "cat", "cat", 7, "B", "", "", "n", 1, text("animal too"), ""), (3, "3", "cats", "", 2, "A", "", "", "n", 0, text("plural"), ""),
        (4, "4", "ran", None, 3, "A", "", "", "v", 0, [("Deinflection", None, None, "run", ["past"])], ""), (5, "5", "run", "run", 4, "A", "", "", "v", 2, text("to run"), ""), (6, "6", "hot dog", "hot dog", 5, "A", "", "", "n", 2, text("food"), ""),
        (7, "7", "hot", "hot", 6, "A", "", "", "adj", 2, text("warm"), ""), (8, "8", "kitty", "kitty", 1, "A", "", "", "n", 3, text("cat, small"), ""), (9, "9", "off", "off", 9, "C", "", "", "n", 3, text("disabled"), ""),
    ]
    options = spark.createDataFrame([("A", "a", True, True, False, True, 1), ("B", "", True, True, False, True, 2), ("C", "", False, True, False, True, 3)], "name string, alias string, enabled boolean, allow_secondary_searches boolean, parts_of_speech_filter boolean, use_deinflections boolean, ord int")
    metas = spark.createDataFrame([], "id string, term string, mode string, dictionary string, freq struct<reading:string,value:bigint,display_value:string,display_value_parsed:boolean>")
    return pipeline.Lexicon(spark.createDataFrame(rows, schema), metas, spark.createDataFrame([], "name string"), options)


def test_find_terms(spark):
    lexicon = small_lexicon(spark)
    queries = spark.createDataFrame([(1, "cats ran", "en"), (2, "ran", "en"), (3, "off", "en"), (4, "", "en"), (5, None, "en")], "query_id int, text string, lang string")
    group = pipeline.find_terms(queries, lexicon, "group").orderBy("query_id", "entry_rank").collect()
    assert [(r.query_id, r.term, r.n_definitions) for r in group] == [(1, "cats", 1), (1, "cat", 2), (2, "run", 1)]
    assert [(i.source, i.rules) for i in group[1].inflections] == [("algorithm", ["3rd person"]), ("algorithm", ["plural"])] and [(i.source, i.rules) for i in group[2].inflections] == [("dictionary", ["past"])]
    assert {r.entry_id for r in pipeline.find_terms(queries, lexicon, "simple").collect()} == {"1", "2", "3", "5"}
    merged = {r.term: [h.term for h in r.headwords] for r in pipeline.find_terms(queries, lexicon, "merge", LookupOptions(main_dictionary="A")).collect() if r.query_id == 1}
    assert merged["cat"] == ["cat", "kitty"]
    excluded = pipeline.find_terms(queries, lexicon, "group", LookupOptions(excluded=("A",))).collect()
    assert [(r.query_id, r.term, r.n_definitions) for r in excluded] == [(1, "cat", 1)]
    with pytest.raises(ValueError):
        pipeline.find_terms(queries, lexicon, "other")


def test_search(spark):
    texts = spark.createDataFrame([(1, "a hot dog ran\n", "en"), (2, "nothing", "en"), (3, None, "en"), (4, "Cats, HOT", "en")], "query_id int, text string, lang string")
    got = {}
    for r in pipeline.search(texts, small_lexicon(spark)).orderBy("query_id", "seg_pos").collect():
        got.setdefault(r.query_id, []).append((r.segment, r.matched))
    assert [s for s, m in got[1] if m] == ["hot dog", "ran"] and "".join(s for s, _ in got[1]) == "a hot dog ran\n" and set(got) == {1, 4}
    assert [s for s, m in got[4] if m] == ["Cats", "HOT"]
    segments, found = pipeline.search_entries(texts, small_lexicon(spark))
    assert {r.segment for r in segments.where("entry_query IS NOT NULL").collect()} == {"hot dog", "ran", "Cats", "HOT"}
    assert {(r.query_id.segment, r.term) for r in found.entries.collect()} >= {("hot dog", "hot dog"), ("Cats", "cats"), ("Cats", "cat"), ("HOT", "hot"), ("ran", "run")}


def test_search_prunes_nothing(spark):
    lexicon, options = small_lexicon(spark), LookupOptions()
    more = [("食べる", "たべる"), ("する", None), ("くる", None), ("カタカナ", None), ("hot dog stand", None), ("x1", None), ("(sic) y", None), ("いる", None), ("Straße 7", None)]
    rows = [r.asDict() | {"id": f"m{i}", "import_ord": 100 + i, "expression": e, "reading": d, "dictionary": "A"} for i, (e, d) in enumerate(more) for r in lexicon.terms.where("id = '1'").collect()]
    lexicon = pipeline.Lexicon(lexicon.terms.unionByName(spark.createDataFrame(rows, lexicon.terms.schema)), lexicon.metas, lexicon.tags, lexicon.options)
    draw = random.Random(9)
    parts = ["cats", "cat", "Ran", "hot", "dog", "dogs", "Hot dog stands", "runs", "kittys", "x1y", "(sic) ys", "STRASSE 7", "straße 7,", "ca", "ly", "食べ", "させ", "られ", "て", "い", "た", "する", "した", "来る", "くる", "ない", "かたかな", "カタカナ", "タベテイ", "😀"]
    texts = spark.createDataFrame([(i, draw.choice(["", " ", " "]).join(draw.choice(parts) for _ in range(12)), draw.choice(["en", "ja", "de", None])) for i in range(120)], "query_id int, text string, lang string")
    for opts in (options, LookupOptions(deinflect=False), LookupOptions(search_resolution="letter")):
        pruned = {tuple(r) for r in pipeline.search_keys(texts, lexicon, opts).collect()}
        assert pruned and pruned == {tuple(r) for r in pipeline.search_keys(texts, lexicon, opts, prune=False).collect()}


def test_search_at(spark):
    texts = spark.createDataFrame([(1, "So. A hot dog ran! Yes", "en", 7), (2, "cat", "en", 9)], "query_id int, text string, lang string, position int")
    (first, second) = pipeline.search_at(texts, small_lexicon(spark)).entries.orderBy("entry_rank").collect()
    assert (first.term, first.original, tuple(first.sentence)) == ("hot dog", "hot dog", ("A hot dog ran!", 2)) and second.term == "hot"


def test_notes(spark):
    lexicon = small_lexicon(spark)
    queries = spark.createDataFrame([(1, "cat", "en")], "query_id int, text string, lang string")
    rows = notes.notes(pipeline.find_terms(queries, lexicon).withColumn("sentence", F.lit("s")), {"term": "T", "definition": "D", "sentence": "S", "audio": "A"}, ["query_id"])
    assert tuple(rows.first()) == (1, "cat", "animal<br>animal too", "s", "")
    with pytest.raises(ValueError):
        notes.notes(rows, {"other": "X"}, [])


def test_stream(spark, tmp_path):
    from wortlake.streaming.search import search_stream

    source, got = str(tmp_path / "in"), []
    spark.createDataFrame([(1, "a hot dog", "en")], "query_id int, text string, lang string").write.parquet(source)
    stream = spark.readStream.schema("query_id int, text string, lang string").parquet(source)
    running = search_stream(stream, small_lexicon(spark), lambda rows, n: got.extend(r.segment for r in rows.where("matched").collect()), str(tmp_path / "cp"))
    running.processAllAvailable()
    running.stop()
    assert got == ["hot dog"]


def test_find_terms_enriches(spark):
    lexicon = small_lexicon(spark)
    metas = [
        ("m1", "cat", "freq", "A", (None, 7, "7", True), None, None), ("m2", "cat", "freq", "B", ("cat", 3, "3", True), None, None), ("m3", "cat", "freq", "B", ("other", 9, "9", True), None, None), ("m4", "cat", "freq", "C", (None, 1, "1", True), None, None),
        ("m5", "cat", "pitch", "A", None, ("cat", [(1, None, None, ["n"])]), None), ("m6", "cat", "ipa", "B", None, None, ("cat", [("kat", [])])),
    ]
    schema = f"id string, term string, mode string, dictionary string, freq struct<reading:string,value:bigint,display_value:string,display_value_parsed:boolean>, pitch {pipeline._PITCH}, ipa {pipeline._IPA}"
    tags = spark.createDataFrame([(1, "n", "partOfSpeech", 2, "noun", 4, "A")], "import_ord bigint, name string, category string, tag_order bigint, notes string, score bigint, dictionary string")
    lexicon = pipeline.Lexicon(lexicon.terms.withColumn("term_tags", F.when(F.col("id") == "2", "top").otherwise("")), spark.createDataFrame(metas, schema), tags, lexicon.options)
    queries = spark.createDataFrame([(1, "cats ran", "en")], "query_id int, text string, lang string")
    rows = {r.term: r for r in pipeline.find_terms(queries, lexicon, "group").collect()}
    cat = rows["cat"]
    assert [(f.meta_id, f.frequency, f.has_reading) for f in cat.frequencies] == [("m1", 7, False), ("m2", 3, True)]
    assert [(p.kind, p.position, p.ipa, [(t.name, t.category) for t in p.tags]) for p in cat.pronunciations] == [("pitch", 1, None, [("n", "partOfSpeech")]), ("ipa", None, "kat", [])]
    assert [(d.id, [(t.name, t.category, t.content, t.redundant) for t in d.tags]) for d in cat.definitions] == [("1", [("n", "partOfSpeech", ["noun"], False)]), ("2", [])]
    assert [(t.name, t.category, t.dictionaries) for t in cat.headwords[0].tags] == [("top", "default", ["B"])]
    assert rows["cats"].frequencies == [] and {r.matched_length for r in rows.values()} == {4}
    simple = {r.entry_id: r for r in pipeline.find_terms(queries, lexicon, "simple", LookupOptions(sort_frequency_dictionary="B")).collect()}
    assert [f.meta_id for f in simple["1"].frequencies] == ["m2"] and simple["1"].pronunciations == [] and simple["1"].frequency_order == 3


def test_merge_hides_a_disabled_main(spark):
    queries = spark.createDataFrame([(1, "off", "en"), (2, "cat", "en")], "query_id int, text string, lang string")
    rows = pipeline.find_terms(queries, small_lexicon(spark), "merge", LookupOptions(main_dictionary="C")).collect()
    assert {r.query_id for r in rows} == {2} and {d.dictionary for r in rows for d in r.definitions} == {"A", "B"}


def test_redundant_tags(spark):
    rows = spark.createDataFrame([(1, "A", ["n", "x"]), (2, "A", ["x", "n"]), (3, "B", ["n", "x"]), (4, "B", []), (5, "B", [])], "i int, dictionary string, t array<string>").withColumn("k", F.lit(1))
    assert [r.redundant for r in filters.flag_redundant(rows, ["k"], ["i"], "t").orderBy("i").collect()] == [False, True, False, False, False]


def test_hot_headword_is_not_nested(spark):
    """A headword with most of the definitions: its numbers, order and tags, without a row or list that holds them all."""
    small = small_lexicon(spark)
    many = small.terms.where("id = '1'").crossJoin(spark.range(3000).withColumnRenamed("id", "_n")).withColumns({"id": F.concat(F.lit("h"), F.lpad(F.col("_n").cast("string"), 5, "0")), "import_ord": F.col("_n") + 100, "score": F.col("_n") % 7}).drop("_n")
    lexicon = pipeline.Lexicon(small.terms.unionByName(many), small.metas, small.tags, small.options)
    found = pipeline.find(spark.createDataFrame([(1, "cat", "en")], "query_id int, text string, lang string"), lexicon, "group")
    (entry,) = found.entries.collect()
    assert (entry.n_definitions, entry.score, entry.entry_id) == (3002, 6, "1")
    first = found.definitions.where("pos <= 2").orderBy("pos").collect()
    assert [(r["score"], r["index"]) for r in first] == [(6, 8), (6, 15)] and found.definitions.selectExpr("max(pos)").first()[0] == 3002
    merged = pipeline.find(spark.createDataFrame([(1, "cat", "en")], "query_id int, text string, lang string"), lexicon, "merge", LookupOptions(main_dictionary="A")).entries.collect()
    assert [(r.term, r.n_definitions) for r in merged] == [("cat", 3)]


def test_keys_of_any_length(spark):
    long, joined = "the early bird that catches the worm is never the last to leave", "あ" * 60
    small = small_lexicon(spark)
    more = small.terms.where("id IN ('1', '6')").withColumns({"expression": F.when(F.col("id") == "1", long).otherwise(joined), "reading": F.lit(None).cast("string"), "id": F.concat(F.lit("l"), "id")})
    lexicon = pipeline.Lexicon(small.terms.unionByName(more), small.metas, small.tags, small.options)
    texts = spark.createDataFrame([(1, f"so {long}s, he said", "en"), (2, f"え{joined}え", "ja"), (3, long, "en"), (4, f"{long} home", "en")], "query_id int, text string, lang string")
    assert {(r.query_id, r.original) for r in pipeline.search_keys(texts, lexicon).collect()} >= {(1, f"{long}s"), (2, joined), (3, long), (4, long)}
    found = pipeline.find_terms(texts.where("query_id > 2"), lexicon, "simple").collect()
    assert {(r.query_id, r.term) for r in found} >= {(3, long), (4, long)}


def test_other_match_types_are_refused(spark):
    queries = spark.createDataFrame([(1, "cat", "en")], "query_id int, text string, lang string")
    for kind in ("prefix", "suffix"):
        with pytest.raises(EngineError):
            pipeline.find_terms(queries, small_lexicon(spark), "group", LookupOptions(match_type=kind))
