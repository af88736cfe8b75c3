"""What grows with a table must not be multiplied by what grows with another, unless the result is."""

from pyspark.sql import functions as F

from tests.test_operators import small_lexicon
from wortlake.operators import meta
from wortlake.plans import finding, pipeline

QUERY = "query_id int, text string, lang string"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def many(spark, n=300):
    """The small lexicon with n more rows of cat, whose form cats tells of, and metas of it with and without reading."""
    lexicon = small_lexicon(spark)
    cat = lexicon.terms.where("expression = 'cat'").limit(1)
    more = cat.crossJoin(spark.range(n).toDF("_n")).withColumn("id", F.concat(F.lit("m"), F.col("_n").cast("string")))
    more = more.withColumn("import_ord", F.col("_n") + 1000) if "import_ord" in cat.columns else more
    metas = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.lit("cat").alias("term"), F.lit("freq").alias("mode"), F.lit("A").alias("dictionary"),
        F.struct(F.when(F.col("id") % 2 == 0, F.lit("cat")).alias("reading"), F.col("id").alias("value"), F.lit("").alias("display_value"), F.lit(True).alias("display_value_parsed")).alias("freq"))
    return pipeline.Lexicon(lexicon.terms.unionByName(more.select(*lexicon.terms.columns)), metas, lexicon.tags, lexicon.options)


def test_definitions_need_no_metas(spark):
    lexicon = many(spark)
    for mode in ("simple", "split", "group"):
        found = pipeline.find(spark.createDataFrame([(1, "cat", "en")], QUERY), lexicon, mode, keep=False)
        rows = finding._ordered(found)
        assert "transcriptions" not in plan(rows) and "pitch" not in plan(rows)
        assert rows.where("id LIKE 'm%'").count() == 300


def test_rows_are_matched_by_kind(spark):
    lexicon = many(spark)
    kinds = pipeline.index(lexicon.with_options())
    assert kinds.where("key = 'cat'").count() <= 2 < lexicon.with_options().where("expression = 'cat'").count()


def test_metas_are_listed_per_term(spark):
    heads = spark.createDataFrame([("cat", "cat"), ("cat", "kat"), ("dog", "dog")], "term string, reading string")
    said = meta.frequencies_of(many(spark, 10).metas)
    got = {(r.term, r.reading): r.l for r in meta.listed(heads, said, ("meta_id",), F.col("meta_id"), "l").collect()}
    assert got == {("cat", "cat"): "|".join(f"f{i}" for i in range(10)), ("cat", "kat"): "|".join(f"f{i}" for i in range(1, 10, 2))}
    least = {(r.term, r.reading): r.frequency_order for r in meta.least_frequency(heads, said, "A").collect()}
    assert least == {("cat", "cat"): 0, ("cat", "kat"): 1, ("dog", "dog"): None}


def test_search_at_looks_up_a_source_once(spark):
    lexicon = many(spark)
    texts = spark.createDataFrame([(1, "cats are", "en", 1), (2, "a cats b", "en", 3), (3, "zzz", "en", 1), (4, "cat", "en", 9)], QUERY + ", position int")
    found = pipeline.search_at(texts, lexicon)
    rows = found.entries.select("query_id", "entry_key", "original", "sentence.text").collect()
    assert {r.query_id for r in rows} == {1, 2} and {r.text for r in rows} == {"cats are", "a cats b"}
    assert len({r.entry_key for r in rows}) * 2 == len(rows)
    alone = pipeline.find(spark.createDataFrame([(1, "cats are", "en")], QUERY), lexicon, "group").entries
    assert sorted(r.entry_id for r in alone.collect()) == sorted(r.entry_id for r in found.entries.where("query_id = 1").collect())


def test_segments_without_entries_are_not_shuffled(spark):
    texts = spark.createDataFrame([(1, "cats zz cat", "en"), (2, "qq", "en")], QUERY)
    segments, found = pipeline.search_entries(texts, small_lexicon(spark))
    entries = found.entries.select(F.col("query_id").alias("entry_query"), "entry_id")
    rows = pipeline.with_entries(segments, entries)
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r.segment, r.matched, r.entry_id is not None) for r in rows.collect()}
    assert ("cats", True, True) in got and ("z", False, False) in got
