"""Queries p1 and p2 over the lexicon tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlake.operators import packed, references
from wortlake.sources.tables import table

FIELDS = ("definition_tags", "term_tags", "rules")


def _micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def dangling(spark: SparkSession, root: str) -> DataFrame:
    """Every dangling reference: src_table, import_ord, ref_name, period, status."""
    tags = table(spark, root, "tags")
    lifetimes = tags.select("name", "dictionary", _micros("imported_at").alias("since"), _micros("deleted_at").alias("until"))
    names = F.array_distinct(F.transform(packed.unpack("definition_tags"), lambda v: F.substring_index(v, ":", 1)))
    of_terms = table(spark, root, "terms").select(
        F.lit("terms").alias("src_table"), "import_ord", F.explode(names).alias("ref_name"), "imported_at", "dictionary", _micros("imported_at").alias("_at")
    )
    # A title has no integer of its own: its hash is the key, in slots of the leading 16 bits; an exact check of the titles follows for hashes that meet by chance.
    of_tags = tags.where("dictionary IS NOT NULL").select(F.lit("tags").alias("src_table"), "import_ord", F.col("dictionary").alias("ref_name"), "imported_at", F.xxhash64("dictionary").alias("_at"))
    titles = table(spark, root, "summaries").select("title", F.xxhash64("title").alias("key"))
    matched = references.as_of_status(of_tags, titles, [], "_at", "key", slot_width=1 << 48)
    chance = matched.where("status IS NULL").join(titles, F.col("ref_name") == F.col("title"), "left_anti").withColumn("status", F.lit(references.MISSING))
    found = [
        references.orphans(of_terms, lifetimes, [("ref_name", "name"), ("dictionary", "dictionary")], "_at", "since", "until"),
        matched.where("status IS NOT NULL").unionByName(chance),
    ]
    columns = ["src_table", "import_ord", "ref_name", F.date_format("imported_at", "yyyy-MM").alias("period"), "status"]
    return found[0].select(*columns).unionByName(found[1].select(*columns))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return dangling(spark, root).select("src_table", "import_ord", "ref_name", "period")


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_report(dangling(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return packed.unpacked_rows(table(spark, root, "terms"), ["import_ord"], FIELDS, at_least=2)


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p2_found": p2_found}

_TOKEN = "|".join([r'"(?:[^"\\]|\\.|"")*"', r"''(?:[^''\\]|\\.|'''')*''", "„[^“]*“", "“[^”]*”", "‘[^’]*’", "「[^」]*」", "『[^』]*』", "«[^»]*»", "‹[^›]*›", r"[\p{L}\p{Nd}_.:+-]+"])


def _values_sql(field: str) -> str:
    inner = "t[2:-2]"
    return f"""list_filter(list_transform(regexp_extract_all(coalesce({field}, ''), '(?s){_TOKEN}'), lambda t: CASE
      WHEN t[1] = '"' AND contains(t, '\\') THEN json_extract_string(t, '$')
      WHEN t[1] = '"' THEN replace({inner}, '""', '"')
      WHEN t[1] = '''' THEN regexp_replace(replace({inner}, '''''', ''''), '\\\\(.)', '\\1', 'g')
      WHEN t[1] IN ('„', '“', '‘', '「', '『', '«', '‹') THEN {inner} ELSE t END), lambda t: t <> '')"""


_CASES = f"""
WITH refs AS (
  SELECT DISTINCT import_ord, dictionary, imported_at, split_part(v, ':', 1) AS ref_name
  FROM (SELECT import_ord, dictionary, imported_at, unnest({_values_sql("definition_tags")}) AS v FROM terms)),
cases AS (
  SELECT 'terms' AS src_table, import_ord, ref_name, strftime(imported_at, '%Y-%m') AS period,
    CASE WHEN imported_at IS NULL OR NOT EXISTS (SELECT 1 FROM tags g WHERE g.name = r.ref_name AND g.dictionary = r.dictionary AND coalesce(g.deleted_at > g.imported_at, g.imported_at IS NOT NULL)) THEN 'missing'
      WHEN NOT EXISTS (SELECT 1 FROM tags g WHERE g.name = r.ref_name AND g.dictionary = r.dictionary AND g.imported_at <= r.imported_at AND coalesce(g.deleted_at > g.imported_at, true)) THEN 'not_yet'
      ELSE 'deleted' END AS status
  FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.name = r.ref_name AND g.dictionary = r.dictionary
    AND g.imported_at <= r.imported_at AND (g.deleted_at IS NULL OR g.deleted_at > r.imported_at))
  UNION ALL
  SELECT 'tags', import_ord, dictionary, strftime(imported_at, '%Y-%m'), 'missing' FROM tags
  WHERE dictionary IS NOT NULL AND dictionary NOT IN (SELECT title FROM summaries WHERE title IS NOT NULL))
"""

SQL = {
    "p1_found": _CASES + "SELECT src_table, import_ord, ref_name, period FROM cases",
    "p1_report": _CASES + "SELECT src_table, period, status, count(*) AS n_refs, count(DISTINCT ref_name) AS n_names FROM cases GROUP BY ALL",
    "p2_found": " UNION ALL ".join(
        f"SELECT import_ord, '{f}' AS fld, CAST(pos AS INTEGER) AS pos, val FROM (SELECT import_ord, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM (SELECT import_ord, {_values_sql(f)} AS v FROM terms) WHERE len(v) >= 2)"
        for f in FIELDS
    ),
}
