"""Queries p3 to p8 with their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wortlake.llm import encode, lookalike, markup, pack, split, topn
from wortlake.llm.sql import SQL  # noqa: F401
from wortlake.sources.tables import table

SPELLED = {"expression": "headword", "reading": "reading"}


def _stacked(df: DataFrame, fields: dict[str, str], *others: str) -> DataFrame:
    """(others, fld, spelling): one row per field; fields maps fld to the column."""
    pairs = F.array(*(F.struct(F.lit(f).alias("fld"), F.col(c).alias("spelling")) for f, c in fields.items()))
    return df.select(*others, F.inline(pairs))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Spellings that look like a headword (reading) but are not the same string.

    A class that holds a headword has it as its canonical member, so only these classes are made and joined.
    """
    headwords = _stacked(table(spark, root, "headwords"), SPELLED, "headword_id")
    classes = lookalike.canonical_classes(headwords, ["fld"], "spelling", ["headword_id"]).withColumnRenamed("fld", "_fld")
    terms = _stacked(table(spark, root, "terms"), {f: f for f in SPELLED}, "import_ord").where("spelling <> ''")
    looked = lookalike.with_prototype(terms, "spelling", "_look")
    found = looked.join(classes, (F.col("fld") == F.col("_fld")) & (F.col("_look") == F.col("look")) & (F.col("spelling") != F.col("canonical")))
    return found.select("import_ord", "fld", "headword_id")


def p3_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct spelling of terms in its consistent form; headwords come first, then the most frequent spelling."""
    terms = _stacked(table(spark, root, "terms").withColumn("headword_id", F.lit(None).cast("bigint")), {f: f for f in SPELLED}, "headword_id")
    headwords = _stacked(table(spark, root, "headwords"), SPELLED, "headword_id")
    return lookalike.canonical_spellings(terms.unionByName(headwords), ["fld"], "spelling", ["headword_id"]).where("spelling IS NOT NULL")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "terms").select("import_ord", "expression", "score")
    return topn.top_n(rows, "expression", "score", ["import_ord"], 5).select("import_ord", F.col("rnk").cast("int").alias("rnk"))


def _content(spark: SparkSession, root: str) -> DataFrame:
    """The Content items of all glossaries: import_ord, item_pos, plain_text, html."""
    items = table(spark, root, "terms").select("import_ord", F.posexplode("glossary").alias("_pos", "_item")).where("_item.kind = 'Content'")
    return items.select("import_ord", (F.col("_pos") + 1).alias("item_pos"), "_item.plain_text", "_item.html")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows that are read twice, computed once: a checkpoint in the cluster's shared folder, if one is set."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Content items whose plain_text has a leaf node on a tagged path of the path table. Nodes and table come of one parse."""
    keys = ["import_ord", "item_pos"]
    nodes = _cut(markup.path_sums(markup.nodes_of(_content(spark, root), keys, "plain_text"), *keys))
    return nodes.join(markup.path_ratios(nodes).where("tagged").select("path"), "path", "left_semi").select(*keys).distinct()


def _both(spark: SparkSession, root: str) -> DataFrame:
    return _stacked(_content(spark, root), {"plain_text": "plain_text", "html": "html"}, "import_ord", "item_pos").withColumnRenamed("spelling", "text")


def p5_paths(spark: SparkSession, root: str) -> DataFrame:
    """The tag paths of plain_text and html with their ratios."""
    ratios = markup.path_ratios(_cut(markup.path_sums(markup.nodes_of(_both(spark, root), [], "text"))))
    return ratios.select("path", "nodes", "leaves", "chars", "punct", F.round("ratio", 6).alias("ratio"), "content")


def p5_clean(spark: SparkSession, root: str) -> DataFrame:
    """The clean text of every plain_text and html. Nodes and table come of one parse, the text of another."""
    keys = ["import_ord", "item_pos", "fld"]
    both = _both(spark, root).where("text IS NOT NULL")
    nodes = _cut(markup.path_sums(markup.nodes_of(both, keys, "text"), *keys))
    return markup.clean_rows(both, keys, "text", nodes, markup.path_ratios(nodes)).select(*keys, "clean")


CAPACITY = 2048
LIMIT, OVERLAP = 512, 64


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", encode.token_ids("text", encode.shared(spark)).alias("ids"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Documents in containers of CAPACITY tokens of byte_bpe_50k."""
    documents = table(spark, root, "documents")
    sized = documents.select("doc_id", encode.token_count("text", encode.shared(spark)).alias("n_tokens"))
    return pack.pack(sized, "doc_id", "n_tokens", CAPACITY, rows=documents.count())


def p8_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Documents in pieces of at most LIMIT tokens of byte_bpe_50k that overlap by OVERLAP."""
    return split.split_texts(table(spark, root, "documents"), "doc_id", "text", encode.shared(spark), LIMIT, OVERLAP)


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The round trip: the ids of every text as text again; null and empty texts are empty."""
    tables = encode.shared(spark)
    return table(spark, root, "documents").select("doc_id", encode.decoded(encode.token_ids("text", tables), tables).alias("text"))


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """What holds of the packing: documents and tokens are all there, containers within the capacity, only what exceeds the capacity is divided."""
    packed = p7_packed(spark, root)
    sized = table(spark, root, "documents").select("doc_id", encode.token_count("text", encode.shared(spark)).alias("n_tokens"))
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("length"), F.count("*").alias("pieces"))
    items = sized.join(whole, "doc_id", "left").agg(
        F.count("*").alias("n_documents"), F.bool_and(F.coalesce(F.col("length") == F.col("n_tokens"), F.lit(False))).alias("complete"), F.bool_and(F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("undivided")
    )
    loads = packed.groupBy("container").agg(F.sum("length").alias("load")).agg(F.bool_and(F.col("load") <= CAPACITY).alias("fits"))
    return items.join(F.broadcast(loads))  # one row each


def p8_checked(spark: SparkSession, root: str) -> DataFrame:
    """What holds of the pieces of each text: within the limit, overlapping as asked, from its first token to its last, each a part of it."""
    pieces, documents = p8_pieces(spark, root), table(spark, root, "documents")
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_whole"), encode.token_count("text", encode.shared(spark)).alias("_all"))
    joined = pieces.withColumn("_end", F.col("first_token") + F.col("n_tokens")).join(own, "doc_id")
    shared = F.lag("_end").over(Window.partitionBy("doc_id").orderBy("piece")) - F.col("first_token")
    rows = joined.select("doc_id", "_all", "_end", "n_tokens", "first_token", shared.alias("_shared"), F.contains("_whole", F.coalesce("text", F.lit(""))).alias("_part"))
    return rows.groupBy("doc_id").agg(
        F.bool_and(F.col("n_tokens") <= LIMIT).alias("fits"),
        F.bool_and(F.when(F.col("_shared").isNull(), F.col("first_token") == 0).otherwise(F.col("_shared").between(OVERLAP, OVERLAP + 3))).alias("overlaps"),
        (F.max("_end") == F.max("_all")).alias("complete"),
        F.bool_and("_part").alias("contained"),
    )


QUERIES = {"p3_found": p3_found, "p3_canonical": p3_canonical, "p4_found": p4_found, "p5_found": p5_found, "p5_paths": p5_paths, "p5_clean": p5_clean, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_packed": p7_packed, "p7_checked": p7_checked, "p8_pieces": p8_pieces, "p8_checked": p8_checked}
