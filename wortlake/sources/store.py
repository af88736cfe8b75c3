"""The store: Parquet tables under a root, partitioned by dictionary, with upserts by last writer, and the settings."""

from __future__ import annotations

import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wortlake.options import Settings, StoreError

TABLES = ("terms", "term_meta", "kanji", "kanji_meta", "tags", "summaries")
KEYS = {"terms": ["id"], "term_meta": ["id"], "kanji": ["kanji_char", "dictionary"], "kanji_meta": ["kanji_char", "dictionary"], "tags": ["id"], "summaries": ["title"]}
FOLDER, STAGING = "lexicon", "_staging"


def last_written(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order: what repeated imports leave. Null keys count as equal. Each task cuts its rows to one per key before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_last", F.row_number().over(rank)).where("_last = 1").drop("_last")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ("import_ord",)) -> DataFrame:
    """Existing rows with new ones over them: the later write wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_written(both, keys, ["_new", *(o for o in order if o in both.columns)]).drop("_new")


def delete_dictionary(rows: DataFrame, name: str, column: str = "dictionary") -> DataFrame:
    """All rows but those of the dictionary; rows without dictionary stay."""
    return rows.where(F.col(column).isNull() | (F.col(column) != name))


def summarise(terms: DataFrame, metas: DataFrame, kanji: DataFrame, tags: DataFrame) -> DataFrame:
    """The counts of each dictionary as they are in the tables: (dictionary, terms, freq, pitch, ipa, kanji, tag_meta). Partial counts are combined map-side."""
    kinds = [terms.select("dictionary", F.lit("terms").alias("kind")), metas.select("dictionary", F.col("mode").alias("kind")), kanji.select("dictionary", F.lit("kanji").alias("kind")), tags.select("dictionary", F.lit("tag_meta").alias("kind"))]
    rows = kinds[0]
    for more in kinds[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("dictionary").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("terms", "freq", "pitch", "ipa", "kanji", "tag_meta")))


def resolve(path: str, *, create: bool = True) -> Path:
    """The store's folder for a path: itself if it holds tables or is new, else a fixed sub-folder of it. A missing parent is an error."""
    root = Path(path)
    if root.is_file():
        raise StoreError(f"{path} is a file")
    if any((root / f"{t}.parquet").exists() for t in TABLES):
        return root
    if root.is_dir():
        root = root / FOLDER
    elif not root.parent.is_dir():
        raise StoreError(f"{root.parent} does not exist")
    if create:
        root.mkdir(exist_ok=True)
    return root


class Store:
    """Tables and settings under one folder, which all executors share. Writes replace only the partitions of the dictionaries written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, resolve(path)

    def path(self, name: str) -> str:
        return str(self.root / f"{name}.parquet")

    def has(self, name: str) -> bool:
        return (self.root / f"{name}.parquet").exists()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def views(self) -> None:
        """Registers every table as a temporary view."""
        for name in filter(self.has, TABLES):
            self.table(name).createOrReplaceTempView(name)

    def write(self, name: str, rows: DataFrame, *, unique: bool = False) -> None:
        """Upserts rows: the dictionaries among them are merged with what the store has of them and their partitions replaced.

        unique says that no key occurs twice among the rows, so a new table is written without a shuffle.
        """
        column = "title" if name == "summaries" else "dictionary"
        if not self.has(name):
            last = rows if unique else last_written(rows, KEYS[name], [o for o in ("import_ord",) if o in rows.columns] or KEYS[name])
            last.write.partitionBy(column).parquet(self.path(name))
            return
        touched = rows.select(column).distinct()
        merged = upsert(self.table(name).join(touched, column, "left_semi"), rows, KEYS[name])
        # The result reads the partitions it replaces, so it is written beside them first; a lost task can then not read what is gone.
        staged = str(self.root / STAGING / name)
        merged.write.mode("overwrite").parquet(staged)
        ready = self.spark.read.parquet(staged)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(self.path(name))
        shutil.rmtree(staged, ignore_errors=True)

    def discard(self, name: str) -> None:
        """Removes what was staged under a name."""
        shutil.rmtree(self.root / STAGING / name, ignore_errors=True)

    def summaries(self) -> DataFrame:
        return self.table("summaries").orderBy("import_date", "title")

    def delete(self, dictionary: str) -> None:
        """Removes a dictionary from all tables (its partitions) and from all profiles."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(dictionary)
        for name in filter(self.has, TABLES):
            column = "title" if name == "summaries" else "dictionary"
            shutil.rmtree(self.root / f"{name}.parquet" / f"{column}={escaped}", ignore_errors=True)
        settings = self.settings()
        settings.remove_dictionaries([dictionary], everywhere=True)
        self.save(settings)

    def wipe(self) -> None:
        shutil.rmtree(self.root, ignore_errors=True)

    def settings(self) -> Settings:
        return Settings.load(self.root / "settings.json")

    def save(self, settings: Settings) -> None:
        settings.save(self.root / "settings.json")
