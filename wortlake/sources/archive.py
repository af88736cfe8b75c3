"""Dictionary archives: zip files or folders of an index and JSON banks, to the lexicon's tables.

The banks of all archives are listed, spread over the cluster and read one by one, parsed as VARIANT in the JVM, and written once to the
store's staging folder; all tables are made from there. Structured content becomes text and HTML.
"""

from __future__ import annotations

import html
import json
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from wortlake.options import DictionaryOptions, ImportFailed
from wortlake.sources.store import KEYS, STAGING, Store

_FILES = "archive string, file string, body string"
# Elements of structured content that begin a line, and the attributes that are kept.
_LINES = set("div p li tr br ul ol table h1 h2 h3 h4 h5 h6 details summary".split())
_ATTRIBUTES = ("href", "lang", "title", "colSpan", "rowSpan")


def check_paths(paths: list[str]) -> None:
    if missing := [p for p in paths if not Path(p).exists()]:
        raise ImportFailed(f"not found: {', '.join(missing)}")


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, file, body) of the JSON files in archives (zip) and folders. A task reads one file at a time; the paths must be mounted on all machines."""
    check_paths(paths)
    listed = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(len(paths))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if Path(path).is_dir():
                    found = [p.name for p in Path(path).glob("*.json")]
                else:
                    with zipfile.ZipFile(path) as z:
                        found = [n for n in z.namelist() if n.endswith(".json")]
                yield pa.RecordBatch.from_pydict({"archive": pa.array([path] * len(found), pa.string()), "file": pa.array(found, pa.string())})

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if Path(path).is_dir():
                    body = (Path(path) / name).read_bytes()
                else:
                    with zipfile.ZipFile(path) as z:
                        body = z.read(name)
                yield pa.RecordBatch.from_pydict({"archive": [path], "file": [name.rpartition("/")[2]], "body": [body.decode("utf-8-sig")]})

    every = listed.mapInArrow(names, "archive string, file string")
    return every.repartition(spark.sparkContext.defaultParallelism * 2, "archive", "file").mapInArrow(bodies, _FILES)


def rendered(content, tag: str = "") -> tuple[str, str]:
    """Text and HTML of structured content: a text, a list, or an element with a tag and content."""
    if content is None or isinstance(content, bool):
        return "", ""
    if isinstance(content, str | int | float):
        return str(content), html.escape(str(content), quote=False)
    if isinstance(content, list):
        parts = [rendered(c) for c in content]
        return "".join(t for t, _ in parts), "".join(h for _, h in parts)
    tag = content.get("tag") or ""
    if content.get("type") == "text":
        return rendered(content.get("text"))
    text, inner = rendered(content.get("content"))
    if tag in ("rt", "rp"):
        text = ""
    if tag in _LINES:
        text = ("\n• " if tag == "li" else "\n") + text + ("" if tag == "br" else "\n")
    elif tag in ("td", "th"):
        text += "\t"
    if not tag:
        return text, inner
    given = "".join(f' {k.lower()}="{html.escape(str(content[k]))}"' for k in _ATTRIBUTES if content.get(k) is not None)
    return text, f"<{tag}{given}/>" if tag in ("br", "img") else f"<{tag}{given}>{inner}</{tag}>"


def _lines(text: str) -> str:
    return "\n".join(line.rstrip() for line in text.split("\n") if line.strip(" \t•"))


def _bank(all_files: DataFrame, prefix: str) -> DataFrame:
    """(archive, file, pos, row): the rows of the banks of one kind, each a VARIANT array."""
    return all_files.where(F.col("file").rlike(rf"^{prefix}_\d+\.json$") & F.col("row").isNotNull()).select("archive", "file", "pos", "row")


def parsed(all_files: DataFrame) -> DataFrame:
    """(archive, file, pos, row, body): the rows of all banks as VARIANT, with the body of the index alone."""
    bank = all_files.where("file <> 'index.json'").select("archive", "file", F.parse_json("body").alias("_bank"))
    rows = bank.lateralJoin(bank.sparkSession.tvf.variant_explode(F.col("_bank").outer())).select("archive", "file", "pos", F.col("value").alias("row"))
    return rows.unionByName(all_files.where("file = 'index.json'"), allowMissingColumns=True)


def _at(i: int, kind: str = "string", path: str = "") -> Column:
    return F.try_variant_get("row", f"$[{i}]{path}", kind)


def _list(column: Column) -> Column:
    return F.coalesce(column.try_cast("array<string>"), F.array().cast("array<string>"))


def indexes(all_files: DataFrame) -> DataFrame:
    """(archive, title, revision, sequenced, version) of each index."""
    v = F.parse_json("body")
    get = lambda path, kind="string": F.try_variant_get(v, path, kind)
    rows = all_files.where("file = 'index.json'")
    return rows.select("archive", get("$.title").alias("title"), get("$.revision").alias("revision"), F.coalesce(get("$.sequenced", "boolean"), F.lit(False)).alias("sequenced"), F.nullif(F.regexp_extract("body", r'"minimum\w*Version"\s*:\s*"([^"]*)"', 1), F.lit("")).alias("minimum_version"), F.coalesce(get("$.format", "int"), get("$.version", "int")).cast("smallint").alias("version"))


def _titled(rows: DataFrame, index: DataFrame) -> DataFrame:
    return rows.join(index.select("archive", F.col("title").alias("dictionary")), "archive")


def _id(*columns: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def _item(value: Column) -> Column:
    """One glossary item: a pair (form of, rules), a text, or an object, whose JSON is kept in html until `_shown` renders it."""
    kind = F.schema_of_variant(value)
    return F.struct(
        F.when(kind.startswith("ARRAY"), "Deinflection").otherwise("Content").alias("kind"),
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("plain_text"),
        F.when(kind.startswith("OBJECT"), F.to_json(value)).alias("html"),
        F.try_variant_get(value, "$[0]", "string").alias("form_of"),
        F.try_variant_get(value, "$[1]", "array<string>").alias("rules"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    """Glossaries with their objects as text and HTML. Only the objects go to Python, as one list per row that has any."""
    objects = F.to_json(F.transform(F.col("glossary"), lambda g: g["html"]))

    def render(values: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("plain_text", pa.string()), ("html", pa.string())]))
        rows = [None if v is None else [None if x is None else rendered(json.loads(x)) for x in json.loads(v)] for v in values.to_pylist()]
        return pa.array([None if r is None else [None if x is None else {"plain_text": _lines(x[0]), "html": x[1]} for x in r] for r in rows], kind)

    some = F.exists("glossary", lambda g: g["html"].isNotNull())
    made = arrow_udf(render, "array<struct<plain_text:string,html:string>>")(F.when(some, objects))

    def merged(g: Column, i: Column) -> Column:
        new = F.get(F.col("_made"), i)
        return F.when(g["html"].isNull(), g).otherwise(g.withField("plain_text", F.nullif(new["plain_text"], F.lit(""))).withField("html", new["html"]))

    return rows.withColumn("_made", made).withColumn("glossary", F.when(F.col("_made").isNull(), F.col("glossary")).otherwise(F.transform("glossary", merged))).drop("_made")


def read_tables(every: DataFrame) -> dict[str, DataFrame]:
    """The tables of parsed banks as lazily built DataFrames."""
    index = indexes(every)
    glossary = F.transform(F.coalesce(F.try_variant_get("row", "$[5]", "array<variant>"), F.array().cast("array<variant>")), _item)
    raw = _titled(_bank(every, "term_bank"), index).select(
        "dictionary", F.col("file").alias("file_path"), "pos", _at(0).alias("expression"), _at(1).alias("reading"), _at(2).alias("definition_tags"), _at(3).alias("rules"),
        _at(4, "bigint").alias("score"), glossary.alias("glossary"), _at(6, "bigint").alias("sequence"), _at(7).alias("term_tags"),
    )
    terms = _shown(raw.select(_id("dictionary", "file_path", "pos").alias("id"), *(c for c in raw.columns if c != "pos")))
    tags = _titled(_bank(every, "tag_bank"), index).select(_id("dictionary", "file", "pos").alias("id"), _at(0).alias("name"), _at(1).alias("category"), _at(2, "bigint").alias("tag_order"), _at(3).alias("notes"), _at(4, "bigint").alias("score"), "dictionary")
    kanji = _titled(_bank(every, "kanji_bank"), index).select(_at(0).alias("kanji_char"), "dictionary", F.nullif(_at(1), F.lit("")).alias("onyomi"), F.nullif(_at(2), F.lit("")).alias("kunyomi"), _at(3).alias("tags"), _at(4, "array<string>").alias("meanings"), _at(5, "map<string,string>").alias("stats"))
    metas = _titled(_bank(every, "term_meta_bank"), index)
    freq = F.struct(
        F.try_variant_get("row", "$[2].reading", "string").alias("reading"),
        F.coalesce(_at(2, "bigint"), _at(2, "bigint", ".value"), _at(2, "bigint", ".frequency"), _at(2, "bigint", ".frequency.value")).alias("value"),
        F.coalesce(_at(2, "string", ".displayValue"), _at(2, "string", ".frequency.displayValue"), F.when(F.schema_of_variant(F.try_variant_get("row", "$[2]", "variant")) == "STRING", _at(2))).alias("display_value"),
        F.lit(False).alias("display_value_parsed"),
    )
    pitch = F.struct(_at(2, "string", ".reading").alias("reading"), _at(2, "array<struct<position:int,nasal:array<smallint>,devoice:array<smallint>,tags:array<string>>>", ".pitches").alias("pitches"))
    ipa = F.struct(_at(2, "string", ".reading").alias("reading"), _at(2, "array<struct<ipa:string,tags:array<string>>>", ".transcriptions").alias("transcriptions"))
    of_kanji = _titled(_bank(every, "kanji_meta_bank"), index).where(_at(1) == "freq")
    kanji_meta = of_kanji.select(_at(0).alias("kanji_char"), "dictionary", freq.alias("freq"))
    of = lambda mode, value: F.when(_at(1) == mode, value)
    term_meta = metas.select(_id("dictionary", "file", "pos").alias("id"), _at(0).alias("term"), _at(1).alias("mode"), "dictionary", of("freq", freq).alias("freq"), of("pitch", pitch).alias("pitch"), of("ipa", ipa).alias("ipa"))
    summaries = index.select("title", "revision", "sequenced", "minimum_version", "version").withColumn("import_date", F.current_timestamp())
    return {"terms": terms, "term_meta": term_meta, "kanji": kanji, "kanji_meta": kanji_meta, "tags": tags, "summaries": summaries}


def import_dictionaries(spark: SparkSession, paths: list[str], store: Store) -> list[DictionaryOptions]:
    """Imports archives into the store, adds their options to the current profile and saves it. Importing again replaces what was there.

    The archives are read and parsed once, into the store's staging folder, which is removed in the end.
    """
    staged = str(store.root / STAGING / "banks")
    parsed(files(spark, paths)).write.mode("overwrite").parquet(staged)
    tables = read_tables(spark.read.parquet(staged))
    # Small tables leave cores idle, so all are written at once.
    titles = [r.title for r in tables["summaries"].select("title").collect()]  # one per archive
    # Ids are made of dictionary, file and place, so they are unique if the titles are.
    unique = {name for name in tables if len(set(titles)) == len(titles) and KEYS[name] == ["id"]}
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda item: store.write(*item, unique=item[0] in unique), tables.items()))
    store.discard("banks")
    options = [DictionaryOptions(t) for t in titles]
    settings = store.settings()
    settings.profile.merge_dictionaries(options)
    store.save(settings)
    return options


def write_folder(path: str, index: dict, **banks: list) -> None:
    """Writes an archive folder, for tests and exports: banks by name, e.g. term_bank=[...]."""
    Path(path).mkdir(parents=True, exist_ok=True)
    (Path(path) / "index.json").write_text(json.dumps(index), encoding="utf-8")
    for name, rows in banks.items():
        (Path(path) / f"{name}_1.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
