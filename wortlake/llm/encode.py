"""Encoding of a column of texts with a public tokenizer, on Arrow batches. See `bpe` for the method."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from wortlake.llm import bpe


def shared(spark: SparkSession, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = bpe.VOCABULARIES):
    """The vocabulary's tables, broadcast: some 3 MB for 50,000 tokens, whatever the corpus."""
    return spark.sparkContext.broadcast(bpe.load(vocabulary, folder))


def token_ids(text: Column | str, tables) -> Column:
    """The ids of each text as ARRAY<INT>, without special tokens; null and empty texts give an empty array.

    Strings that spell a special token are ordinary text. Texts of any length are encoded whole.
    """

    def encode(texts: pa.Array) -> pa.Array:
        ids, counts = bpe.encoder(tables.value).encode(texts.to_pylist())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))

    return arrow_udf(encode, "array<int>")(text)


def token_count(text: Column | str, tables) -> Column:
    """The number of ids of each text as BIGINT; 0 for null and empty texts."""

    def count(texts: pa.Array) -> pa.Array:
        parts = [counts for _, counts in bpe.encoder(tables.value).batches(texts.to_pylist())]
        return pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]), pa.int64())

    return arrow_udf(count, "bigint")(text)


def decoded(ids: Column | str, tables) -> Column:
    """The text of each array of ids; null gives null. Bytes that are no UTF-8 become U+FFFD."""

    def decode(lists: pa.Array) -> pa.Array:
        loaded = tables.value
        return pa.array([None if x is None else loaded.decode(x) for x in lists.to_pylist()], pa.string())

    return arrow_udf(decode, "string")(ids)
