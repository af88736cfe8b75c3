"""Splitting oversized texts at natural boundaries, with an overlap between neighbours.

Method: the token offsets are prefix sums of the token sizes; the natural boundaries of the text are sorted
arrays of token indexes, one per level (paragraph, sentence or line, word). A piece ends at the last
boundary within the limit, found by binary search, on the highest level that has one in the second half of the piece (words:
anywhere beyond the overlap), then on any level that has one beyond the overlap, or else by a hard cut at the limit. The next piece starts an overlap back.
No cut, hard or not, divides a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wortlake.llm import bpe

_LEVELS = (
    re.compile(r"(?:\r\n?|\n)(?:[ \t]*(?:\r\n?|\n))+"),
    re.compile(r"[.!?…]+[\"')\]”’»]*(?=\s)|[。！？!?]+[」』）]*|\r\n?|\n"),
    re.compile(r"[、，；：]|[,;:](?=\s)|\S(?=\s)"),
)
LEAST_STEP = 8


def cuts(text: str, ids: np.ndarray, sizes: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (first token, end token, first character, end character) of one text and its ids."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins = np.append((raw & 0xC0) != 0x80, True)
    ends = np.append(0, np.cumsum(sizes[ids]))  # byte offset of each token border
    whole = begins[ends]
    chars = np.append(0, np.cumsum(begins[:-1]))[ends]  # character offset of each border
    borders = np.flatnonzero(whole)
    at = chars[borders]

    def of(pattern: re.Pattern) -> np.ndarray:
        wanted = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        found = np.searchsorted(at, wanted)
        return borders[found[at[np.minimum(found, len(at) - 1)] == wanted]]

    levels = [of(p) for p in _LEVELS]
    out, start, n, half = [], 0, len(ids), max(overlap, limit // 2)
    while n - start > limit:
        end = 0
        for level, least in [*zip(levels, (half, half, overlap), strict=True), *((level, overlap) for level in levels[:2])]:
            k = int(np.searchsorted(level, start + limit, "right")) - 1
            if k >= 0 and level[k] > start + least:
                end = int(level[k])
                break
        end = end or int(borders[np.searchsorted(borders, start + limit, "right") - 1])
        out.append((start, end, int(chars[start]), int(chars[end])))
        start = int(borders[np.searchsorted(borders, end - overlap, "right") - 1])
    out.append((start, n, int(chars[start]), int(chars[n])))
    return out


def split_texts(df: DataFrame, item: str, text: str, tables, limit: int, overlap: int) -> DataFrame:
    """(item, piece, first_token, n_tokens, text): every text as pieces of at most `limit` tokens, in order from 1.

    Texts within the limit are one piece, null and empty texts one piece of no tokens. Two neighbours share
    `overlap` tokens (up to 3 more where the overlap would start within a character). The pieces cover the
    whole text. Repeated rows give their pieces again; other columns of df are not read.
    """
    if overlap < 0 or limit - overlap < LEAST_STEP:
        raise ValueError(f"the limit must exceed the overlap by at least {LEAST_STEP}")
    source = df.select(item, text)
    schema = f"`{item}` {source.schema[0].dataType.simpleString()}, piece int, first_token bigint, n_tokens bigint, `{text}` string"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(tables.value)
        sizes = np.array(encoder.sizes, np.int64)
        for batch in batches:
            texts, done = batch.column(1).to_pylist(), 0
            for ids, counts in encoder.batches(texts):
                row, piece, first, length, pieces = [], [], [], [], []
                begin = 0
                for i, n in enumerate(counts.tolist(), done):
                    found = [(0, n, 0, None)] if n <= limit else cuts(texts[i], ids[begin : begin + n], sizes, limit, overlap)
                    for k, (a, b, c, d) in enumerate(found, 1):
                        row.append(i)
                        piece.append(k)
                        first.append(a)
                        length.append(b - a)
                        pieces.append(texts[i] if d is None else texts[i][c:d])
                    begin += n
                done += len(counts)
                arrays = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(length, pa.int64()), pa.array(pieces, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, [item, "piece", "first_token", "n_tokens", text])

    return source.mapInArrow(split, schema)
