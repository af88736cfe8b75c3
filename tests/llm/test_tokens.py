import base64
import random

import numpy as np
import pytest
import tiktoken

from wortlake.llm import bpe, encode, pack, split

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ALPHABET = "ab 's t'll 're'VE\n\t   　\xa0日本語éñ12３½Ⅷ.,!?-''́​\x1c\x85😀ß。「」\r"
HARD = ["a" * 5000, " " * 3000, "'s" * 500, "\n \n" * 99, "ab" * 70_000, "", None, "<|endoftext|>", "日" * 4000, "😀" * 900]


def reference(vocabulary):
    lines = open(f"{bpe.VOCABULARIES}/{vocabulary}", "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randrange(80))) for _ in range(n)] + HARD


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoder_is_exact(vocabulary):
    tables, given, known = bpe.load(vocabulary), texts(4000), reference(vocabulary)
    ids, counts = bpe.Encoder(tables).encode(given)
    ends = np.append(0, np.cumsum(counts))
    for i, text in enumerate(given):
        own = ids[ends[i] : ends[i + 1]]
        assert own.tolist() == known.encode_ordinary(text or ""), text
        assert tables.decode(own) == (text or "")


def test_very_long_text_is_whole(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    given = [" ".join(x or "" for x in texts(300)), None, "x"]
    ids, counts = bpe.Encoder(bpe.load()).encode(given)
    assert ids.tolist() == [i for t in given for i in reference("byte_bpe_50k.tiktoken").encode_ordinary(t or "")] and counts[1] == 0


def test_columns(spark):
    given, tables, known = texts(200), encode.shared(spark), reference("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "i int, text string, ids string")
    got = df.select("i", encode.token_ids("text", tables).alias("t"), encode.token_count("text", tables).alias("n"))
    for r in got.select("i", "t", "n", encode.decoded("t", tables).alias("back")).collect():
        assert r.t == known.encode_ordinary(given[r.i] or "") and r.n == len(r.t) and r.back == (given[r.i] or "")
    assert df.limit(0).select(encode.token_ids("text", tables)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pack(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, None, 1, 100, draw.randrange(40), draw.randrange(300), 101, 1000]) for _ in range(4000)]
    df = spark.createDataFrame([(i, s, 0) for i, s in enumerate(sizes)], "i int, s bigint, shard int")
    out = pack.pack(df, "i", "s", 100, rows=4000, shard_rows=1500, classes=10)
    rows = out.collect()
    loads, pieces = {}, {}
    for r in rows:
        loads[r.container] = loads.get(r.container, 0) + r.length
        pieces.setdefault(r.i, []).append((r.piece, r.first, r.length))
    assert max(loads.values()) <= 100
    for i, s in enumerate(sizes):
        s = s or 0
        want = [(k, k * 100, min(100, s - k * 100)) for k in range(max(1, -(-s // 100)))]
        assert sorted(pieces[i]) == want
    assert sum(s or 0 for s in sizes) / (100 * len(loads)) > 0.9
    again = {(r.i, r.piece): r.container for r in pack.pack(df.repartition(5), "i", "s", 100, rows=4000, shard_rows=1500, classes=10).collect()}
    assert again == {(r.i, r.piece): r.container for r in rows}
    assert pack.pack(df.limit(0), "i", "s", 100, rows=0).count() == 0


def test_pieces(spark):
    draw, known, limit, overlap = random.Random(5), reference("byte_bpe_50k.tiktoken"), 60, 12
    prose = [". ".join("word other thing " * draw.randrange(1, 5) for _ in range(30)) + "\n\n" * draw.randrange(2) for _ in range(30)]
    given = texts(100) + prose + ["これは文です。" * 200, "\r\n".join(["line of text"] * 90)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, text string")
    pieces = {}
    for r in split.split_texts(df, "i", "text", encode.shared(spark), limit, overlap).collect():
        pieces.setdefault(r.i, []).append(r)
    for i, text in enumerate(given):
        parts = sorted(pieces[i], key=lambda r: r.piece)
        ids = known.encode_ordinary(text or "")
        assert [r.piece for r in parts] == list(range(1, len(parts) + 1))
        if len(ids) <= limit:
            assert len(parts) == 1 and parts[0].text == text
        covered = 0
        for k, r in enumerate(parts):
            end = r.first_token + r.n_tokens
            assert r.n_tokens <= limit and (k == 0 or overlap <= covered - r.first_token <= overlap + 3)
            assert r.text is None or known.decode(ids[r.first_token : end]) == r.text
            assert len(known.encode_ordinary(r.text or "")) <= limit
            covered = end
        assert covered == len(ids)
    cut = [r.text for i in range(110, 140) for r in sorted(pieces[i], key=lambda r: r.piece)[:-1]]
    assert cut and sum(t.endswith((".", "\n")) for t in cut) / len(cut) > 0.9
    with pytest.raises(ValueError):
        split.split_texts(df, "i", "text", None, 60, 55)


def test_an_early_boundary_is_better_than_none(spark):
    text = "あ" * 20 + "。" + "\U00020000" * 200
    rows = split.split_texts(spark.createDataFrame([(1, text)], "i int, text string"), "i", "text", encode.shared(spark), 100, 10).orderBy("piece").collect()
    assert rows[0].text.endswith("。") and len(rows) > 2
