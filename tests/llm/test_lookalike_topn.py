import random
import unicodedata
from collections import defaultdict

import pytest

from wortlake.llm import lookalike, topn


def looks(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {r.i: r.p for r in df.select("i", lookalike.prototype("v").alias("p")).collect()}


def test_prototype(spark):
    same = [
        ("ｂâｎｅａｕ", "bâneau"), ("chígela", "chígela"), ("сһіɡеӏа", "chigela"), ("​x­⁠y﻿", "xy"), ("a　b ", "a b"),
        ("we‐cky−kafi", "we-cky-kafi"), ("ﬂunﬁsh", "flunfish"), ("ﾊﾞｶﾞｰ", "バガー"), ("⽊短", "木短"), ("へべぺ", "ヘベペ"), ("夕ニ口力卜工八一", "タ二ロカトエハー"),
        ("тёл", "тёл"), ("神", "神"), ("び︎わ", "びわ"), ("ў", "y̆"), ("№ 5", "No 5"), ("㈱", "(株)"), ("ﻻ", "لا"), ("ᾳ", "ᾳ"), ("ᎪᏴᏟ", "ABC"), ("ꓓꓳꓖ", "DOG"), ("ꜱᴏᴜ", "sou"), ("ﬃ", "ffi"),
    ]
    got = looks(spark, [v for pair in same for v in pair])
    for i, (a, b) in enumerate(same):
        assert unicodedata.normalize("NFC", got[2 * i]) == unicodedata.normalize("NFC", got[2 * i + 1]), (a, b)
    distinct = ["abc", "Abc", "ábc", "a bc", "a-bc", "かな", "カナ", "が", "か", "²", "2"]
    got = looks(spark, distinct)
    assert len({unicodedata.normalize("NFC", p) for p in got.values()}) == len(distinct)


def test_canonical(spark):
    rows = [("f", v, None) for v in ["ｃat", "cat", "cat", "сat", "dog", "ｄog", "ｄog", "", "​", None, "Cat"]] + [("f", "c­at", 7), ("g", "ｃat", None)]
    df = spark.createDataFrame(rows, "b string, v string, h bigint")
    got = {(r.b, r.v): r.canonical for r in lookalike.canonical_spellings(df, ["b"], "v", ["h"]).collect()}
    assert got[("f", "cat")] == got[("f", "ｃat")] == got[("f", "сat")] == "c­at"
    assert got[("f", "dog")] == "ｄog" and got[("f", "Cat")] == "Cat" and got[("g", "ｃat")] == "ｃat"
    assert got[("f", "")] == "" and got[("f", "​")] == "​" and got[("f", None)] is None
    assert lookalike.canonical_spellings(df.limit(0), ["b"], "v").count() == 0


def test_long_values(spark):
    assert looks(spark, ["ａ" * 200_000])[0] == "a" * 200_000


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_top_n(spark, heavy):
    draw = random.Random(heavy)
    rows = [(i, draw.choice(["hot"] * 8 + ["a", "b", "c", None, ""]), draw.choice([None, 0, 0, 0, 1, 5, 10**15, -3]), "x") for i in range(3000)] + [(1, "b", 5, "x")] * 2
    df = spark.createDataFrame(rows, "i int, g string, s bigint, _band string").drop("_band")
    got = sorted((r.g, r.rnk, r.s, r.i) for r in topn.top_n(df, "g", "s", ["i"], 7, heavy=heavy).collect())
    groups = defaultdict(list)
    for i, g, s, _ in rows:
        if g is not None and s is not None:
            groups[g].append((-s, i))
    want = sorted((g, k + 1, -s, i) for g, items in groups.items() for k, (s, i) in enumerate(sorted(items)[:7]))
    assert got == want
    assert topn.top_n(df.limit(0), "g", "s", ["i"], 7).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, "g", "s", ["i"], 0)


def test_top_n_clashing_columns(spark):
    df = spark.createDataFrame([("g", i, i, "x", "y", "z") for i in range(9)], "g string, s int, i int, _band string, _filled string, rnk string")
    assert sorted((r.rnk, r.i, r._band, r._filled) for r in topn.top_n(df, "g", "s", ["i"], 2, heavy=100).collect()) == [(1, 8, "x", "y"), (2, 7, "x", "y")]
