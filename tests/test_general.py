import random

import pytest

from wortlake.operators import packed, references


def unpack(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return {r.i: r.v for r in df.select("i", packed.unpack("s").alias("v")).collect()}


def test_unpack_cases(spark):
    cases = {
        None: [], "": [], "  ": [], "n": ["n"], "n vs-i": ["n", "vs-i"], "a,b;;c|d/e": list("abcde"), "x　y\xa0z\tw": list("xyzw"),
        '"n, proper" hum': ["n, proper", "hum"], '"so-called ""slang""" x': ['so-called "slang"', "x"], "'so-called \"slang\"' t": ['so-called "slang"', "t"],
        '["so-called \\"slang\\"", "\\u4fd7\\u8a9e"]': ['so-called "slang"', "俗語"], "“and/or”・「see also」，v5k": ["and/or", "see also", "v5k"],
        "a:b+c.d_e-f 動:1": ["a:b+c.d_e-f", "動:1"], '"" a ""': ["a"], "a0b": ["a", "0", "b"], 'x "0" y': ["x", "0", "y"],
        'a"b c"d': ["a", "b c", "d"], "n n": ["n", "n"], 'open "quote': ["open", "quote"], "' '": [" "], "„x y“ “z ü” ‹a b›": ["x y", "z ü", "a b"],
    }
    got = unpack(spark, list(cases))
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_unpack_long(spark):
    text = " ".join(f'"v {i}" w{i}' for i in range(5000))
    assert len(unpack(spark, [text])[0]) == 10000


def test_unpacked_rows_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 7), (1, "a b", "x", 8)], "k int, fld string, val string, pos int")
    got = sorted(tuple(r) for r in packed.unpacked_rows(df, ["k"], ["fld", "val"], at_least=2).collect())
    assert got == [(1, "fld", 1, "a"), (1, "fld", 1, "a"), (1, "fld", 2, "b"), (1, "fld", 2, "b")]
    assert packed.unpacked_rows(df.limit(0), ["k"], ["fld"]).count() == 0


def test_runs(spark):
    df = spark.createDataFrame([("a", k) for k in (5, 1, 2, 3, 3, 9)] + [("b", None), (None, 4)], "g string, k bigint")
    got = sorted((r.g, r.lo, r.hi) for r in references.contiguous_runs(df, ["g"], "k").collect())
    assert got == [("a", 1, 4), ("a", 5, 6), ("a", 9, 10)]


@pytest.mark.parametrize("slot", [None, 16, references.SLOT])
def test_orphans_of_single_keys(spark, slot):
    draw = random.Random(3)
    parents = [(draw.choice("ab"), draw.randrange(200)) for _ in range(150)]
    refs = [(i, draw.choice(["a", "b", "c", None]), draw.choice([None, *range(-5, 210)])) for i in range(600)]
    p = spark.createDataFrame(parents, "g string, k bigint")
    r = spark.createDataFrame(refs, "i int, g string, k bigint")
    got = sorted(x.i for x in references.orphans(r, p, [("g", "g")], "k", "k", slot_width=slot).collect())
    assert got == [i for i, g, k in refs if (g, k) not in set(parents)]
    assert references.orphans(r, p.limit(0), [("g", "g")], "k", "k", slot_width=slot).count() == len(refs)


def test_status_of_ranges(spark):
    p = spark.createDataFrame([("a", 10, 20), ("a", 20, 30), ("a", 50, None), ("a", 60, 55)], "g string, lo bigint, hi bigint")
    r = spark.createDataFrame([(k, "a") for k in (9, 10, 29, 30, 49, 50, 999)] + [(1, "z"), (2, None)], "k bigint, g string")
    got = {x.k: x.status for x in references.as_of_status(r, p, [("g", "g")], "k", "lo", "hi").collect()}
    assert got == {9: "not_yet", 10: None, 29: None, 30: "deleted", 49: "deleted", 50: None, 999: None, 1: "missing", 2: "missing"}


def test_orphans_keep_clashing_columns(spark):
    r = spark.createDataFrame([(1, "a", "x", "y", "z")], "k bigint, g string, _g0 string, _runs string, lo string")
    p = spark.createDataFrame([("a", 5)], "g string, k bigint")
    (got,) = references.orphans(r, p, [("g", "g")], "k", "k").collect()
    assert tuple(got) == (1, "a", "x", "y", "z", "missing")


def test_ranges_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(references, "CHUNK", 7)
    draw = random.Random(8)
    parents = [(draw.choice(["hot"] * 9 + ["a"]), lo, draw.choice([lo + 1, lo + 3, lo + 9])) for lo in (draw.randrange(5000) for _ in range(1500))]
    refs = [(i, draw.choice(["hot"] * 5 + ["a", "none"]), draw.randrange(-3, 5020)) for i in range(3000)]
    p, r = spark.createDataFrame(parents, "g string, lo bigint, hi bigint"), spark.createDataFrame(refs, "i int, g string, k bigint")
    got = {x.i: x.status for x in references.as_of_status(r, p, [("g", "g")], "k", "lo", "hi").collect()}
    alive = {(g, k) for g, lo, hi in parents for k in range(lo, hi)}
    first = {g: min(lo for h, lo, _ in parents if h == g) for g, _, _ in parents}
    assert got == {i: None if (g, k) in alive else "missing" if g not in first else "not_yet" if k < first[g] else "deleted" for i, g, k in refs}
