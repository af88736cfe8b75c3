import itertools
import random
from collections import Counter

import pytest

from wortlake.llm import markup
from wortlake.llm.queries import QUERIES

MARKED = [
    "<b>x</b> y", "<i>open", "stray</p>", 'cut <span data-x="a>b" class=', "a &amp; b", "&#x72;iver", "&amp;quot;x&amp;quot;", "&lt;b&gt;x&lt;/b&gt;", "x <!-- c --> y",
    "**b** x", "*i* x", "__b__: x", "~~s~~ x", "`c` x", "[t](u/1) x", "![t](u.png)", "x [^1]\n\n[^1]: y", "## h\nx", "Sentence. ## h\nx", "h\n=====\nx", "- a\n- b", "> q\n\nx",
    "x. > q\n\ny", "a\n\n***\n\nb", "| a | b |\n|---|---|\n| c | d |", "x\n```\ncode\n```", "[[a|b]]", "[[a]]", "[[File:a.svg|thumb]]", "{{t|x}}", "'''b'''", "''i''", "== h ==\nx",
    '{| class="t"\n! a\n|-\n| b\n|} x', "文。{| \n! a\n|}", "# a\n#: b", "* a\n** b", "\\emph{x}", "\\section*{x} y", "\\begin{itemize}\\item a\\end{itemize}", "a\\\\ b\\footnote{c}", "a~\\cite{k}",
    "M\\\"{u}tze", "caf\\'{e}", "$x_{2} + y^2$", "$$\\sum_i x_i$$", "\\(a^2 < b\\)", "\\[ \\frac{a}{b} \\]", "H<sub>2</sub>O", "<nowiki>x</nowiki>",
]
PLAIN = [
    "R&D, Q&A; x", "a | b; x", "x (1 < 7)", "8 * 3 = n; x", "{a, b} x", "market > orchard: x", "a -> b. x", "*moxkoor, unattested form. x", "50% x, &c. y", "No. #84: x", "x <3",
    "C:\\dict\\88 x", "a = b + c; x", "~ word: x", "x [20]", "x [sic]", "costs $5, sometimes $7; x", "key_34_name; x", "road / lantern — x", "", " ", "«x»", "1. x", "don't 'quote'",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert any(path != "/" for path, _, _ in markup.parse(text))


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert all(path == "/" for path, _, _ in markup.parse(text)) and markup.clean(markup.parse(text), {}) == text.strip()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<h3>Head</h3>Text <b>bold</b>.<br/>More", "Head\nText bold.\nMore"),
        ("<ul><li>a</li><li>b<ol><li>c</ol></ul>", "• a\n• b\n• c"),
        ("x<pre><code>a =&gt; b\n  if c &lt; d</code></pre>", "x\na => b\n  if c < d"),
        ("<p>y $\\frac{2}{n}$</p>", "y \\frac{2}{n}"),
        ("&lt;p&gt;T&lt;/p&gt;", "T"),
        ("### h\n\npara\n\n- a\n- *b*", "h\npara\n• a\n• b"),
        ("\\subsection{Z} Text \\textit{i}", "Z\nText i"),
        ("M\\\"{u}tze", "Mütze"),
    ],
)
def test_clean(text, want):
    assert markup.clean(markup.parse(text), {}) == want


def test_hard_texts_end():
    for text in ["<" * 20_000, "*" * 20_000, "[[" * 9_000, "{{" * 9_000, "<a href='" * 3_000, "\\emph{" * 150, "`" * 9_999, "_a" * 9_000, "$" * 9_999, "&" * 9_999, "#" * 9_999, "<div>" * 9_000]:
        markup.parse(text)


def test_columns(spark):
    sentence = "This is a sentence of prose, long enough to count; it has commas."
    rows = [(i, f"<div>{sentence}</div><script>var q={i};</script>") for i in range(50)] + [(99, "plain"), (100, None), (101, ""), (102, "a < b")]
    df = spark.createDataFrame(rows, "i int, t string")
    ratios = markup.path_ratios(markup.nodes_of(df, [], "t"))
    content = markup.known_paths(ratios)
    assert not content["/script"] and content["/div"]
    got = {r.i: r.c for r in df.select("i", markup.clean_text(df.t, content).alias("c")).collect()}
    assert got[7] == sentence and got[99] == "plain" and got[100] is None and got[101] == "" and got[102] == "a < b"
    assert markup.path_ratios(markup.nodes_of(df.limit(0), [], "t")).count() == 0


def test_what_is_parsed_is_suspect():
    """The filter before the parser leaves out nothing that the parser would mark."""
    draw = random.Random(6)
    pieces = ["-", "---", "- ", " ", "\n", "\t", "a", "word", ".", "!", "。", ":", ";", "+", "=", "===", "'", "''", "*", "_", "#", ">", "1. ", "~", "|", "`", "Title", "body", "end.---"]
    texts = ["Title\n-----\nbody", "one\n\n---\n\ntwo", "end.---", "a\r\n---\r\nb", *MARKED] + ["".join(draw.choice(pieces) for _ in range(draw.randrange(1, 12))) for _ in range(30_000)]
    missed = [t for t in texts if not markup._SUSPECT.search(t.replace("\r\n", "\n")) and any(path != "/" for path, _, _ in markup.parse(t))]
    assert not missed, missed[:5]


def test_long_marks():
    uri = "data:image/png;base64," + "iVBOR" * 4000
    assert markup.clean(markup.parse(f'see <img src="{uri}"> here'), {}) == "see here"
    assert markup.clean(markup.parse("a **" + "word " * 3000 + "end** b"), {}) == "a " + "word " * 3000 + "end b"
    assert markup.clean(markup.parse("x `" + "c " * 5000 + "d` y"), {}) == "x " + "c " * 5000 + "d y"
    assert markup.clean(markup.parse("x {{" + "t|" * 6000 + "}} y"), {"/template": False}) == "x y"


def test_signs_that_look_like_marks():
    for text in ["C:\\new\\item list", "array[0](x)"]:
        assert markup.clean(markup.parse(text), {}) == text


def test_rare_paths_fall_to_the_path_above():
    content = {"/": True, "/div": True, "/script": False, "/div/b": True}
    assert markup.is_noise("/script/x", content) and markup.is_noise("/script/b", content)
    assert not any(markup.is_noise(p, content) for p in ("/div/x/x", "/div/p/b", "/x", "/"))


#: A labelled set: what must be kept of a text, and what must go.
LABELLED = [
    ("<h2>Head</h2><p>One <b>two</b>.</p><script>var x = 1;</script>", ["Head", "One two."], ["var x", "<b>", "script"]),
    ("<ul><li>first</li><li>second</li></ul><!-- note -->", ["first", "second"], ["note", "<li"]),
    ("== Head ==\n* item '''bold'''\n{{template|x}} end", ["Head", "item bold", "end"], ["==", "'''", "template"]),
    ("[[page|shown]] and [text](http://u.example/x)", ["shown and text"], ["[[", "](", "u.example"]),
    ("\\section{Head} body \\emph{it} $x^2$ \\cite{key}", ["Head", "body it", "x^2"], ["\\section", "\\emph", "key"]),
    ("# Head\n\n- a\n- b\n\n```\ncode()\n```", ["Head", "a", "b", "code()"], ["#", "```"]),
    ("x &amp; y &lt;z&gt; <ruby>漢<rp>(</rp><rt>かん</rt><rp>)</rp></ruby>", ["x & y <z>", "漢"], ["&amp;", "<ruby", "(", ")"]),
]


def test_clean_of_a_labelled_set(spark):
    sentence = "This is a sentence of prose, long enough to count; it has commas."
    corpus = [t for t, _, _ in LABELLED] + [f"<p>{sentence}</p><div>{sentence} {i}</div>" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(corpus)), "i int, t string")
    content = markup.known_paths(markup.path_ratios(markup.nodes_of(df, [], "t")))
    got = {r.i: r.c for r in df.select("i", markup.clean_text(df.t, content).alias("c")).collect()}
    kept = [(p in got[i], p) for i, (_, keep, _) in enumerate(LABELLED) for p in keep]
    gone = [(p not in got[i], p) for i, (_, _, drop) in enumerate(LABELLED) for p in drop]
    assert sum(ok for ok, _ in kept) / len(kept) >= 0.95, kept
    assert sum(ok for ok, _ in gone) / len(gone) >= 0.95, gone


def _many_paths() -> list[str]:
    """Texts with more than 20,000 tag paths. /x/x is noise; the last text is long prose on /x/x/x, as rare a path as any."""
    sentence = "This is a sentence of prose, long enough to count; it has commas."
    tags = sorted((markup.BLOCKS | markup.INLINE) - {"p", "tr", "hr", "html"})[:28]
    texts = [f"<{a}>{sentence}<{b}>{sentence}<{c}>{sentence}" for a, b, c in itertools.product(tags, repeat=3)]
    return texts + ["<x><x>q"] * 400 + ["<x><x><x>" + " ".join([sentence] * 300)]


def test_every_path_has_a_ratio(spark, tmp_path):
    texts = _many_paths()
    items = spark.createDataFrame([(i, [("Content", t, None)]) for i, t in enumerate(texts)], "import_ord bigint, glossary array<struct<kind:string,plain_text:string,html:string>>")
    items.write.parquet(f"{tmp_path}/terms.parquet")
    want: dict[str, list[int]] = {}
    for text in texts:
        for path, chars, punct in markup._stat(markup.parse(text)):
            sums = want.setdefault(path, [0, 0, 0, 0])
            sums[:] = [a + b for a, b in zip(sums, (1, chars > 0, chars, punct), strict=True)]
    rows = QUERIES["p5_paths"](spark, str(tmp_path)).collect()
    assert len(want) > 20_000 and {r.path: [r.nodes, r.leaves, r.chars, r.punct] for r in rows} == want
    content = {r.path: r.content for r in rows}
    assert not content["/x/x"] and content["/x/x/x"]
    got = {r.import_ord: r.clean for r in QUERIES["p5_clean"](spark, str(tmp_path)).collect()}
    assert got == {i: markup.clean(markup.parse(t), content) for i, t in enumerate(texts)} and got[len(texts) - 1].startswith("This is") and not got[len(texts) - 2]
    assert QUERIES["p5_found"](spark, str(tmp_path)).count() == len(texts)


def test_clean_rows(spark):
    sentence = "This is a sentence of prose, long enough to count; it has commas."
    rows = [(i, f"<div>{sentence}</div><script>var q={i};</script>") for i in range(50)]
    rows += [(7, "<div>again</div><!-- x -->"), (7, None), (99, "plain"), (100, ""), (101, "a < b"), (None, "<script>q</script>x"), (None, "<b>y</b>")]
    df = spark.createDataFrame(rows, "i int, t string")
    nodes = markup.path_sums(markup.nodes_of(df, ["i"], "t"), "i")
    ratios = markup.path_ratios(nodes)
    want = df.select("i", "t", markup.clean_text(df.t, markup.known_paths(ratios)).alias("clean"))
    made = markup.clean_rows(df, ["i"], "t", nodes, ratios)
    assert made.columns == want.columns and Counter(made.collect()) == Counter(want.collect())
    assert markup.clean_rows(df.limit(0), ["i"], "t", nodes.limit(0), markup.path_ratios(nodes.limit(0))).count() == 0
