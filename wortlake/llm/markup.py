"""Markup residue in short texts: HTML, Markdown, wiki and LaTeX, whole or broken, to clean text.

Method: tag-path ratios. A lenient parser turns each text into leaf nodes with their root-to-leaf tag path
(marks of Markdown, wiki and LaTeX count as the tags they stand for). Per path, text length and punctuation
are summed over the corpus (combined map-side), divided by the nodes, smoothed towards the parent path,
fused, and held against a threshold: paths below it are noise, like scripts, comments, link targets and
ruby brackets. Headings, lists, code, formulas and inline marks are structure and stay whatever their ratio.

The parser runs on Arrow batches, and only for texts that hold a character or line start that can be markup.
Paths are whole, from the root to the leaf, with inline tags; tag names outside TAGS count as one name. Every path has a ratio of its own: the
table of paths is a DataFrame of any length, which meets the texts by joins (`clean_rows`).
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

NESTED = 60  # deeper marks are text; open tags beyond it are not in paths
SMOOTHING = 20.0  # leaves' worth of the parent's ratio
PUNCTUATION_BASE = 0.25  # the weight of a leaf without punctuation
THRESHOLD = 0.6  # of the corpus mean
# Element names and names that stand for other marks.
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figure footer form header hr html main nav ol p pre section summary table tbody tfoot thead tr ul".split())
INLINE = set("a abbr b bdi big cite del dfn em font i ins kbd mark nowiki q ruby s samp small span strike strong sub sup tt u var".split())
STRUCTURE = set("h1 h2 h3 h4 h5 h6 td th caption li dd dt code pre math mi mo mn mrow msup msub mfrac br hr entity".split())
NOISE_TAGS = set("comment script style rp rt ref template file href env head title img input link meta".split())
TAGS = BLOCKS | INLINE | STRUCTURE | NOISE_TAGS
VOID = set("br hr img input link meta wbr".split())
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
# LaTeX commands that occur without an argument, and accents.
BARE = "item|ldots|dots|par|noindent|newline|quad|qquad|LaTeX|TeX|frac|sum|prod|int|sqrt|cdot|times|leq|geq|infty|alpha|beta|gamma|delta|lambda|pi|to|hline|centering|textbackslash"
ACCENTS = {"'": "́", "`": "̀", '"': "̈", "^": "̂", "~": "̃", "=": "̄", ".": "̇", "c": "̧", "v": "̌", "u": "̆", "H": "̋", "k": "̨", "r": "̊", "d": "̣", "b": "̱"}
SECTIONS = {"part": "h1", "chapter": "h1", "section": "h2", "subsection": "h3", "subsubsection": "h4", "paragraph": "h5"}
LATEX_TAGS = {"textbf": "b", "emph": "em", "textit": "i", "texttt": "code", "underline": "u", "footnote": "ref", "cite": "ref", "ref": "ref", "label": "ref", "href": "href", "url": "href"}
MATH_ENVIRONMENTS = "equation|align|math|displaymath|eqnarray|gather|multline"
FILES = "File|Image|Media|Datei|Bild|Fichier|Archivo|Imagen|Файл|ファイル|画像"
ENTITIES_WITHOUT_END = "amp|lt|gt|quot|apos|nbsp|mdash|ndash|hellip|eacute|laquo|raquo"

#: What a text must hold to be parsed at all.
SUSPECT = r"(?m)[<>&*_#\[\]{}|~`$^\\=]|''|^[ \t]*[-+:;][ \t]|(?:^|[.!?。！？])[ \t]*(?:-[ \t]*){3,}$"

_ATTRIBUTES = r"""(?:"[^"]*+"|'[^']*+'|[^<>"'])*+"""
#: Marks that start a line, or follow the end of a sentence where lines were joined.
_STARTING = {
    "fence": r"[ \t]*(?:```|~~~)[^\n]*\n(?P<fence_x>(?s:.*?))(?:\n[ \t]*(?:```|~~~)[ \t]*$|\Z)",
    "wikitable": r"[ \t]*\{\|(?P<wikitable_x>(?s:.*?))(?:^\|\}|\Z)",
    "rule": r"[ \t]*(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$",
    "wikihead": r"[ \t]*(?P<wikihead_n>={2,6})[ \t]*(?P<wikihead_x>[^\n=]+?)[ \t]*(?P=wikihead_n)[ \t]*$",
    "wikilist": r"[ \t]*(?:#[#*:;]*[ \t]+(?=[^\n]*\n#[:*#])|#+[:*;]+[ \t]*|\*{2,}[ \t]+|\*+[:;]+[ \t]+)(?=\S)",
    "head": r"[ \t]*(?P<head_n>#{1,6})[ \t]+(?P<head_x>[^\n]*?)[ \t]*#*[ \t]*$",
    "quote": r"(?:(?<![.!?。！？])|[ \t]*(?=>[^\n]*\n\n))>[ \t]?",
    "list": r"(?:(?<![.!?。！？])[ \t]*|[ \t]*(?=[-*+][^\n]*\n[-*+]))[-*+][ \t]+(?=\S)",
    "indent": r"(?<![.!?。！？])[:;][ \t]+(?=\S)",
    "row": r"[ \t]*\|(?P<row_x>[^\n]*)\|[ \t]*$",
}
_INLINE = {
    "comment": r"<!--(?P<comment_x>(?s:.*?))(?:-->|\Z)",
    "raw": r"<(?P<raw_t>script|style)\b[^>]*>(?P<raw_x>(?s:.*?))(?:</(?P=raw_t)\s*>|\Z)",
    "close": r"</(?P<close_t>[A-Za-z][\w:-]*)\s*(?:>|\Z)",
    "tag": rf"<(?P<tag_t>[A-Za-z][\w:-]*)(?:[\s/]{_ATTRIBUTES})?>",
    "broken": rf"<(?P<broken_t>[A-Za-z][\w:-]*)\s+[\w:-]+\s*={_ATTRIBUTES}[\"']?",
    "entity": rf"&(?:#\d+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{ENTITIES_WITHOUT_END})\b)",
    "math": r"\$\$(?P<math_a>(?s:.+?))\$\$|\$(?=[^\s$])(?P<math_b>[^$\n]*)(?<=\S)\$(?!\d)|\\\((?P<math_c>(?:(?!\\\()(?s:.))+?)\\\)|\\\[(?P<math_d>(?:(?!\\\[)(?s:.))+?)\\\]"
    rf"|\\begin\{{(?P<math_t>(?:{MATH_ENVIRONMENTS})\*?)\}}(?P<math_e>(?s:.*?))(?:\\end\{{(?P=math_t)\}}|\Z)",
    "file": rf"\[\[(?:{FILES}):(?P<file_x>[^\[\]]*)\]\]",
    "wikilink": r"\[\[(?P<wikilink_a>[^\[\]|]*)(?:\|(?P<wikilink_b>[^\[\]]*))?\]\]",
    "template": r"\{\{(?P<template_x>[^{}]*)\}\}",
    "image": r"!\[(?P<image_x>[^\[\]]*)\]\((?P<image_u>[^()\s]*)[^()]*\)",
    "note": r"^\[\^[^\]\s]+\]:[ \t]*|\[\^[^\]\s]+\]",
    "link": r"(?:(?<!\w)|(?=\[[^\[\]\n]+\]\([^()\s]*[/.#:]))\[(?P<link_x>[^\[\]\n]+)\]\((?P<link_u>[^()\s]+)(?:\s+\"[^\"]*\")?\)",
    "broken_wiki": r"\[\[|\]\]|\{\{|\}\}",
    "span": r"(?<!`)(?P<span_n>`+)(?!`)(?P<span_x>(?s:.+?))(?<!`)(?P=span_n)(?!`)",
    "wikibold": r"(?P<wikibold_n>'{5}|'''|'')(?P<wikibold_x>[^'\n](?:[^\n]*?[^'\n])?)(?P=wikibold_n)(?!')",
    "strong": r"(?<!\*)(?P<strong_n>\*{2,3})(?P<strong_x>[^\s*](?:[^\n]*?[^\s*])?)(?P=strong_n)(?!\*)",
    "emphasis": r"(?<![A-Za-z0-9*\\])\*(?P<emphasis_x>[^\s*](?:[^*\n]*[^\s*])?)\*(?![A-Za-z0-9*])",
    "under": r"(?<!\w)(?P<under_n>_{1,3})(?P<under_x>[^\s_](?:[^\n]*?[^\s_])?)(?P=under_n)(?!\w)",
    "strike": r"~~(?P<strike_x>[^\s~](?:[^\n]*?[^\s~])?)~~",
    "broken_bold": r"(?<![\w*])\*\*(?=\w)",
    "accent": r"\\(?P<accent_a>['\"`^~=.])\s*(?:\{\\?(?P<accent_x>[A-Za-z])\}|(?P<accent_y>[A-Za-z]))|\\(?P<accent_b>[cvuHkrdb])\{(?P<accent_z>[A-Za-z])\}",
    "end": r"\\(?P<end_k>begin|end)\{(?P<end_x>[A-Za-z]+\*?)\}(?:\[[^\]]*\])?(?:\{[lcr|]+\})?",
    "command": r"~?\\(?P<command_t>[A-Za-z]+)\*?(?:\[[^\]]*\])?\{",
    "bare": rf"\\(?!(?<=[A-Za-z]\\)item)(?P<bare_t>{BARE})\b[ \t]?",
    "newline": r"\\\\(?=\s|$|\[)(?:\[[^\]]*\])?",
    "escape": r"\\(?P<escape_x>[%&_#$*`\[\]{}!|>~])",
}
_named = lambda table: "|".join(f"(?P<{name}>{pattern})" for name, pattern in table.items())
_SETEXT = r"^(?P<setext>(?P<setext_x>[^\n]+)\n(?:={3,}|-{3,})[ \t]*$)"
_MARK = re.compile(rf"{_SETEXT}|(?:^|(?<=[.!?。！？]))(?:{_named(_STARTING)})|(?=[<>&$\\\[\]{{}}|`*_~'!])(?:{_named(_INLINE)})", re.M | re.I)
_SUSPECT = re.compile(SUSPECT)
_REAL_TAG = re.compile(rf"</?[A-Za-z][\w:-]*(?:[\s/]{_ATTRIBUTES})?>")
_ESCAPED_TAG = re.compile(r"&(?:amp;)*(?:lt|#60|#x3c);/?[A-Za-z][^&]*&(?:amp;)*(?:gt|#62|#x3e);", re.I)
#: Punctuation of prose: it ends a word, or is a full-width mark.
_PUNCTUATION = re.compile(r"[.,!?;:](?=\s|$)|[、。！？，；：]")
_SEPARATOR_ROW = re.compile(r"[\s:|-]+")

Node = tuple[str, str, str]  # path, text, what goes before the text: "", a space, a line end or a line end with a bullet


def tag_path(stack: list[str]) -> str:
    return "/" + "/".join(t if t in TAGS else "x" for t in stack)


class _Parser:
    def __init__(self):
        self.nodes: list[Node] = []
        self.stack: list[str] = []
        self.lead = ""
        self.nested = 0

    def emit(self, text: str, *tags: str) -> None:
        if text:
            self.nodes.append((tag_path([*self.stack, *tags]), text, self.lead))
            self.lead = ""

    def mark(self, tag: str) -> None:
        """A mark without text of its own."""
        self.nodes.append((tag_path([*self.stack, tag]), "", ""))

    def line(self, bullet: bool = False) -> None:
        self.lead = "\n• " if bullet else self.lead if "\n" in self.lead else "\n"

    def inside(self, text: str, *tags: str, block: bool = False) -> None:
        depth = len(self.stack)
        if block:
            self.line()
        self.mark(tags[-1])
        self.stack.extend(tags)
        self.nested += 1
        self.walk(text) if self.nested <= NESTED else self.emit(text)
        self.nested -= 1
        del self.stack[depth:]
        if block:
            self.line()

    def walk(self, text: str) -> None:
        at = 0
        for m in iter(lambda: _MARK.search(text, at), None):
            self.emit(text[at : m.start()])
            after = getattr(self, f"on_{m.lastgroup}")(m, text, m)
            at = m.end() if after is None else after
            if at == m.start():  # no mark is empty; were one, it must not loop
                self.emit(text[at : at + 1])
                at += 1
        self.emit(text[at:])

    def on_fence(self, g, text, m):
        self.line()
        self.emit(g["fence_x"] or " ", "pre", "code")
        self.line()

    def on_comment(self, g, text, m):
        self.emit(g["comment_x"] or " ", "comment")

    def on_raw(self, g, text, m):
        self.emit(g["raw_x"] or " ", g["raw_t"].lower())

    def on_close(self, g, text, m):
        tag = g["close_t"].lower()
        self.mark(tag)
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]
        if tag not in INLINE and tag in TAGS:
            self.line() if tag in BLOCKS or tag in STRUCTURE and not tag.startswith("m") else None

    def on_tag(self, g, text, m):
        tag = (g["tag_t"] or g["broken_t"]).lower()
        self.mark(tag)
        for closed in CLOSES.get(tag, ()):
            if closed in self.stack[-2:]:
                del self.stack[len(self.stack) - 1 - self.stack[::-1].index(closed) :]
        if tag == "li":
            self.line(bullet=True)
        elif tag in BLOCKS or tag in ("br", "dt", "dd") or re.fullmatch("h[1-6]", tag):
            self.line()
        elif tag in ("td", "th"):
            self.lead = self.lead or "\t"
        if tag not in VOID and not m.group().endswith("/>") and m.lastgroup == "tag" and len(self.stack) < NESTED:
            self.stack.append(tag)

    def on_broken(self, g, text, m):
        self.on_tag(g, text, m)

    def on_entity(self, g, text, m):
        decoded = g["entity"]
        for _ in range(3):
            decoded = html.unescape(decoded)
        follows = text[m.end() :]
        if decoded == "&" and (more := re.match(r"(?:amp;)*(#\d+;|#x[0-9a-f]+;|[A-Za-z][A-Za-z0-9]{1,31};)", follows, re.I)) and html.unescape("&" + more[1]) != "&" + more[1]:
            self.emit(html.unescape("&" + more[1]), "entity")
            return m.end() + more.end()
        self.emit(decoded.replace("\xa0", " "), "entity")

    def on_math(self, g, text, m):
        self.emit(next(g[k] for k in ("math_a", "math_b", "math_c", "math_d", "math_e") if g[k] is not None).strip() or " ", "math")

    def on_file(self, g, text, m):
        self.emit(g["file_x"] or " ", "file")

    def on_wikilink(self, g, text, m):
        self.inside(g["wikilink_a"] if g["wikilink_b"] is None else g["wikilink_b"], "a")

    def on_wikitable(self, g, text, m):
        for line in g["wikitable_x"].split("\n")[1:]:
            tag = "th" if line.startswith("!") else "td"
            if not line.startswith("|-"):
                self.line()
                for cell in re.split(r"\|\||!!", line.lstrip("|!+ ")):
                    self.inside(cell.strip(), "table", tag)
                    self.lead = "\t"
        self.mark("table")
        self.line()

    def on_template(self, g, text, m):
        self.emit(g["template_x"] or " ", "template")

    def on_image(self, g, text, m):
        self.emit(g["image_u"] or " ", "href")
        self.inside(g["image_x"], "a")

    def on_note(self, g, text, m):
        self.emit(g["note"], "ref")

    def on_link(self, g, text, m):
        self.inside(g["link_x"], "a")
        self.emit(g["link_u"], "href")

    def on_broken_wiki(self, g, text, m):
        self.mark("template")

    def on_rule(self, g, text, m):
        self.mark("hr")
        self.line()

    def on_setext(self, g, text, m):
        self.inside(g["setext_x"], "h2", block=True)

    def on_wikihead(self, g, text, m):
        self.inside(g["wikihead_x"], f"h{len(g['wikihead_n'])}", block=True)

    def on_head(self, g, text, m):
        self.inside(g["head_x"], f"h{len(g['head_n'])}", block=True)

    def on_list(self, g, text, m):
        self.mark("li")
        self.line(bullet=True)

    on_wikilist = on_list

    def on_indent(self, g, text, m):
        self.mark("dd")
        self.line()

    def on_quote(self, g, text, m):
        self.mark("blockquote")
        self.line()

    def on_row(self, g, text, m):
        self.line()
        self.mark("table")
        if not _SEPARATOR_ROW.fullmatch(g["row_x"]):
            for cell in g["row_x"].split("|"):
                self.inside(cell.strip(), "table", "td")
                self.lead = "\t"
        self.line()

    def on_span(self, g, text, m):
        self.emit(g["span_x"], "code")

    def on_wikibold(self, g, text, m):
        self.inside(g["wikibold_x"], "b" if len(g["wikibold_n"]) > 2 else "i")

    def on_strong(self, g, text, m):
        self.inside(g["strong_x"], "strong")

    def on_emphasis(self, g, text, m):
        self.inside(g["emphasis_x"], "em")

    def on_under(self, g, text, m):
        self.inside(g["under_x"], "em")

    def on_strike(self, g, text, m):
        self.inside(g["strike_x"], "del")

    def on_broken_bold(self, g, text, m):
        self.mark("b")

    def on_accent(self, g, text, m):
        self.emit(unicodedata.normalize("NFC", (g["accent_x"] or g["accent_y"] or g["accent_z"]) + ACCENTS[g["accent_a"] or g["accent_b"]]), "entity")

    def on_end(self, g, text, m):
        self.mark("env")
        self.line()

    def on_command(self, g, text, m):
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        inner, tag = text[m.end() : end - (not depth)], g["command_t"]
        if tag in SECTIONS:
            self.inside(inner, SECTIONS[tag], block=True)
        elif LATEX_TAGS.get(tag) in ("ref", "href"):
            self.emit(inner or " ", LATEX_TAGS[tag])
        else:
            self.inside(inner, LATEX_TAGS.get(tag, "span"))
        return end

    def on_bare(self, g, text, m):
        if g["bare_t"] == "item":
            self.mark("li")
            self.line(bullet=True)
        else:
            self.mark("env")
            self.emit({"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "textbackslash": "\\"}.get(g["bare_t"], " "))

    def on_newline(self, g, text, m):
        self.mark("br")
        self.line()

    def on_escape(self, g, text, m):
        self.emit(g["escape_x"], "entity")


def parse(text: str) -> list[Node]:
    """The leaf nodes of a text, in order; marks without text are nodes with empty text. Plain text is one node at "/"."""
    parser = _Parser()
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    for _ in range(2):
        if _ESCAPED_TAG.search(text) and not _REAL_TAG.search(text):  # markup escaped as a whole
            parser.mark("entity")
            text = html.unescape(text.replace("&amp;", "&"))
    parser.walk(text)
    return parser.nodes


def is_noise(path: str, content: dict[str, bool]) -> bool:
    """Whether a path is no content: by its own ratio or, for a path without one, that of the nearest path above it that has one. Structure and
    inline marks outside of noise tags are content."""
    if path not in content:
        tags = path.split("/")
        if path == "/" or tags[-1] in _KEPT and NOISE_TAGS.isdisjoint(tags):
            return False
        while path and path not in content:
            path = path.rpartition("/")[0]
    return not content.get(path, True)


_KEPT = STRUCTURE | INLINE


def clean(nodes: list[Node], content: dict[str, bool]) -> str:
    """The text of the nodes off the noise paths: headings and items on lines of their own, items with a bullet, code and formulas as they are."""
    out = ""
    for path, text, lead in nodes:
        out += lead
        if not text or is_noise(path, content):
            continue
        if not {"code", "pre", "math"}.isdisjoint(path.split("/")):
            out += text
        else:
            text = re.sub(r"[ \t\xa0]+", " ", text).replace("\n ", "\n")
            out += text.lstrip() if out.endswith(("\n", "• ")) else text.lstrip(" ") if out.endswith(" ") else text
    out = re.sub(r"[ \t]+\n", "\n", out)
    return re.sub(r"(?:\n(?:•(?: |$))?)+(?=\n|$)", "", out).strip("\n\t ")


def _stat(nodes: list[Node]) -> Iterator[tuple[str, int, int]]:
    for path, text, _ in nodes:
        bare = text.strip()
        yield path, len(bare), len(_PUNCTUATION.findall(bare))


def tag_paths(text: Column) -> Column:
    """The leaf nodes of a text without the text: ARRAY<STRUCT<path, chars, punct>>. Null and empty give an empty array."""

    def parsed(texts: pa.Array) -> pa.Array:
        rows = [[{"path": p, "chars": c, "punct": k} for p, c, k in _stat(parse(t))] if t else [] for t in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int32()), ("punct", pa.int32())])))

    return arrow_udf(parsed, "array<struct<path:string,chars:int,punct:int>>")(text)


def nodes_of(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, chars, punct), one row per leaf node of the texts that may hold markup, in any order."""
    return df.where(F.col(text).rlike(SUSPECT)).select(*keys, F.inline(tag_paths(F.col(text))))


def path_sums(nodes: DataFrame, *keys: str) -> DataFrame:
    """Nodes, or sums of nodes, summed per path (and keys): nodes, leaves (nodes with text), chars, punct. Nodes of plain text without a character are left out."""
    seen = nodes.where("chars > 0 OR path <> '/'").groupBy(*keys, "path")
    counted = ("nodes", "leaves") if "nodes" in nodes.columns else ()
    return seen.agg(*(F.sum(c).alias(c) for c in (*counted, "chars", "punct")), *(() if counted else (F.count("*").alias("nodes"), F.count_if(F.col("chars") > 0).alias("leaves"))))


def path_ratios(nodes: DataFrame) -> DataFrame:
    """Per tag path of nodes (or of `path_sums`): nodes, chars, punct, the fused and smoothed `ratio`, and whether it is `tagged` and `content`.

    ratio = smoothed text length per leaf x (PUNCTUATION_BASE + smoothed punctuation per leaf), of the leaves with
    text. The smoothing adds the parent path's ratio with the weight of SMOOTHING leaves (the corpus mean's for
    paths without a parent here).
    The bare path "/" and paths that end in structure or inline marks and have only such or blocks above them are content at any ratio. No path is left out.
    """
    sums = path_sums(nodes)
    means = sums.agg(*((F.sum(c) / F.greatest(F.sum("leaves"), F.lit(1))).alias(f"_all_{c}") for c in ("chars", "punct")))
    sums = sums.join(F.broadcast(means))  # one row
    parents = sums.select(F.col("path").alias("_parent"), *((F.col(c) / F.greatest("leaves", F.lit(1))).alias(f"_above_{c}") for c in ("chars", "punct")))
    parent = F.regexp_replace("path", "/[^/]*$", "")
    joined = sums.join(parents, F.when(parent == "", "/").otherwise(parent) == F.col("_parent"), "left")

    def smooth(what: str) -> Column:
        return (F.col(what) + SMOOTHING * F.coalesce(f"_above_{what}", f"_all_{what}")) / (F.col("leaves") + SMOOTHING)

    ratio = smooth("chars") * (PUNCTUATION_BASE + smooth("punct"))
    leaf = F.substring_index("path", "/", -1)
    noisy = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, sorted(NOISE_TAGS))))
    always = (F.col("path") == "/") | leaf.isin(*sorted(STRUCTURE | INLINE)) & ~noisy
    least = THRESHOLD * F.col("_all_chars") * (PUNCTUATION_BASE + F.col("_all_punct"))
    return joined.select("path", "nodes", "leaves", "chars", "punct", ratio.alias("ratio"), (F.col("path") != "/").alias("tagged"), (always | (ratio >= least)).alias("content"))


def known_paths(ratios: DataFrame) -> dict[str, bool]:
    """Path to whether it is content. It collects the whole table, so it is for small corpora; `clean_rows` is for any."""
    return {r.path: r.content for r in ratios.select("path", "content").collect()}


def clean_text(text: Column, content: dict[str, bool]) -> Column:
    """The text without markup and noise. Null stays null; text without suspect characters stays as it is."""

    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else clean(parse(t), content) for t in texts.to_pylist()], pa.string())

    return F.when(text.rlike(SUSPECT), arrow_udf(cleaned, "string")(F.when(text.rlike(SUSPECT), text))).otherwise(text)


def clean_rows(df: DataFrame, keys: list[str], text: str, nodes: DataFrame, ratios: DataFrame, out: str = "clean") -> DataFrame:
    """df with the column `out`: the text as `clean_text` makes it, by a path table of any size.

    nodes (keys, path) are those of the texts, ratios holds all their paths. A row gets its noise paths by a join on
    the path and one on the keys. Rows with equal keys, null or not, share them, which changes no result: a path is
    noise or not whatever the text.
    """
    noise = nodes.join(ratios.where("NOT content").select("path"), "path", "left_semi")
    noise = noise.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.collect_set("path").alias("_noise"))
    suspect = F.coalesce(F.col(text).rlike(SUSPECT), F.lit(False))
    marked = df.where(suspect).join(noise, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys)), "left")

    def cleaned(texts: pa.Array, noise: pa.Array) -> pa.Array:
        rows = ((parse(t), set(paths or ())) for t, paths in zip(texts.to_pylist(), noise.to_pylist(), strict=True))
        return pa.array([clean(leaves, {path: path not in paths for path, _, _ in leaves}) for leaves, paths in rows], pa.string())

    marked = marked.select(*df.columns, arrow_udf(cleaned, "string")(F.col(text), F.col("_noise")).alias(out))
    return marked.unionByName(df.where(~suspect).withColumn(out, F.col(text)))
