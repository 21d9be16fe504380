"""Problem 5: markup residue found and turned into clean text.

Where pages have a host and a path, what they share with the page of the nearest
path is residue of their template: see :mod:`lexmill.llm.page_difference`.  The
tables ``texts`` and ``split_a`` have neither, and nothing of a remnant inside
one sentence would be shared between pages.  So each of their texts is read by
the grammars of the four markups:

* *finding* is a set of patterns for the JVM, one family each for HTML,
  Markdown, wiki and LaTeX.  Every pattern asks for a complete construct (an
  element or entity with a known name, a closed pair of signs, a command with
  its argument), so that signs that prose uses for itself (a < b, R&D, 5 * 3,
  $5_000, C:\\x, snake_case, __init__, [sic], a dialogue in dashes, footnote 'a'
  style quotes) aren't found;
* *cleaning* rewrites the constructs: code and formulas are taken out first and
  put back unchanged at the end, headings become lines of their own, list items
  lines that begin with '- ' or their number, tables rows of cells, and all else
  leaves its words.

Both are per-row expressions without any shuffle.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = (
    "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main map mark math meta mi mn mo mrow "
    "msub msup mfrac nav noscript object ol option p param pre q ref references rp rt ruby s samp script section select small source span strike strong "
    "style sub summary sup svg syntaxhighlight table tbody td textarea tfoot th thead time title tr tt u ul var video wbr nowiki gallery"
).split()

#: Names between double underscores that code uses, not bold words; fixed values.
DUNDER = "init main name file all doc dict class call str repr len iter next new del enter exit getattr setattr getitem setitem eq hash slots version import future builtins path pycache annotations".split()
#: Entities with a name, as HTML defines them.
ENTITIES = sorted(x.removesuffix(";") for x in html.entities.html5 if x.endswith(";"))

_ATTRIBUTE = r"(?:\s+[a-zA-Z:_-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)"
TAG = rf"</?(?:{'|'.join(ELEMENTS)}){_ATTRIBUTE}*\s*/?>"

FAMILIES: dict[str, list[str]] = {
    "html": [rf"(?i){TAG}", r"<!--", r"(?i)<!doctype\s+\w", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6});"],
    "markdown": [
        r"!?\[[^\]\n]*\]\((?:[a-z]+:|/|#|[\w.-]+\.\w|[\w.-]+/)[^)\n]*\)",
        r"\[\^\w+\]",
        r"(?<![\w\])])\[[^\]\n]{2,}\]\[[^\]\n]*\](?!\w)|(?m:^\[[^\]\n]+\]:\s+\S)",
        r"(?<![\w*])\*{1,3}(?=[^\s*])[^*\n]*[^\s*]\*{1,3}(?![\w*])",
        rf"(?<![\w_])(?!__(?:{'|'.join(DUNDER)})__)_{{1,3}}(?=[^\s_])[^_\n]*[^\s_]_{{1,3}}(?![\w_])",
        r"~~[^\s~][^~\n]*~~",
        r"`[^`'\n]+`|(?m:^\s{0,3}(?:```|~~~))",
        r"(?m)^ {0,3}#{1,6} +\S",
        r"(?m)^[^\n]*\w[^\n]*\r?\n ?(?:={3,}|-{3,}) *\r?$",
        r"(?m)^ {0,3}\|?(?: *(?::-+:?|-{3,}:?) *\|)+ *(?::-+:?|-{3,}:?)? *\r?$",
        r"(?m)^ {0,3}> \S",
        r"(?m)^ {0,3}(?:\*(?: ?\*){2,}|-(?: -){2,}|---+|_{3,}) *\r?$",
        r"(?m)^ {0,3}[-*+] +\S[^\n]*(?<![.!?][\"'\u201d]{0,2})\r?\n(?:[^\n]*\r?\n)? {0,3}[-*+] +\S",
        r"(?m)^ {0,3}[-*+] +\S[^\n]*\r?\n(?:[^\n]*\r?\n)? {0,3}[-*+] +\S[^\n]*(?<![\r\n.!?][\"'\u201d]{0,2})\r?$",
        r"(?m)^ {0,3}[*+] +\S[^\n]*\r?\n(?:[^\n]*\r?\n)? {0,3}[*+] +\S",
    ],
    "wiki": [
        r"\[\[[^\]\n]+\]\]",
        r"\{\{[^{}]+\}\}",
        r"''[^'\n]+''",
        r"(?m)^={1,6} *[^=\s][^=\n]*={1,6} *\r?$",
        r"(?m)^\{\||^\|\}|^\|- *\r?$",
        r"\[(?:https?|ftp)://[^\]\s]+[^\]\n]*\]",
        r"~~~~|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__|(?i:#redirect)\s*\[\[",
    ],
    "latex": [
        r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{",
        r"\\(?:ldots|dots|item|LaTeX|TeX|noindent|maketitle|tableofcontents|par|quad|qquad|textbackslash|copyright|clearpage|newpage|hline|alpha|beta|gamma|sum|int|infty|leq|geq|times|cdot)(?![a-zA-Z\\])",
        r"\\[&%$#](?![a-zA-Z]*\\)",
        r"\\\([^\n]*?\\\)|\\\[",
        r"\$(?=[^\s$])[^$\n]*[\\^_{}][^$\n]*(?<=[^\s$])\$(?!\d)",
        r"\$\$[^$]+\$\$",
        r"\{\\[a-zA-Z]+ ",
        r"``[^`\n]*''",
        r"\\['`\"^][aeiouyncszAEIOUYNCSZ]|\\['`\"^~=.]\{",
        r"\d\\,|\\\\(?:\[\d|\s*\r?\n)",
    ],
}


def _needs(family: str, pattern: str) -> list[str]:
    """Literals of which every match of a pattern has one: the pattern is only tried on texts that hold one."""
    gates = {
        "html": {0: ["<"], 1: ["<!--"], 2: ["<!"], 3: ["&"]},
        "markdown": {0: ["]("], 1: ["[^"], 2: ["][", "]:"], 3: ["*"], 4: ["_"], 5: ["~~"], 6: ["`", "~~~"], 7: ["#"], 8: ["===", "---"], 9: ["---", ":-"], 10: [">"], 11: ["*", "-", "___"], 12: ["- ", "* ", "+ "], 13: ["- ", "* ", "+ "], 14: ["* ", "+ "]},
        "wiki": {0: ["[["], 1: ["{{"], 2: ["''"], 3: ["="], 4: ["{|", "|}", "|-"], 5: ["://"], 6: ["~~~~", "__", "#"]},
        "latex": {0: ["\\"], 1: ["\\"], 2: ["\\"], 3: ["\\(", "\\["], 4: ["$"], 5: ["$$"], 6: ["{\\"], 7: ["``"], 8: ["\\"], 9: ["\\"]},
    }
    return gates[family][FAMILIES[family].index(pattern)]


def holds(text: Column, family: str) -> Column:
    """Whether a text holds markup of a family; a null text holds none."""
    found = F.lit(False)
    for pattern in FAMILIES[family]:
        near = F.lit(False)
        for literal in _needs(family, pattern):
            near = near | text.contains(literal)
        found = found | (near & text.rlike(pattern))
    if family == "html":
        named = F.exists(F.regexp_extract_all(text, F.lit("&([a-zA-Z][a-zA-Z0-9]{1,30});")), lambda x: x.isin(ENTITIES))
        found = found | (text.contains("&") & named)
    return F.coalesce(found, F.lit(False))


def find_markup(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a boolean per family (``has_html``, ...) and ``has_markup``; null and empty texts hold none."""
    t = F.col(f"`{text}`")
    df = df.withColumns({f"has_{f}": holds(t, f) for f in FAMILIES})
    any_of = F.lit(False)
    for f in FAMILIES:
        any_of = any_of | F.col(f"has_{f}")
    return df.withColumn("has_markup", any_of)


# -- cleaning ------------------------------------------------------------------

_FLAGS = re.I | re.S
_CODE = [
    re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<html>.*?)(?:</code>\s*)?</pre>", _FLAGS),
    re.compile(r"<(syntaxhighlight|source|nowiki)\b[^>]*>(?P<body>.*?)</\1>", _FLAGS),
    re.compile(r"^ {0,3}(```+|~~~+)[^\n]*\n(?P<body>.*?)(?:^ {0,3}\1[^\n]*$|\Z)", re.S | re.M),
    re.compile(r"\\begin\{(verbatim\*?|lstlisting|minted)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?(?P<body>.*?)\\end\{\1\}", re.S),
]
_INLINE_CODE = [re.compile(r"<(code|tt|kbd|samp)\b[^>]*>(?P<html>.*?)</\1>", _FLAGS), re.compile(r"(`+)(?!`)(?P<body>[^'\n]+?)(?<!`)\1(?!`)"), re.compile(r"\\verb(\W)(?P<body>.*?)\1")]
_FORMULA = [
    re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|eqnarray)(\*?)\}(?:\\label\{[^}]*\})?(?P<body>.*?)\\end\{\1\2\}", re.S),
    re.compile(r"\$\$(?P<body>[^$]+)\$\$"),
    re.compile(r"\\\[(?!\d)(?P<body>.*?)\\\]", re.S),
    re.compile(r"\\\((?P<body>.*?)\\\)"),
    re.compile(r"\$(?P<body>(?=[^\s$])[^$\n]*[\\^_{}][^$\n]*(?<=[^\s$]))\$(?!\d)"),
    re.compile(r"<math\b[^>]*>(?P<math>.*?)</math>", _FLAGS),
]
#: Accents of LaTeX as combining characters; fixed values.
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
_BLOCKS = re.compile(r"</?(?:p|div|section|article|header|footer|nav|ul|ol|dl|dt|dd|table|tbody|thead|tfoot|caption|blockquote|figure|figcaption|html|head|body|center|form|pre|hr|main|aside|details|summary|title)\b[^<>]*>", re.I)
_TAG = re.compile(TAG, re.I)
_HEADING_COMMANDS = r"(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)"


class _Kept:
    """Code and formulas put aside while the rest is rewritten."""

    def __init__(self, text: str) -> None:
        marks = (chr(c) for c in range(0xE000, 0xF8FF))
        self.mark, self.title = [m for m in marks if m not in text][:2]
        self.items: list[str] = []

    def put(self, shown: str) -> str:
        self.items.append(shown)
        return f"{self.mark}{len(self.items) - 1}{self.mark}"

    def back(self, text: str) -> str:
        pattern = re.compile(f"{self.mark}(\\d+){self.mark}")
        while pattern.search(text):  # a formula may hold code
            text = pattern.sub(lambda m: self.items[int(m.group(1))], text)
        return text


def _mathml(body: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^<>]*>", " ", body)).split()) if "<" in body else html.unescape(body).strip()


def clean_markup(text: str) -> dict:
    """Clean text of one document: ``clean``, ``headings``, ``list_items``, ``code``, ``formulas``.

    Code blocks come out indented by four blanks, inline code and formulas as
    they are, all unchanged inside.
    """
    text = text.replace("\r\n", "\n")
    kept = _Kept(text)
    code: list[str] = []
    formulas: list[str] = []

    def block(m: re.Match) -> str:
        groups = m.groupdict()
        body = html.unescape(groups["html"]) if groups.get("html") is not None else groups["body"]
        body = body.strip("\n")
        code.append(body)
        return "\n\n" + kept.put("\n".join(f"    {line}" for line in body.split("\n"))) + "\n\n"

    def inline(m: re.Match) -> str:
        groups = m.groupdict()
        body = html.unescape(re.sub(r"<[^<>]*>", "", groups["html"])) if groups.get("html") is not None else groups["body"]
        code.append(body)
        return kept.put(body)

    def formula(m: re.Match) -> str:
        groups = m.groupdict()
        body = _mathml(groups["math"]) if groups.get("math") is not None else groups["body"].strip()
        formulas.append(body)
        return kept.put(body)

    def heading(title: str) -> str:
        return f"\n\n{kept.title}{' '.join(title.split())}\n\n"

    for pattern in _CODE:
        text = pattern.sub(block, text)
    for pattern in _FORMULA:
        text = pattern.sub(formula, text)
    for pattern in _INLINE_CODE:
        text = pattern.sub(inline, text)
    # HTML
    text = re.sub(r"<!--.*?(?:-->|\Z)", "", text, flags=re.S)
    text = re.sub(r"<(script|style|ref)\b[^<>]*(?<!/)>.*?</\1\s*>", "", text, flags=_FLAGS)
    text = re.sub(r"(?i)<!doctype[^<>]*>|<ref\b[^<>]*/>", "", text)
    text = re.sub(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", lambda m: heading(_TAG.sub("", m.group(2))), text, flags=_FLAGS)
    text = re.sub(r"<br\b[^<>]*>", "\n", text, flags=re.I)
    text = re.sub(r"<li\b[^<>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"</(?:td|th)\s*>\s*(?=<(?:td|th))", " | ", text, flags=re.I)
    text = re.sub(r"</?(?:tr|li)\b[^<>]*>", "\n", text, flags=re.I)
    text = _BLOCKS.sub("\n\n", text)
    text = _TAG.sub("", text)
    # wiki
    text = re.sub(r"(?m)^[*#:;]+ *(?=\[\[)", "- ", text)
    text = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier):[^\]\n]*\]\]", "", text, flags=re.I)
    text = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]+)\]\]", r"\1", text)
    while (fewer := re.sub(r"(?: +(?=\{\{[^{}]*\}\}[.,;:!?]))?\{\{[^{}]*\}\}", "", text)) != text:
        text = fewer
    text = re.sub(r"\[(?:https?|ftp)://[^\]\s]+ ?([^\]\n]*)\](?!\()", r"\1", text)
    text = re.sub(r"(?m)^(={1,6}) *([^=\n]+?) *\1 *$", lambda m: heading(m.group(2)), text)
    text = re.sub(r"(?m)^\{\|.*$\n?|^\|\}.*$|^\|-.*$\n?|^\|\+", "", text)
    text = re.sub(r"(?m)^! *(.*)$", lambda m: " | ".join(c.strip() for c in m.group(1).split("!!")), text)
    text = re.sub(r"(?m)^\|(?!.*\|[ \t]*$) *(.*)$", lambda m: " | ".join(c.strip() for c in m.group(1).split("||")), text)
    text = re.sub(r"''+([^'\n]+)''+", r"\1", text) if "``" not in text else re.sub(r"(?<!`)''+([^'\n`]+)''+", r"\1", text)
    # Markdown
    text = re.sub(r"(?m)^ {0,3}#{1,6} +(.*?) *#* *$", lambda m: heading(m.group(1)), text)
    text = re.sub(r"(?m)^([^\n]*\w[^\n]*)\n ?(?:={3,}|-{3,}) *$", lambda m: heading(m.group(1)), text)
    text = re.sub(r"(?m)^ {0,3}\|?(?: *(?::-+:?|-{3,}:?) *\|)+ *(?::-+:?|-{3,}:?)? *$\n?", "", text)
    text = re.sub(r"(?m)^ {0,3}\|(.*)\| *$", lambda m: " | ".join(c.strip() for c in m.group(1).split("|")), text)
    text = re.sub(r"(?m)^ {0,3}(?:\*(?: ?\*){2,}|-(?: -){2,}|---+|_{3,}) *$", "", text)
    text = re.sub(r"!\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)", r"\1", text)
    text = re.sub(r"\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)", r"\1", text)
    text = re.sub(r"(?m)^\[\^\w+\]: ?", "", text)
    text = re.sub(r"\[\^\w+\]", "", text)
    text = re.sub(r"(?m)^ {0,3}> ?", "", text)
    for _ in range(2):
        text = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", text)
        text = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![\w_])", r"\2", text)
    text = re.sub(r"~~([^\s~][^~\n]*)~~", r"\1", text)
    text = re.sub(r"(?m)^ {0,3}[*+#-]+ +(?=\S)", "- ", text)
    # LaTeX
    text = re.sub(r"(?m)(?<!\\)% [^\n]*$", "", text) if "\\" in text else text
    text = re.sub(r"~?\\(?:documentclass|usepackage|label|cite[tp]?|ref|eqref|bibliography|bibliographystyle|pagestyle|input|include|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", text)
    text = re.sub(rf"\\{_HEADING_COMMANDS}\*?(?:\[[^\]\n]*\])?\{{([^{{}}]*)\}}", lambda m: heading(m.group(1)), text)
    text = re.sub(r"[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", lambda m: "\n- " + (m.group(1) + " " if m.group(1) else ""), text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", "\n", text)
    text = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", text)
    text = re.sub(r"\\(['`\"^~=.])(?:\{([a-zA-Z])\}|([a-zA-Z]))", lambda m: (m.group(2) or m.group(3)) + ACCENTS[m.group(1)], text)
    while (fewer := re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", text)) != text:
        text = fewer
    text = re.sub(r"\{\\[a-zA-Z]+ ([^{}]*)\}", r"\1", text)
    text = re.sub(r"\\(?:ldots|dots)(?![a-zA-Z])", "...", text)
    text = re.sub(r"\\(?:maketitle|noindent|tableofcontents|clearpage|newpage|hline|par)(?![a-zA-Z\\])", "", text)
    text = re.sub(r"\\([&%$#_{}])", r"\1", text)
    text = re.sub(r"(?<=\d)\\,", "\u2009", text)
    text = re.sub(r"\\\\(?:\[[^\]\n]*\])?(?=\s*\n)", "", text)
    text = re.sub(r"``([^`\n]*?)''", "\u201c\\1\u201d", text)
    text = re.sub(r"(?<=\S)~(?=\S)", "\u00a0", text)
    # entities last, so that what they spell isn't taken for markup; twice-escaped ones too
    for _ in range(2):
        text = re.sub(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});", lambda m: html.unescape(m.group()), text)
    text = _TAG.sub("", text)
    text = re.sub(r"[ \t]+(?=\n)", "", text)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    text = re.sub(r"(?m)(^(?:-|\d+[.)]) .*)\n\n(?=(?:-|\d+[.)]) )", r"\1\n", text)
    headings = re.findall(f"(?m)^{kept.title}(.*)$", text)
    text = text.replace(kept.title, "")
    items = [kept.back(x).strip() for x in re.findall(r"(?m)^(?:-|\d+[.)]) +(.*)$", text)]
    return {"clean": kept.back(text), "headings": [kept.back(h) for h in headings], "list_items": items, "code": [kept.back(c) for c in code], "formulas": [kept.back(f) for f in formulas]}


_CLEAN = "clean string, headings array<string>, list_items array<string>, code array<string>, formulas array<string>"


def clean_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``rec_id``, ``has_markup``, ``clean`` and the kept ``headings``, ``list_items``, ``code`` and ``formulas`` of every row.

    A text without markup comes out as it is, a null text as null, both with
    empty lists.  Texts are read whole.  Repeated rows stay repeated.
    """
    marked = find_markup(df.select(F.col(f"`{key}`").cast("string").alias("rec_id"), F.col(f"`{text}`").alias("text")), "text").select("rec_id", "text", "has_markup")
    names = ["clean", "headings", "list_items", "code", "formulas"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, flags = batch.column("text").to_pylist(), batch.column("has_markup").to_pylist()
            rows = [clean_markup(t) if f else {"clean": t, "headings": [], "list_items": [], "code": [], "formulas": []} for t, f in zip(texts, flags)]
            lists = pa.list_(pa.string())
            columns = [pa.array([r[n] for r in rows], pa.string() if n == "clean" else lists) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), batch.column("has_markup"), *columns], names=["rec_id", "has_markup", *names])

    return marked.mapInArrow(run, f"rec_id string, has_markup boolean, {_CLEAN}")
