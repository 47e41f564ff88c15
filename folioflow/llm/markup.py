r"""Markup residue in text: convert Markdown, HTML, wiki and LaTeX to clean text that keeps its structure (problem 1).

The method named for this problem (pairing pages by URL path and deleting shared lines) removes
boilerplate between pages; it neither recognises a notation nor keeps headings, lists or
formulas, and page bodies have no URLs. This operator instead parses each body: a line scanner
splits it into blocks (fence, table, heading, list, quote, formula, paragraph), an inline scanner
strips the notations inside a block, and every rule that fires names its notation. README.md says so.

Linear time: each rule is a single regular pass without nested repetition, and no text is cut.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MD, HT, WK, TX = "markdown", "html", "wiki", "latex"

# Element names of HTML.
TAGS = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup "
    "dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol option p param picture pre q s samp "
    "script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead "
    "time title tr track tt u ul var video wbr"
)
# LaTeX commands that take no argument.
BARE = (
    "item par newline newpage clearpage maketitle tableofcontents noindent centering hline toprule midrule bottomrule ldots dots cdots "
    "quad qquad hfill vfill LaTeX TeX bfseries itshape small large Large alpha beta gamma delta epsilon lambda mu pi sigma omega "
    "infty times cdot pm leq geq neq approx to sum int prod sqrt partial nabla"
)
TAG = re.compile(rf"</?(?:{TAGS.replace(' ', '|')})(?:\s[^<>]{{0,2000}})?/?>|<!DOCTYPE[^<>]{{0,500}}>", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
DROP = re.compile(r"<(script|style)\b[^<>]*>.*?</\1\s*>", re.S | re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^`]*$")
CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
ITEM = re.compile(r"^([ \t\u00a0]*)([-*+•]|\d{1,9}[.)])[ \t]+(\[[ xX]\][ \t]+)?(?=\S)")
QUOTE = re.compile(r"^ {0,3}((?:>[ \t]?)+)(?=\S)")
ROW = re.compile(r"^[ \t]*\|(.+)\|[ \t]*$")
RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)>?(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)")
LINK = re.compile(r"(?<!\[)\[((?:[^\[\]\n]|\[[^\[\]\n]*\])+)\]\(\s*(?:<[^<>\n]*>|[^()\s<>]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+[\"'][^\"'\n]*[\"'])?\s*\)")
REFLINK = re.compile(r"(?<![\[\w])\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
REFDEF = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]+\S+.*$")
FOOTREF = re.compile(r"\[\^[^\[\]\s]+\]:?")
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
STRONG = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^*\n]+?)(?<=[^\s*\\])\1(?![\w*])|(?<![\w_\\])(_{1,3})(?=[^\s_])([^\n]+?)(?<=[^\s_\\])\3(?![\w_])")
INSIDE = re.compile(r"(?<=\w)(\*\*)(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*\*")
STRIKE = re.compile(r"~~(?=\S)([^~\n]+?)(?<=\S)~~")
MARKED = re.compile(r"==(?=[^\s=])([^=\n]+?)(?<=[^\s=])==(?!=)")
WHEAD = re.compile(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$")
WBOLD = re.compile(r"('{5}|'{3}|'{2})(?=[^'\s])([^\n]+?)(?<=[^'\s])\1")
WLINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
WEXT = re.compile(r"\[((?:https?:)?//[^\s\[\]]+)(?:[ \t]+([^\[\]\n]*))?\](?!\()")
WTEMPLATE = re.compile(r"\{\{([^{}]+)\}\}")
WTABLE = re.compile(r"^[ \t]*(\{\||\|\}|\|-)")
WMAGIC = re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__")
MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]{1,400}?)(?<=[^\s$\\])\$(?![\d$\w])")
MATHLY = re.compile(r"[\\^_={}<>+*/]|^[A-Za-z]$|[A-Za-z]\s*[-+]\s*\w")
ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\[\]\n]*\])?(?:\{[^{}\n]*\})?")
COMMAND = re.compile(r"(?<![\\\w:])\\([A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}")
BARECMD = re.compile(rf"(?<![\\\w:])\\(?:{BARE.replace(' ', '|')})(?![A-Za-z])")
MATHENV = re.compile(r"\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}(.+?)\\end\{\1\2\}", re.S)
VERB = re.compile(r"\\begin\{(verbatim|lstlisting)\}(?:\[[^\]\n]*\])?\n?(.*?)\\end\{\1\}", re.S)
SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|title)\*?\{([^{}\n]*)\}")
# LaTeX heading commands and their depth; LaTeX commands whose argument is not text.
DEPTH = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
HIDDEN = {"label", "ref", "eqref", "pageref", "cite", "citep", "citet", "includegraphics", "usepackage", "documentclass", "vspace", "hspace", "bibliography", "input", "url"}
HOLD = "\x00{}\x00"
HELD = re.compile(r"\x00(\d+)\x00")
SPACE = re.compile(r"[ \t]+")
BLANKS = re.compile(r"\n{3,}")
QUICK = re.compile(r"[#*_`~<>&\[\]{}|\\$=]|''|^[ \t\u00a0]*(?:[-+•]|\d+[.)])[ \t]|^ {0,3}-{2,}[ \t]*$", re.M)


def parse(text: str | None) -> tuple[str | None, list[str], list[tuple[str, int, str]]]:
    """(clean text, notations found, blocks) of one body.

    Blocks are (kind, level, text) with kind heading, list, quote, table, code, formula or text;
    level is the heading's or list's depth. The clean text joins them: headings and paragraphs as
    lines, list items after a dash, table cells between tabs, code and formulas as they stand.
    """
    if text is None:
        return None, [], []
    if not text.strip():
        return "", [], []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not QUICK.search(text):
        out = text.strip()
        return out, [], [("text", 0, p) for p in re.split(r"\n{2,}", out)]
    state = _State()
    text = _fences(text, state)
    text = _html(text, state)
    text = _math(text, state)
    blocks = _lines(text, state)
    blocks = [(k, n, _restore(t, state)) for k, n, t in blocks]
    blocks = [b for b in blocks if b[2].strip()]
    return _join(blocks), sorted(state.found), blocks


class _State:
    def __init__(self) -> None:
        self.found: set[str] = set()
        self.held: list[tuple[str, str]] = []

    def hold(self, kind: str, text: str) -> str:
        self.held.append((kind, text))
        return HOLD.format(len(self.held) - 1)


def _restore(text: str, state: _State) -> str:
    """Put code and formulas back; they never hold further held parts but inside formulas of code."""
    for _ in range(4):
        if "\x00" not in text:
            break
        text = HELD.sub(lambda m: state.held[int(m.group(1))][1], text)
    return text


def _fences(text: str, state: _State) -> str:
    """Set fenced blocks and code spans aside: what stands inside is content."""
    text = text.replace("\x00", "")
    if "```" in text or "~~~" in text:
        out: list[str] = []
        mark, body = "", []
        for line in text.split("\n"):
            m = FENCE.match(line)
            if not mark and m:
                mark, body = m.group(1), []
            elif mark and m and line.strip().startswith(mark) and not line.strip().strip(mark[0]):
                state.found.add(MD)
                out.append(state.hold("code", "\n".join(body)))
                mark = ""
            elif mark:
                body.append(line)
            else:
                out.append(line)
        if mark:  # an open fence runs to the end
            state.found.add(MD)
            out.append(state.hold("code", "\n".join(body)))
        text = "\n".join(out)
    if "`" in text:

        def span(m: re.Match) -> str:
            if "\n\n" in m.group(2):
                return m.group()
            state.found.add(MD)
            return state.hold("span", m.group(2).strip() or m.group(2))

        text = CODE.sub(span, text)
    return text


def _html(text: str, state: _State) -> str:
    """Resolve character references (escaped up to twice), then turn elements into lines and marks."""
    if VERB.search(text):
        state.found.add(TX)
        text = VERB.sub(lambda m: "\n" + state.hold("code", m.group(2).strip("\n")) + "\n", text)
    if "<" not in text and "&" not in text:
        return text
    links = AUTOLINK.search(text)
    if links:
        state.found.add(MD)
        text = AUTOLINK.sub(r"\1", text)
    for _ in range(3):
        m = ENTITY.search(text)
        if not m:
            break
        new = ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if new == text:
            break
        state.found.add(HT)
        text = new.replace("\x00", "")
    if "<" in text:
        before = text
        text = DROP.sub("", COMMENT.sub("", text))
        text = TAG.sub(_tag, text)
        if text != before:
            state.found.add(HT)
    return text


def _tag(m: re.Match) -> str:
    """One tag as text: headings, items, cells and paragraphs keep their place."""
    t = m.group()
    name = re.match(r"</?!?([A-Za-z0-9]+)", t).group(1).lower()
    close = t.startswith("</")
    if name == "img":
        alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", t)
        return next((g for g in alt.groups() if g), "") if alt else ""
    if len(name) == 2 and name[0] == "h" and name[1].isdigit():
        return "\n" if close else f"\n\x01h{name[1]}"
    if name == "li":
        return "\n" if close else "\n\x01li"
    if name == "tr":
        return "\n" if close else "\n\x01tr"
    if name in ("td", "th"):
        return "\t" if close else ""
    if name == "blockquote":
        return "\n" if close else "\n\x01bq"
    if name in ("br", "hr"):
        return "\n"
    if name in ("p", "div", "ul", "ol", "dl", "dt", "dd", "table", "tbody", "thead", "tfoot", "pre", "section", "article", "header", "footer", "title", "body", "html", "head"):
        return "\n"
    return ""


def _math(text: str, state: _State) -> str:
    """Set formulas aside and strip LaTeX commands."""
    if "$" not in text and "\\" not in text:
        return text

    def formula(m: re.Match) -> str:
        body = next(g for g in m.groups() if g)
        state.found.add(TX)
        return state.hold("formula", body.strip())

    def inline(m: re.Match) -> str:
        if not MATHLY.search(m.group(1)):
            return m.group()
        state.found.add(TX)
        return state.hold("span", m.group(1))

    if "\\begin" in text:
        text = MATHENV.sub(lambda m: (state.found.add(TX), "\n" + state.hold("formula", m.group(3).strip()) + "\n")[1], text)
    text = MATH.sub(formula, text)
    text = INLINE.sub(inline, text)
    if "\\" in text:
        if ENV.search(text):
            state.found.add(TX)
            text = ENV.sub("\n", text)

        def section(m: re.Match) -> str:
            state.found.add(TX)
            return f"\n\x01h{DEPTH[m.group(1)]}{m.group(2)}\n"

        text = SECTION.sub(section, text)

        def command(m: re.Match) -> str:
            state.found.add(TX)
            return "" if m.group(1) in HIDDEN else m.group(2)

        for _ in range(4):  # arguments nest a few deep
            new = COMMAND.sub(command, text)
            if new == text:
                break
            text = new

        def bare(m: re.Match) -> str:
            state.found.add(TX)
            return "\n\x01li" if m.group() == "\\item" else "…" if m.group() in ("\\ldots", "\\dots") else ""

        text = BARECMD.sub(bare, text)
        if TX in state.found:
            text = re.sub(r"\\([%&#_$])", r"\1", text).replace("~", " ") if "~~" not in text else text
    return text


def _lines(text: str, state: _State) -> list[tuple[str, int, str]]:
    """Blocks of the lines; line notations are read here, the rest by _inline."""
    found = state.found
    blocks: list[tuple[str, int, str]] = []
    lines = text.split("\n")
    para: list[str] = []
    table: list[str] = []
    in_wiki = False

    def flush() -> None:
        if para:
            blocks.append(("text", 0, "\n".join(para)))
            para.clear()

    def end_table() -> None:
        if table:
            blocks.append(("table", 0, "\n".join(table)))
            table.clear()

    for i, line in enumerate(lines):
        follows = lines[i + 1] if i + 1 < len(lines) else ""
        s = line.strip()
        if not s:
            flush()
            end_table()
            continue
        if line.lstrip().startswith("\x01"):
            line = line.lstrip()
            kind, rest = (line[1:3], line[3:])
            if kind != "tr":
                end_table()
            flush()
            if kind == "tr":
                table.append("\t".join(c.strip() for c in _inline(rest, state).rstrip("\t").split("\t")))
            elif kind == "li":
                blocks.append(("list", 1, _inline(rest, state).strip()))
            elif kind == "bq":
                blocks.append(("quote", 0, _inline(rest, state).strip()))
            else:
                blocks.append(("heading", int(kind[1]), _inline(rest, state).strip()))
            continue
        m = HELD.fullmatch(s)
        if m and state.held[int(m.group(1))][0] != "span":
            flush()
            end_table()
            blocks.append((state.held[int(m.group(1))][0], 0, s))
            continue
        if s.startswith("{|") or in_wiki:
            flush()
            found.add(WK)
            in_wiki = not s.startswith("|}")
            if not in_wiki:
                end_table()
            elif s.startswith("|+") :
                table.append(_inline(s[2:], state).strip())
            elif s[0] in "|!" and not s.startswith("|-"):
                cells = re.split(r"\|\||!!", s[1:])
                table.append("\t".join(_inline(c, state).strip() for c in cells))
            continue
        if "\t" not in line and "|" in line and (ROW.match(line) or (RULE.match(line) and "|" in line)):
            flush()
            found.add(MD)
            if not RULE.match(line):
                table.append("\t".join(_inline(c, state).strip() for c in s.strip("|").split("|")))
            continue
        end_table()
        m = ATX.match(line)
        if m:
            flush()
            found.add(MD)
            blocks.append(("heading", len(m.group(1)), _inline(m.group(2), state)))
            continue
        m = WHEAD.match(s)
        if m:
            flush()
            found.add(WK)
            blocks.append(("heading", len(m.group(1)), _inline(m.group(2), state)))
            continue
        m = SETEXT.match(line)
        if m and para and len(m.group(1)) >= 2:
            found.add(MD)
            head = para.pop()
            flush()
            blocks.append(("heading", 1 if m.group(1)[0] == "=" else 2, head))
            continue
        if m and len(m.group(1)) >= 3:  # a thematic break marks nothing up
            flush()
            continue
        m = ITEM.match(line)
        if m:
            flush()
            found.add(MD)
            box = (m.group(3) or "").strip()
            mark = "" if m.group(2)[0] in "-*+•" else m.group(2) + " "
            rest = _inline(line[m.end() :], state)
            blocks.append(("list", 1 + len(m.group(1).replace("\t", "    ")) // 2, (box.lower() + " " if box else "") + mark + rest))
            continue
        m = QUOTE.match(line)
        if m:
            flush()
            found.add(MD)
            blocks.append(("quote", m.group(1).count(">"), _inline(line[m.end() :], state)))
            continue
        if REFDEF.match(line) and "://" in line:
            found.add(MD)
            continue
        _ = follows
        para.append(_inline(s, state))
    flush()
    end_table()
    return blocks


def _inline(text: str, state: _State) -> str:
    """Text of a line without its inline notations."""
    found = state.found
    if "[" in text:
        new = IMAGE.sub(r"\1", text)
        new = WEXT.sub(lambda m: (found.add(WK), m.group(2) or m.group(1))[1], new)
        after = LINK.sub(r"\1", new)
        after = LINK.sub(r"\1", after)  # an image inside a link leaves a link
        if after != text and (new != after or IMAGE.search(text)):
            found.add(MD)
        text = after
        if "[[" in text:

            def wiki(m: re.Match) -> str:
                found.add(WK)
                target, label = m.group(1), m.group(2)
                if re.match(r"\s*(?:Category|Kategorie|Catégorie|Categoría|Categoria|Categorie|Kategoria|Категория)\s*:", target):
                    return ""
                if re.match(r"\s*(?:File|Image|Datei|Fichier|Archivo|Ficheiro|Bestand|Plik|Файл)\s*:", target):
                    return (label or "").split("|")[-1]
                return label or target

            text = WLINK.sub(wiki, text)
        if "][" in text and REFLINK.search(text):
            found.add(MD)
            text = REFLINK.sub(r"\1", text)
        if "[^" in text and FOOTREF.search(text):
            found.add(MD)
            text = FOOTREF.sub("", text)
    if "{{" in text:

        def template(m: re.Match) -> str:
            found.add(WK)
            parts = [p.split("=", 1)[-1].strip() for p in m.group(1).split("|")[1:]]
            return ", ".join(p for p in parts if p)

        text = WTEMPLATE.sub(template, text)
    if "''" in text:
        new = WBOLD.sub(r"\2", text)
        new = WBOLD.sub(r"\2", new)
        if new != text:
            found.add(WK)
            text = new
    if "__" in text and WMAGIC.search(text):
        found.add(WK)
        text = WMAGIC.sub("", text)
    if "~~" in text:
        new = STRIKE.sub(r"\1", text)
        if new != text:
            found.add(MD)
            text = new
    if "*" in text or "_" in text:
        for _ in range(3):
            new = STRONG.sub(lambda m: m.group(2) or m.group(4), text)
            new = INSIDE.sub(r"\2", new)
            if new == text:
                break
            found.add(MD)
            text = new
    if "==" in text:
        new = MARKED.sub(r"\1", text)
        if new != text:
            found.add(MD)
            text = new
    return SPACE.sub(" ", text) if "\t" not in text else text


def _join(blocks: list[tuple[str, int, str]]) -> str:
    out: list[str] = []
    last = ""
    for kind, level, text in blocks:
        if out:
            out.append("\n" if kind == last == "list" or kind == last == "quote" else "\n\n")
        out.append(("  " * (level - 1) + "- " + text) if kind == "list" else text)
        last = kind
    return BLANKS.sub("\n\n", "".join(out)).strip()


PARSED = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("families", T.ArrayType(T.StringType())),
    T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))),
])


@F.pandas_udf(PARSED)
def parse_markup(bodies: pd.Series) -> pd.DataFrame:
    rows = [parse(b if isinstance(b, str) else None) for b in bodies]
    return pd.DataFrame({"text": [r[0] for r in rows], "families": [r[1] for r in rows], "blocks": [[{"kind": k, "level": n, "text": t} for k, n, t in r[2]] for r in rows]})


def clean_markup(df: DataFrame, column: str = "body") -> DataFrame:
    """Add ``<column>_clean``, ``<column>_families`` and ``<column>_blocks``.

    NULL gives NULL text and empty arrays, the empty text an empty text; a text without any
    notation comes out as it is. No row is added or dropped, other columns pass through.
    """
    return (
        df.withColumn("__m", parse_markup(F.col(column)))
        .withColumn(f"{column}_clean", F.col("__m.text"))
        .withColumn(f"{column}_families", F.col("__m.families"))
        .withColumn(f"{column}_blocks", F.col("__m.blocks"))
        .drop("__m")
    )
