"""HTML trees with the standard library: units of text, superscripts, escapes, targets of links."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Tags of text blocks, of lists, and the class that marks translations of earlier runs.
UNIT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "dt", "dd", "figcaption"}
LISTS = {"ul", "ol"}
TRANSLATED = "bb-vi"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Opening one of these ends an open one of those.
_ENDS = {t: {"p"} for t in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "blockquote", "div", "article", "table")} | {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_STOPS = {"ul", "ol", "table", "body", "div", "article", "blockquote", "td", "th", "dl"}


class Raw(str):
    """Markup that is kept as it stands: declarations, comments, scripts."""


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs=(), parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, list(attrs), parent, []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def classes(self) -> list[str]:
        return next((v or "" for k, v in self.attrs if k == "class"), "").split() if self.attrs else []

    def text(self, lists: bool = True) -> str:
        """Stripped strings below, joined by one space."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Raw):
                continue
            if isinstance(item, str):
                parts += [item.strip()] if item.strip() else []
            elif lists or item.tag not in LISTS:
                stack += reversed(item.children)
        return " ".join(parts)

    def inner(self, lists: bool = True) -> str:
        out = []
        for c in self.children:
            if isinstance(c, str):
                out.append(c if isinstance(c, Raw) else escape(c, quote=False))
            elif lists or c.tag not in LISTS:
                attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in c.attrs)
                out.append(f"<{c.tag}{attrs}/>" if c.tag in _VOID and not c.children else f"<{c.tag}{attrs}>{c.inner(lists)}</{c.tag}>")
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        for node in (self.at, *self.at.above()):
            if node.tag in _ENDS.get(tag, ()):
                self.at = node.parent
                break
            if node.tag in _STOPS:
                break
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        for node in (self.at, *self.at.above()):
            if node.tag == tag:
                self.at = node.parent
                return

    def handle_data(self, data):
        self.at.children.append(Raw(data) if self.at.tag in ("script", "style") else data)

    def handle_decl(self, decl):
        self.at.children.append(Raw(f"<!{decl}>"))

    def handle_pi(self, data):
        self.at.children.append(Raw(f"<?{data}>"))

    def handle_comment(self, data):
        self.at.children.append(Raw(f"<!--{data}-->"))


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


_NAMED = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z][A-Za-z0-9]*;")
#: Class of the spans that some shops put around each sentence.
READER_SPAN = "koboSpan"


def _xml(text: str) -> Node:
    """Tree of well-formed XML, names in their own case; what precedes the root element is kept as it stands."""
    data = _NAMED.sub(lambda m: html5.get(m[0][1:], m[0]), text).encode()
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = parser.ordered_attributes = True
    root = Node("")
    at = [root]

    def start(tag, attrs):
        if at[-1] is root and not any(isinstance(c, Node) for c in root.children):
            root.children.append(Raw(data[: parser.CurrentByteIndex].decode()))
        at.append(Node(tag, zip(attrs[::2], attrs[1::2]), at[-1]))
        at[-2].children.append(at[-1])

    def chars(value):
        at[-1].children.append(Raw(escape(value, quote=False)) if at[-1].tag in ("script", "style") else value)

    def keep(value):
        if len(root.children):  # else part of what precedes the root element
            at[-1].children.append(Raw(value))

    def skipped(name, is_parameter):
        raise expat.ExpatError(f"unknown entity {name}")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda tag: at.pop(), chars
    parser.CommentHandler, parser.ProcessingInstructionHandler = lambda c: keep(f"<!--{c}-->"), lambda target, c: keep(f"<?{target} {c}?>")
    parser.SkippedEntityHandler = skipped
    parser.Parse(data, True)
    return root


def _unwrapped(root: Node) -> Node:
    """The tree without reader's spans; what they hold takes their place."""
    for node in [n for n in root.walk() if n.tag == "span" and READER_SPAN in n.classes()]:
        siblings = node.parent.children
        at = next(i for i, c in enumerate(siblings) if c is node)
        siblings[at : at + 1] = node.children
        for c in node.children:
            if isinstance(c, Node):
                c.parent = node.parent
        for i in range(len(siblings) - 1, 0, -1):  # neighbouring texts become one
            if type(siblings[i]) is str and type(siblings[i - 1]) is str:
                siblings[i - 1 : i + 1] = [siblings[i - 1] + siblings[i]]
    return root


def parse_xhtml(text: str | None) -> Node:
    """Tree of a book's document: as XML where it is well-formed, so names keep their case (``viewBox``), else as lenient HTML.
    Reader's spans are unwrapped."""
    try:
        return _unwrapped(_xml(text or ""))
    except expat.ExpatError:
        return _unwrapped(parse(text))


def well_formed(text: str) -> bool:
    try:
        _xml(text)
    except expat.ExpatError:
        return False
    return True


def _inside_other(node: Node) -> bool:
    """Whether a unit above holds this node's text, with no list between them."""
    for above in node.above():
        if above.tag in LISTS:
            return False
        if above.tag in UNIT_TAGS:
            return TRANSLATED not in above.classes()
    return False


# Texts that need no translation.
_DROP = [re.compile(r"^[\d\s]*$"), re.compile(r"^(?:https?://|www\.)\S+$", re.I), re.compile(r"^ISBN(?:-1[03])?[\s:-]*[\dX][\dX\s-]*$", re.I)]


def unit_nodes(root: Node) -> list[Node]:
    """The outermost text blocks, in order; lists in lists are units of their own, translations of earlier runs none."""
    return [n for n in root.walk() if n.tag in UNIT_TAGS and not any(TRANSLATED in a.classes() for a in (n, *n.above())) and not _inside_other(n)]


def units(html: str | None, read=parse) -> Iterator[tuple[int, str, str, str]]:
    """(ordinal, tag, inner HTML, text) of the units. Ordinals count what is dropped (nothing, digits, a URL, an ISBN) too."""
    for ordinal, node in enumerate(unit_nodes(read(html))):
        text = node.text(lists=False)
        if not any(p.fullmatch(text) for p in _DROP):
            yield ordinal, node.tag, node.inner(lists=False), text


#: Characters of units that are handed on at once.
CHARS = 4 << 20


def html_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: (page_id, html) to (page_id, ordinal, tag, html, text), some units at a time."""
    names = ["page_id", "ordinal", "tag", "html", "text"]
    for frame in frames:
        rows, chars = [], 0
        for i, h in zip(frame.page_id, frame.html):
            for u in units(h):
                rows.append((i, *u))
                chars += len(u[2]) + len(u[3])
                if chars >= CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, chars = [], 0
        yield pd.DataFrame(rows, columns=names)


# Characters that Unicode has as superscripts and subscripts.
_SUP = dict(zip("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"))
_SUB = dict(zip("0123456789+-=()aeoxhklmnpst", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ"))
_FRACTION = re.compile(r"(\d?)<sup[^>]*>\s*(\d+)\s*</sup>[/⁄]<sub[^>]*>\s*(\d+)\s*</sub>")
_SCRIPT = re.compile(r"<(sup|sub)(?:\s[^>]*)?>(.*?)</\1>", re.S)


def flat_scripts(html: str | None, style: str = "unicode") -> str | None:
    """Fractions, superscripts and subscripts as plain text: 1 1/3, x², ^(ab), or with ``pandoc`` ^ab^ and ~ab~."""
    if html is None:
        return None
    html = _FRACTION.sub(lambda m: f"{m[1]}{' ' if m[1] else ''}{m[2]}/{m[3]}", html)

    def plain(m: re.Match) -> str:
        content = re.sub("<[^>]+>", "", m[2]).strip()
        mark, table = ("^", _SUP) if m[1] == "sup" else ("~" if style == "pandoc" else "_", _SUB)
        if style == "pandoc":
            return f"{mark}{content}{mark}"
        if (re.fullmatch(r"[0-9+\-=()]+", content) or re.fullmatch("[A-Za-z]", content)) and all(c in table for c in content):
            return "".join(table[c] for c in content)
        return mark + (content if content[:1] == "(" and content[-1:] == ")" else f"({content})")

    return _SCRIPT.sub(plain, html)


@F.pandas_udf(StringType())
def sup_sub(html: pd.Series) -> pd.Series:
    return html.map(flat_scripts)


def resolve(base: str | None, href: str | None) -> str | None:
    """Path of a link inside the archive, without its fragment."""
    if base is None or href is None:
        return None
    path = href.split("#", 1)[0]
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), path)) if path else base


@F.pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href)])


# Tags that translations may hold, and tags whose text stays.
_INLINE = {"strong", "em", "b", "i", "sup", "sub", "br", "a", "span", "small"}
_UNTOUCHED = {"code", "pre", "ul", "ol"}
_BARE_AND = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#\d+|#x[0-9A-Fa-f]+);)")
_BARE_LESS = re.compile(r"<(?!/?(?:%s)(?:\s[^<>]*)?/?>)" % "|".join(sorted(_INLINE)))


def _slots(node: Node) -> list[tuple[Node, int]]:
    """Places of the texts of a unit, outside code and nested lists."""
    out = []
    for i, c in enumerate(node.children):
        if isinstance(c, Node):
            out += [] if c.tag in _UNTOUCHED else _slots(c)
        elif not isinstance(c, Raw) and c.strip():
            out.append((node, i))
    return out


def translate_node(node: Node, html: str, bilingual: bool = False) -> None:
    """Put a translation (text with trusted inline tags only) in a unit's place, or beside it."""
    fragment = parse(_BARE_LESS.sub("&lt;", _BARE_AND.sub("&amp;", html)))
    if bilingual:
        if node.tag in ("td", "th"):
            copy = Node("span", [("class", TRANSLATED), ("lang", "vi")], node)
            node.children += [Node("br", (), node), copy]
        else:
            attrs = [(k, v) for k, v in node.attrs if k not in ("id", "class", "lang")]
            copy = Node(node.tag, [*attrs, ("class", " ".join([*node.classes(), TRANSLATED])), ("lang", "vi")], node.parent)
            node.parent.children.insert(next(i for i, c in enumerate(node.parent.children) if c is node) + 1, copy)
        copy.children = fragment.children
        return
    if all(n.tag in _INLINE for n in node.walk()):
        node.children = fragment.children
        return
    slots, runs = _slots(node), [p.children[i] for p, i in _slots(fragment)]
    if not slots:
        node.children.append(" ".join(runs))
    elif len(slots) > 1 and len(slots) == len(runs):
        for (parent, i), run in zip(slots, runs):
            parent.children[i] = run
    else:  # the structure of the translation can't be trusted: all of it goes into the longest text
        parent, i = max(slots, key=lambda s: len(s[0].children[s[1]]))
        parent.children[i] = " ".join(runs)


def translated(html: str, by_ordinal: dict[int, str], bilingual: bool = False, read=parse) -> str:
    """A document with its units replaced; unknown ordinals raise."""
    root = read(html)
    nodes = unit_nodes(root)
    if unknown := sorted(set(by_ordinal) - set(range(len(nodes)))):
        raise ValueError(f"no such units: {unknown}")
    for ordinal, text in by_ordinal.items():
        translate_node(nodes[ordinal], text, bilingual)
    return root.inner()


_MD = {"strong": "**", "b": "**", "em": "*", "i": "*"}


def image_sources(html: str | None, read=parse) -> list[str]:
    """Sources of a document's images, in order."""
    return [dict(n.attrs)["src"] for n in read(html or "").walk() if n.tag == "img" and dict(n.attrs).get("src")]


def markdown(html: str | None, read=parse, named: Callable[[str], str] = str) -> str:
    """Markdown of a document: headings, paragraphs, lists, quotes, emphasis, links, images (as ``named``); blocks a blank line apart."""

    def inline(node: Node) -> str:
        out = []
        for c in node.children:
            if isinstance(c, Raw):
                continue
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c))
            elif c.tag == "br":
                out.append("\n")
            elif c.tag == "img":
                a = dict(c.attrs)
                out.append(f"![{a.get('alt') or ''}]({named(a.get('src') or '')})")
            elif c.tag == "a" and dict(c.attrs).get("href"):
                out.append(f"[{inline(c)}]({dict(c.attrs)['href']})")
            elif c.tag not in LISTS:
                mark = _MD.get(c.tag, "")
                out.append(f"{mark}{inline(c)}{mark}" if inline(c).strip() else "")
        return "".join(out)

    blocks = []
    for node in unit_nodes(read(flat_scripts(html or ""))):
        text = inline(node).strip()
        if not text:
            continue
        depth = sum(a.tag in LISTS for a in node.above())
        lead = "#" * int(node.tag[1]) + " " if re.fullmatch("h[1-6]", node.tag) else "> " if node.tag == "blockquote" else ""
        if node.tag == "li":
            ordered = next((a.tag for a in node.above() if a.tag in LISTS), "ul") == "ol"
            place = [c for c in node.parent.children if isinstance(c, Node) and c.tag == "li"].index(node) + 1
            lead = "  " * (depth - 1) + (f"{place}. " if ordered else "- ")
        blocks.append(lead + text)
    return "\n\n".join(blocks)


TRUSTED = "strong|em|b|i|sup|sub|br|a|span|small"


def escape_untrusted(text):
    """Column: bare & and < become entities unless an inline tag or an entity begins there."""
    text = F.regexp_replace(text, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#\\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.regexp_replace(text, f"<(?!/?(?:{TRUSTED})(?:\\s[^<>]*)?/?>)", "&lt;")
