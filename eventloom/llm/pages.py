"""The main text of web pages, by tag-path ratios.

A page becomes blocks of text. All blocks with the same path of tags (and classes) from the root form a path; a path has
the ratio of its text to its blocks, and of its punctuation to its blocks. Articles repeat one path with long, punctuated
blocks; menus and labels have short ones. Both ratios are fused, smoothed over neighbouring blocks in page order, and
averaged per path; paths over a part of the page's mean are content, with all their blocks, short ones included.

Content paths also show where the article is: the deepest element with nearly all of their text, or the article (else main)
around it, or else its parents as long as they add no block of links. All its blocks are kept (headlines, bylines, lists,
tables, code), but for blocks of links that lie in no article or main.

Elements that by their name or class hold no article (menus, footers, sidebars, adverts, forms, comments, scripts, ...)
give no blocks. A class or id holds no article by its mark alone, though: the elements around the page's article (else main;
the largest outside marks, or else the largest) stay, and so do those with MOST of its paragraphs' text, or of the page's where
there is none; NEARLY all of it where a whole name is a mark, not a part (`comments`, not `with-comments`). A block whose text is mostly links counts under a path of its own.

Null and empty pages give the empty text. A page without tags is one block. Unclosed tags end with their parent, or where
HTML lets them end. Repeated pages are read each for itself; very long ones are read whole.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from eventloom.llm.common import append_columns

#: Elements without article text (fixed values).
OUTSIDE = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input iframe svg object "
    "canvas audio video map dialog menu fieldset".split()
)
#: Words in a class, id or role that mark what is no article (fixed values).
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar "
    "widget warning alert".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
#: A start tag of the key ends open elements of the value (fixed values of HTML).
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead body html".split())

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|title|svg)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.S | re.I,
)
CUT_OFF = re.compile(r"<[a-zA-Z/!?][^>]*\Z")  # a tag without its end
MARKS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
CLASS = re.compile(r"class\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟]")

#: A path is content from this part of the page's mean on.
PART = 0.15
#: An element that holds the article has this part of the content's text at least.
NEARLY = 0.9
MOST = 0.5
#: Weight of a block's neighbours in page order.
NEIGHBOUR = 0.5


def _blocks(page: str) -> tuple[list[tuple[str, str, int]], list[tuple[int, str, int]]]:
    """(path, text, element) of every block that may be an article's, and (parent, tag, mark) of every element.

    A mark is 2 where a whole class, id or role is one, and 1 where a part of it is.
    """
    stack: list[tuple[str, str, bool, bool, int]] = []  # tag, step of the path, left out, inside an article, element
    blocks, words, linked, total, elements = [], [], 0, 0, [(-1, "", 0)]

    def flush():
        nonlocal words, linked, total
        text = " ".join("".join(words).split())
        if text:
            steps = [step for tag, step, _, _, _ in stack if tag not in INLINE]
            element = next((e[4] for e in reversed(stack) if e[0] not in INLINE), 0)
            blocks.append(("/".join(steps) + ("/a" if 2 * linked > total else ""), text, element))
        words, linked, total = [], 0, 0

    def add(raw: str):
        nonlocal linked, total
        if raw and not (stack and stack[-1][2]):
            text = html.unescape(raw)
            words.append(text)
            size = len(text.strip())
            total += size
            if any(e[0] == "a" for e in stack):
                linked += size

    def close(tag: str):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                if any(e[0] not in INLINE for e in stack[i:]):
                    flush()
                del stack[i:]
                return

    def end_before(tag: str):
        """End the elements that a start tag ends without saying so."""
        if tag in PARAGRAPH_ENDS and any(e[0] == "p" for e in stack):
            close("p")
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in SIBLINGS.get(tag, ()):
                close(stack[i][0])
                return
            if stack[i][0] in SCOPES:
                return

    at = 0
    for m in PIECE.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        ends, name, rest = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        tag = name.lower()
        if ends:
            close(tag)
        elif tag in VOID or rest.endswith("/") and tag not in PARAGRAPH_ENDS:
            words.append(" " if tag in ("br", "wbr") else "")
            if tag == "hr":
                flush()
        else:
            if tag not in INLINE:
                end_before(tag)
                flush()
            parent = stack[-1] if stack else ("", "", False, False, 0)
            article = parent[3] or tag in ("article", "main")
            names = {n.lower() for v in MARKS.findall(rest) for n in v.strip("\"'").split()} if rest else set()
            parts = {w for n in names for w in re.split(r"[^a-z]+", n)}
            mark = 0 if tag in ("html", "body") or MARKED.isdisjoint(parts) else 1 if MARKED.isdisjoint(names) else 2
            out = parent[2] or tag in OUTSIDE or tag == "header" and not article
            # a marked word of a paragraph or of the article is part of its sentence
            out = out or tag in INLINE and mark > 0 and not article and all(e[0] != "p" for e in stack)
            label = CLASS.search(rest) if rest else None
            stack.append((tag, f"{tag}.{label[1].strip(chr(34) + chr(39))}" if label else tag, out, article, len(elements)))
            elements.append((parent[4], tag, mark))
    add(CUT_OFF.sub("", page[at:]))
    flush()
    return _unmarked(blocks, elements), elements


def _around(element: int, elements: list[tuple[int, str, int]]) -> list[int]:
    """An element and those around it, from the inside."""
    found = []
    while element >= 0:
        found.append(element)
        element = elements[element][0]
    return found


def _own_paragraph(element: int, elements: list[tuple[int, str, int]]) -> bool:
    """Whether an element is a paragraph of an article: a remark or a warning in it is its text."""
    return elements[element][1] == "p" and any(elements[e][1] in ("article", "main") for e in _around(element, elements))


def _unmarked(blocks, elements: list[tuple[int, str, int]]):
    """The blocks that no mark leaves out."""
    marked = {
        e for e, (_, tag, mark) in enumerate(elements)
        if mark and tag not in ("article", "main") and tag not in INLINE and not _own_paragraph(e, elements)
    }
    if not marked:
        return blocks
    chains = [_around(element, elements) for _, _, element in blocks]
    prose = defaultdict(int)
    for (_, text, _), chain in zip(blocks, chains):
        for e in chain:
            prose[e] += len(text) * any(elements[x][1] == "p" for x in chain)
    root, stays = 0, set()
    for tag in ("article", "main"):
        found = [e for e in prose if elements[e][1:] == (tag, 0)]
        if found:
            root = max(found, key=lambda e: (marked.isdisjoint(_around(e, elements)), prose[e], -e))
            stays.update(_around(root, elements))
            break
    for e in marked - stays:
        if prose[root] and prose[e] >= (NEARLY if elements[e][2] == 2 else MOST) * prose[root] and root in _around(e, elements):
            stays.add(e)
    return [block for block, chain in zip(blocks, chains) if marked.isdisjoint(x for x in chain if x not in stays)]


def _container(blocks, content: list[bool], elements: list[tuple[int, str, int]]) -> int:
    """The element that holds the article."""
    held, links = defaultdict(int), defaultdict(int)
    for (path, text, element), good in zip(blocks, content):
        for e in _around(element, elements):
            held[e] += good * len(text)
            links[e] += path.endswith("/a") and not good
    # elements are numbered from the outside; those that hold nearly all lie within each other
    inner = max(e for e, size in held.items() if size >= NEARLY * held[0])
    around = _around(inner, elements)
    for tag in ("article", "main"):
        for e in around:
            if elements[e][1] == tag:
                return e
    for e in around[1:]:
        if links[e] > links[inner]:
            break
        inner = e
    return inner


def main_text(page: str) -> str:
    blocks, elements = _blocks(page)
    if not blocks:
        return ""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, _ in blocks:
        size[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    fused = [size[p] / count[p] * (1 + marks[p] / count[p]) for p, _, _ in blocks]
    padded = [fused[0], *fused, fused[-1]]
    smooth = [(v + NEIGHBOUR * (a + b)) / (1 + 2 * NEIGHBOUR) for a, v, b in zip(padded, fused, padded[2:])]
    by_path = defaultdict(float)
    for (path, _, _), value in zip(blocks, smooth):
        by_path[path] += value / count[path]
    bar = PART * sum(v * len(text) for v, (_, text, _) in zip(smooth, blocks)) / sum(len(text) for _, text, _ in blocks)
    # smoothing lifts what lies beside a long paragraph, but a path of links is none of it
    content = [by_path[path] >= bar and not path.endswith("/a") for path, _, _ in blocks]
    if not any(content):
        content = [by_path[path] >= bar for path, _, _ in blocks]
    container = _container(blocks, content, elements)
    named = elements[container][1] in ("article", "main")

    def kept(path: str, element: int, good: bool) -> bool:
        """All of an article that is named as one; elsewhere what is content, and what lies beside it but links."""
        inside = container in _around(element, elements)
        return inside if named else good or inside and not path.endswith("/a")

    return "\n\n".join(text for (path, text, element), good in zip(blocks, content) if kept(path, element, good))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`, its code points."""

    def build():
        def run(sources: list[str]) -> dict[str, list]:
            texts = [main_text(s) for s in sources]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return append_columns(pages, column, "text STRING, n_chars BIGINT", build)
