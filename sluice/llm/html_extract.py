"""Main text of web pages by ratios of text to tags along tag paths (after Wu et al., CETR/CEPR)."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import mapped

#: HTML element names by what they do.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "svg", "math", "select", "button", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold one block of their neighbours' content.
SINGLE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Own choices, no fixed values: words in class names and ids that tell of an aside.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adsbygoogle|adbox|adslot|adunit|leaderboard|outbrain|taboola|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sidebar|side|menu|nav\w*|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|comments?|commentlist|respond|replies|reply|disqus|share|sharing|social|related|recommend\w*|pagination|pager|login|search|copyright|skip|hidden|sr-only)(?:$|[\s_-]|\d)",
    re.I,
)

#: Names that count as whole class names only, and modifiers or headings of content that tell of no aside.
EXACT = {"widget", "widgets", "widget-area", "tag", "tags", "tag-list", "tag-links", "tag-cloud", "post-tags", "entry-tags"}
MODIFIER = re.compile(r"(?:has|no|with|without|tag|category)[_-].*|(?:entry|post|article)[_-]+header", re.I)

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
PLAIN_END = re.compile(r"[^>\"']*+>")
QUOTED_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
#: Characters of a tag that are looked through for its end, quotes minded.
REACH = 1 << 16
#: Elements that are open within each other, at most.
DEPTH = 512
#: What standing aside by the element's name, role or being hidden, and by class or id, does to a block's fused ratio.
BY_TAG, BY_NAME = 0.005, 0.005
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
MARKS = re.compile(r"[.,;:!?…。、，；：！？]")


class Node:
    """An element: its path is the number of its root-to-leaf tag path, alike for all elements of one path."""

    __slots__ = ("aside", "below", "named", "parent", "path", "tag")

    def __init__(self, tag, parent, aside=False, named=False):
        self.tag, self.parent, self.aside, self.named = tag, parent, aside or (parent is not None and parent.aside), named
        if parent is None:
            self.path, self.below = (), {}
        else:  # paths share their beginnings: a step down is one look-up
            self.path = parent.below.setdefault(tag, [(id(parent.below), tag), {}])
            self.path, self.below = self.path


def _is_aside(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element stands aside by its tag, role or being hidden, and whether by the names in its class and id."""
    if tag in ASIDE:
        return True, False
    if not attrs.strip() or tag in ("html", "body", "main"):
        return False, False
    a = {k.lower(): x or y or z for k, x, y, z in ATTR.findall(attrs)}
    if re.search(r"(?:^|\s)hidden(?:$|[\s=/])", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)) or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True, False
    if a.get("role", "").lower() in ROLES:
        return True, False
    named = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{a.get('class', '')} {a.get('id', '')}").lower().split()  # sideBar as side-bar
    return False, tag not in SINGLE and tag != "article" and any(n in EXACT or (NAMES.search(n) and not MODIFIER.fullmatch(n)) for n in named)


def _beside(found) -> set[Node]:
    """Elements that stand aside by their names: not those that hold most text of the page, unless an article or main
    element has text outside them."""
    inside, own, every = defaultdict(int), set(), 0
    articles: dict[Node, int] = defaultdict(int)  # text in articles or main elements below or about a named element
    total = 0
    for node, text, link in found:
        n = max(0, len(text) - link)
        every += n
        about, in_article = [], False
        while node is not None:
            if node.named:
                about.append(node)
            in_article = in_article or node.tag in ("article", "main")
            node = node.parent
        own.update(about)
        total += n * in_article
        for node in about:
            inside[node] += n
            articles[node] += n * in_article
    return {node for node in own if 2 * inside[node] <= every or articles[node] < total}


def tokens(html: str):
    """(text, tag, whether it closes, attributes) in page order: text has no tag. Comments and declarations are left out.
    Every character is looked at a bounded number of times: what has no end once is not looked for again, and where a
    quote in a tag has no end within REACH, tags from there on end at the next > until REACH is past."""
    pos, n, unquoted = 0, len(html), 0
    never: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in never:
            return -1
        got = html.find(what, at)
        if got < 0:
            never.add(what)
        return got

    while pos < n:
        at = html.find("<", pos)
        if at < 0:
            yield html[pos:], "", False, ""
            return
        if at > pos:
            yield html[pos:at], "", False, ""
        m = TAG.match(html, at)
        if not m:
            opened = next((o for o in ("<!--", "<![CDATA[") if html.startswith(o, at)), None)
            end = find("-->" if opened == "<!--" else "]]>", at + len(opened)) if opened else -1
            if end >= 0:
                if opened != "<!--":
                    yield html[at + len(opened) : end], "", False, ""
                pos = end + 3
            elif html.startswith(("<!", "<?", "</"), at) and (end := find(">", at)) >= 0:
                pos = end + 1
            else:
                yield "<", "", False, ""
                pos = at + 1
            continue
        end = PLAIN_END.match(html, m.end(), m.end() + REACH)
        if not end and at >= unquoted:
            end = QUOTED_END.match(html, m.end(), m.end() + REACH)
            if not end:
                unquoted = at + REACH
        stop = end.end() if end else find(">", m.end()) + 1
        if not stop:  # no > any more: the rest is text
            yield html[at:], "", False, ""
            return
        pos = stop
        tag, closes = m[1].lower(), html[at + 1] == "/"
        yield "", tag, closes, html[m.end() : stop - 1]
        if not closes and tag in RAW and html[stop - 2] != "/" and f"</{tag}" not in never:
            last = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            if last:
                pos = last.start()
                yield None, tag, False, ""  # what it held is left out
            else:
                never.add(f"</{tag}")
        if not closes and tag in ("script", "style") and f"</{tag}" in never:
            pos = max(pos, html.find("<", pos)) if "<" in html[pos : pos + REACH] else pos


def blocks(html: str):
    """(node, text, characters inside links) of each block of text in page order; node is the element that holds it."""
    root = Node("", None, "")
    stack, parts, links, depth_a, out = [root], [], 0, 0, []

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1], text, links))
        parts, links = [], 0

    for piece, tag, closing, attrs in tokens(html):
        if piece is None:
            continue
        if not tag:
            piece = unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if depth_a:
                links += len(piece)
            continue
        if tag in RAW:
            if tag in ("button", "object", "title", "select"):
                flush()
            else:
                parts.append(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                depth_a = 0 if closing else 1
            if closing:
                if stack[-1].tag == tag:
                    flush()
                    stack.pop()
            elif attrs and any(is_aside := _is_aside(tag, attrs)):
                flush()
                stack.append(Node(tag, stack[-1], *is_aside))
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, max(0, len(stack) - DEPTH), -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    depth_a = 0
                    break
            continue
        closes = CLOSES.get(tag, set())
        while len(stack) > 1 and (stack[-1].tag in closes or stack[-1].tag == "p" or (stack[-1].tag in INLINE and not stack[-1].aside and not stack[-1].named)):
            stack.pop()
        # in a stack of DEPTH elements, a new one takes the place of the last
        up = stack.pop().parent if len(stack) >= DEPTH else stack[-1]
        stack.append(Node(tag, up, *_is_aside(tag, attrs)))
    flush()
    return out


def ratios(found) -> list[float]:
    """The fused ratio of each block's path: text outside links, and punctuation, are summed per root-to-leaf tag path and
    divided by the path's blocks, punctuation plus one; both are smoothed over the blocks in page order and multiplied; a path has the mean of
    its blocks."""
    size, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text, link in found:
        size[node.path] += max(0, len(text) - link)
        marks[node.path] += len(MARKS.findall(text))
        count[node.path] += 1
    own = [(size[b[0].path] / count[b[0].path], 1 + marks[b[0].path] / count[b[0].path]) for b in found]
    out = []
    for i in range(len(own)):
        near = [(w, own[i + d]) for d, w in zip((-1, 0, 1), (0.25, 0.5, 0.25), strict=True) if 0 <= i + d < len(own)]
        total = sum(w for w, _ in near)
        a, b = (sum(w * r[k] for w, r in near) / total for k in (0, 1))
        out.append(a * b)
    total = defaultdict(float)
    for b, f in zip(found, out, strict=True):
        total[b[0].path] += f
    return [total[b[0].path] / count[b[0].path] for b in found]


def main_text(html: str | None) -> str:
    """The blocks of the page's main content, joined by one space.

    All blocks get a fused ratio by their tag path (ratios()). Standing aside is a feature of it: elements that hold
    menus, headers, footers, sidebars, notices, adverts, forms or comments, by element name, role or being hidden, take
    BY_TAG of it, by class or id BY_NAME; an element with most of the page's text does not by its class or id. A block is
    selected where that reaches a fifth of the mean ratio weighted by text. The content is what stands
    in the innermost element that holds all selected text, in an article or main element if it is in one, but for blocks
    that stand aside and are not selected; so short
    paragraphs and headings of the article stay. Where selected text stands in several articles, or beside one, each such
    article is content, and so is the text selected beside them, with all its element holds if no article is in that.
    Text in elements that are never closed is read like other text.
    """

    def up(node):
        while node is not None:
            yield node
            node = node.parent

    found = blocks(html or "")
    if not found:
        return ""
    beside = _beside([b for b in found if not b[0].aside])
    weight = [BY_TAG if b[0].aside else BY_NAME if beside and not beside.isdisjoint(up(b[0])) else 1.0 for b in found]
    fused = ratios(found)
    lengths = [max(0, len(t) - link) for _, t, link in found]
    level = 0.2 * sum(f * n * w for f, n, w in zip(fused, lengths, weight, strict=True)) / max(1.0, sum(n * w for n, w in zip(lengths, weight, strict=True)))
    # links alone select nothing, nor does text aside alone
    chosen = [i for i, f in enumerate(fused) if f * weight[i] >= level and 2 * lengths[i] > len(found[i][1])] if max(weight) == 1 else []
    if not chosen:
        return ""

    def holder(of: list[Node]) -> Node:
        """The innermost element that holds all of them and can hold several blocks."""
        common = list(up(of[0]))
        for node in dict.fromkeys(of[1:]):
            own = set(up(node))
            common = [n for n in common if n in own]
        return next(n for n in common if n.tag not in SINGLE)

    picked = [found[i][0] for i in chosen]
    whole = holder(picked)
    wrap = next((n for n in up(whole) if n.tag in ("article", "main")), None)
    if wrap is not None:
        wraps, alone = {wrap}, set()
    else:  # the outermost of several articles, and what was chosen beside them
        own = {node: [n for n in up(node) if n.tag in ("article", "main")] for node in dict.fromkeys(picked)}
        wraps, beside = {ns[-1] for ns in own.values() if ns}, [node for node, ns in own.items() if not ns]
        rest = holder(beside) if beside else None
        if rest is not None and not any(rest in up(n) for n in wraps):
            wraps.add(rest)
        loose = set(beside)
        alone = {i for i in chosen if found[i][0] in loose}
    chosen = set(chosen)
    return " ".join(t for i, (node, t, _) in enumerate(found) if i in alone or (weight[i] == 1 or i in chosen) and any(n in wraps for n in up(node)))


def extract(pages: DataFrame, html_col: str = "html", to: str = "_main") -> DataFrame:
    """pages' columns but the html, plus `to`, which must be no column yet. Null or empty html has no text; a page of any length is read whole;
    repeated pages stay; an empty table gives an empty table."""
    keep = [c for c in pages.columns if c != html_col]
    if to in keep:
        raise ValueError(f"there is a column {to} already")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([main_text(h) for h in b.column(html_col).to_pylist()], pa.string())], names=[*keep, to])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in keep]
    return mapped(pages, run, ", ".join([*kinds, f"`{to}` string"]))


def query(spark, pages: DataFrame) -> DataFrame:
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_main").alias("text"), F.char_length("_main").cast("long").alias("n_chars"))
