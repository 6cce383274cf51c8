"""Main text of pages by gradient-boosted trees over the nodes of the document tree.

A page is parsed into a tree of block elements. Each node gets features of its own tag and attribute tokens, its depth, the
density of text, links and markup in its subtree, and how it stands among its siblings and under its ancestors. Boosted trees
give every node the log-odds of being main text. Hierarchical decoding then chooses labels for all nodes together: nothing
under a rejected node is kept, and among all choices that obey this the one with the largest sum of log-odds is taken.

The trees are learned on the driver from at most ``rows`` pages, chosen by hashed key (a bound of memory, stated here). Their
text is set into page layouts drawn at random with menus, headers, footers, side columns, notices, adverts, forms, lists of
links and reader comments under many names, whose parts are known; the pages themselves join in where their markup says what a
part is (article, main, nav, aside, footer, form).

Every run of text that stands in the body itself, outside of any block element, is a nameless block of its own and is judged
like the others; a page without any block element is all main text.

The text of a page is that of its kept blocks in page order, one line each, character references decoded and white space
turned into single spaces. Scripts, styles, titles and text fields are skipped to their end. Drawings, choices, templates,
frames, fallbacks for absent scripts and the source notes of formulas are skipped as elements: one that closes itself holds
nothing, an unclosed drawing or choice ends where a block begins or ends, and of the others an unclosed one is only a tag and
its content is read. The text of formulas is read. Null or empty html, and pages without a kept block, give an empty text. Cut-off pages are read to
their end. Repeated rows give repeated results; an empty table gives an empty result. Only key, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees
from .common import batches_by_bytes

C = F.col
# Bound of the sample that is learned from, and layouts drawn from it.
SAMPLE, LAYOUTS = 300, 900
BYTES = 1 << 20

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())  # no tags inside
DROPPED = set("noscript iframe noembed noframes xmp template svg select annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
             "strike strong sub sup time tt u var br wbr img input button option output meter progress picture "
             "source math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup "
             "msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Attribute tokens that tell what a part of a page is for.
GOOD = set("article content main post story entry body text prose page document news blog single columns lead "
           "paragraph section abstract chapter".split())
BAD = {t: i for i, group in enumerate((
    "nav navbar navigation menu menus breadcrumb breadcrumbs tabs toc skip topbar toolbar",
    "header masthead banner branding logo hero top site",
    "footer foot copyright legal colophon bottom imprint",
    "sidebar side aside rail widget widgets secondary complementary",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion teaser dfp adsense",
    "notice cookie cookies consent gdpr alert popup modal overlay dialog newsletter subscribe signup paywall message",
    "comment comments reply replies respond discussion disqus thread reader readers responses feedback review reviews",
    "share sharing social follow related recommended recommendations more popular trending tags pagination pager links",
    "form login search contact register input poll survey", "hidden none meta byline print")) for t in group.split()}
TAGS = ("nav footer form aside menu dialog header ul ol li dl dt dd table tbody thead tr td th fieldset figure figcaption "
        "address details summary div other section body html h1 h2 h3 h4 h5 h6 pre blockquote p main article").split()
TAG_RANK = {t: i for i, t in enumerate(TAGS)}
TAG_RANK[""] = TAG_RANK["div"]  # a nameless block
OUTER = {"nav": 0, "aside": 1, "footer": 2, "form": 3, "header": 4, "menu": 0, "dialog": 3}

# Tags that a drawing or a choice cannot hold.
BREAKS = set(TAGS) - {"other"} | set("center hr hgroup search input textarea".split())

_TAG = re.compile(r"<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(?=[a-zA-Z/!?])")
_TOKEN = re.compile(r"(?:class|id|role|itemprop|aria-label|data-role|name|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "depth", "children", "chars", "words", "links", "marks", "nodes", "items",
                 "paragraphs", "controls", "headings", "leaves", "start", "own")

    def __init__(self, tag: str, attrs: str, parent: int, depth: int):
        self.tag, self.attrs, self.parent, self.depth = tag, attrs, parent, depth
        self.children: list[int] = []
        self.chars = self.words = self.links = self.marks = self.nodes = self.items = 0
        self.paragraphs = self.controls = self.headings = self.leaves = self.start = self.own = 0


def _past(page: str, name: str, at: int) -> int:
    """The place after the next closing tag of ``name``, or the end of the page."""
    end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
    return len(page) if end is None else end.end()


def dropped_ends(page: str) -> dict[int, int]:
    """Where every dropped element ends, by the place after its start tag; an unclosed one that ends nowhere is left out."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    loose = ("svg", "select")  # these need no closing tag

    def pop(to: int, end: int) -> None:
        while len(stack) > to:
            name, start = stack.pop()
            if name in loose:
                ends[start] = end

    n, at = len(page), 0
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            end = page.find("-->" if m.group(0) == "<!--" else ">", at) if m.group(0) in ("<!--", "<") else at
            at = n if end < 0 else end + len("-->") if m.group(0) == "<!--" else end + (m.group(0) == "<")
            continue
        name, attrs = m.group(2).lower(), m.group(3)
        drawn = any(k == "svg" for k, _ in stack[-1:])
        closed = attrs.rstrip().endswith("/")
        if m.group(1):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    ends[stack[i][1]] = at
                    pop(i + 1, m.start())
                    stack.pop()
                    break
            else:
                while name in BREAKS and stack and stack[-1][0] in loose:
                    pop(len(stack) - 1, m.start())
        elif name in RAW and not (drawn and closed):
            if stack and stack[-1][0] == "select" and name == "textarea":
                pop(len(stack) - 1, m.start())
            at = _past(page, name, at)
        elif name == "foreignobject" and drawn and not closed:
            stack.append((name, at))
        elif name in DROPPED and not closed:
            if name == "select" and stack and stack[-1][0] == "select":
                pop(len(stack) - 1, m.start())
            stack.append((name, at))
        elif name in BREAKS:
            while stack and stack[-1][0] in loose:
                pop(len(stack) - 1, m.start())
    pop(0, n)
    return ends


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes, the first of which is the root, and the text of every block run with its node, in page order."""
    nodes = [Node("html", "", -1, 0)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block node each belongs to
    held: list[str] = []
    anchors = at = 0
    ends: dict[int, int] | None = None

    def text(raw: str) -> None:
        if raw:
            held.append(raw)
            if anchors:
                nodes[stack[-1][1]].links += len(raw.strip())

    def close() -> None:
        if held:
            line = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if line:
                block = stack[-1][1]
                if not block:  # text of the body itself
                    block = len(nodes)
                    nodes.append(Node("", "", 0, 1))
                    nodes[0].children.append(block)
                    nodes[block].start = len(runs)
                    nodes[block].links, nodes[0].links = nodes[0].links, 0
                runs.append((block, line))

    def pop(to: int) -> None:
        nonlocal anchors
        while len(stack) > to:
            name, block = stack.pop()
            if name == "a":
                anchors -= 1
            if name not in INLINE and held:
                stack.append((name, block))
                close()
                stack.pop()

    n = len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        whole = m.group(0)
        if whole == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if whole == "<":  # a tag that does not end, or has an open quote
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        if m.group(2) is None:
            continue
        name, attrs = m.group(2).lower(), m.group(3)
        if m.group(1):
            if name in ("body", "html"):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name in ("select", "textarea"):
            nodes[stack[-1][1]].controls += 1
        if name in RAW:
            at = _past(page, name, at)
            continue
        if name in DROPPED:
            if ends is None:
                ends = dropped_ends(page)
            at = ends.get(at, at)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in ("input", "button"):
            nodes[stack[-1][1]].controls += 1
        if name in VOID:
            if name == "hr":
                close()
            continue
        if name in INLINE:
            if not attrs.rstrip().endswith("/"):
                stack.append((name, stack[-1][1]))
                anchors += name == "a"
            continue
        if name in ("html", "body", "head"):
            close()
            if name == "head":
                stack.append((name, stack[-1][1]))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "head":
                        pop(i)
                        break
            continue
        # what a block start tag closes: an open paragraph, or its own kind inside the same list or table
        shut = {"p"} | HEADINGS if name == "p" else {"p"}
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in shut:
                pop(i)
                break
            if stack[i][0] not in INLINE:
                break
        if name in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in HOLDS[name]:
                    break
                if stack[i][0] in CLOSES[name]:
                    pop(i)
                    break
        close()
        parent = stack[-1][1]
        nodes.append(Node(name, attrs, parent, nodes[parent].depth + 1))
        nodes[parent].children.append(len(nodes) - 1)
        nodes[-1].start = len(runs)
        stack.append((name, len(nodes) - 1))
    pop(1)
    close()
    return nodes, runs


def tokens(attrs: str) -> list[str]:
    """Lower-cased parts of the telling attributes."""
    out = []
    for a, b, c in _TOKEN.findall(attrs):
        out += [p.lower() for p in _PART.findall(a or b or c)]
    return out


FEATURES = 34


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    for i, (at, line) in enumerate(runs):
        x = nodes[at]
        x.chars += len(line)
        x.own += len(line)
        x.words += line.count(" ") + 1
        x.marks += sum(map(line.count, ".,;!?:"))
        x.leaves += 1
    for i in range(n - 1, 0, -1):
        x, up = nodes[i], nodes[nodes[i].parent]
        x.items += x.tag == "li"
        x.paragraphs += x.tag == "p"
        x.headings += x.tag in HEADINGS
        up.chars += x.chars
        up.words += x.words
        up.links += x.links
        up.marks += x.marks
        up.leaves += x.leaves
        up.items += x.items
        up.paragraphs += x.paragraphs
        up.headings += x.headings
        up.controls += x.controls
        up.nodes += x.nodes + 1
    total = max(1, nodes[0].chars)
    rows = np.zeros((n, FEATURES))
    before = np.concatenate(([0], np.cumsum([len(line) for _, line in runs])))
    good, bad, outer, inner = [99] * n, [99] * n, [99] * n, [0] * n
    kind = [-1] * n
    place = [0] * n
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c] = k
    mean_sibling = [sum(nodes[c].chars for c in x.children) / max(1, len(x.children)) for x in nodes]
    for i, x in enumerate(nodes):
        names = tokens(x.attrs) if x.attrs else ()
        plus = sum(t in GOOD for t in names)
        groups = [BAD[t] for t in names if t in BAD]
        up = x.parent
        good[i] = 0 if plus else min(99, good[up] + 1) if i else 99
        bad[i] = 0 if groups else min(99, bad[up] + 1) if i else 99
        kind[i] = groups[0] if groups else kind[up] if i else -1
        outer[i] = 0 if x.tag in OUTER else min(99, outer[up] + 1) if i else 99
        inner[i] = (inner[up] if i else 0) or x.tag in ("article", "main")
        siblings = len(nodes[up].children) if i else 1
        chars = max(1, x.chars)
        rows[i] = (
            TAG_RANK.get(x.tag, TAG_RANK["other"]), plus, len(groups), groups[0] if groups else -1, good[i], bad[i], kind[i],
            outer[i], OUTER.get(x.tag, -1), inner[i], x.depth, np.log1p(x.chars), np.log1p(x.words / max(1, x.leaves)),
            x.links / chars, 100 * x.nodes / chars, x.marks / max(1, x.words), siblings, place[i] / siblings,
            np.log1p(mean_sibling[up] if i else x.chars), x.chars / max(1, nodes[up].chars) if i else 1.0,
            before[x.start] / total, x.chars / total, np.log1p(x.controls), np.log1p(x.items), np.log1p(x.paragraphs),
            nodes[up].links / max(1, nodes[up].chars) if i else 0.0, np.log1p(x.headings), x.own / chars,
            np.log1p(nodes[up].controls if i else 0), np.log1p(nodes[up].paragraphs if i else 0),
            np.log1p(x.leaves), len(names) > 0, (before[x.start] + x.chars) / total, inner[up] if i else 0)
    return rows


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the largest sum of log-odds among all choices in which a kept node's ancestors are kept."""
    n = len(nodes)
    weight = np.array([np.sqrt(1 + x.leaves) for x in nodes])
    score = np.clip(odds, -8, 8) * weight
    gain = np.where([x.leaves > 0 for x in nodes], score, 0.0)
    gain[0] = 0.0  # the root only holds the others together
    best = gain.copy()
    for i in range(n - 1, 0, -1):
        best[nodes[i].parent] += max(0.0, best[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return kept


def main_text(page: str | None, trees: Trees | None) -> str:
    return main_texts([page], trees)[0]


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    """Main texts of a batch; the trees decide the nodes of all pages at once."""
    parsed = [parse(p or "") for p in pages]
    if trees is None or not pages:
        return [""] * len(pages)
    rows = [features(*p) for p in parsed]
    odds = trees.decide(np.concatenate(rows))
    out, at = [], 0
    for nodes, runs in parsed:
        kept = decode(nodes, odds[at:at + len(nodes)])
        if not any(x.tag for x in nodes[1:]):
            kept[:] = True
        out.append("\n".join(line for node, line in runs if kept[node]))
        at += len(nodes)
    return out


# --- learning ---------------------------------------------------------------------------------------------------------

# Names that the parts of drawn layouts go by.
_NAMES = {
    "main": "content main-content post-body entry-content story article-body page-content blog-post prose c1 x7 wrap col-8 box",
    "nav": "nav navbar menu main-menu site-nav top-links breadcrumbs navigation c2 x1 bar row",
    "header": "header masthead site-header topbar banner branding x2 c3 top",
    "footer": "footer site-footer foot bottom copyright legal x3 c4 end",
    "side": "sidebar side right-rail widget secondary related-posts popular x4 c5 col-4 box",
    "ad": "ad ads advert ad-slot sponsored promo banner-ad x5 c6 dfp",
    "notice": "notice cookie-banner consent gdpr alert newsletter subscribe popup x6 c7 message",
    "comments": "comments comment-list discussion responses reader-comments replies x8 c8 thread",
    "form": "form search login contact-form signup x9 c9 feedback",
    "share": "share social related recommended tags more-links pagination x0 c0 pager"}
_SEMANTIC = {"main": ("article", "main", "div", "div", "section"), "nav": ("nav", "nav", "div", "ul"),
             "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "aside", "div"),
             "ad": ("div", "div", "aside", "section"), "notice": ("div", "section", "aside", "dialog"),
             "comments": ("section", "div", "div", "ol"), "form": ("form", "form", "div"), "share": ("div", "ul", "section", "p")}


class Layouts:
    """Random pages around given paragraphs; every part's element carries a mark that says whether it is main text."""

    def __init__(self, paragraphs: list[str], seed: int = 11):
        self.rng, self.paragraphs = np.random.default_rng(seed), paragraphs

    def _some(self, low: int, high: int, longest: int = 10_000) -> list[str]:
        n = int(self.rng.integers(low, high + 1))
        return [self.paragraphs[i][:longest] for i in self.rng.integers(0, len(self.paragraphs), n)]

    def _words(self, low: int, high: int) -> str:
        text = self.paragraphs[self.rng.integers(0, len(self.paragraphs))].split()
        n = int(self.rng.integers(low, high + 1))
        return entities.escape(" ".join(text[:n]) or "x", quote=False)

    def _maybe(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def _open(self, part: str, good: bool) -> tuple[str, str]:
        tag = self.rng.choice(_SEMANTIC[part])
        name = self.rng.choice(_NAMES[part].split()) if self._maybe(0.75) else ""
        attr = "" if not name else f' {self.rng.choice(["class", "id"])}="{name}"'
        return f'<{tag}{attr} data-part="{int(good)}">', f"</{tag}>"

    def _part(self, part: str) -> str:
        rng = self.rng
        start, end = self._open(part, part == "main")
        if part == "main":
            body = [f"<h1>{self._words(3, 12)}</h1>"] if self._maybe(0.8) else []
            if body and self._maybe(0.2):
                body = [f"<header>{body[0]}</header>"]
            for k, p in enumerate(self._some(1, 25)):
                p = entities.escape(p, quote=False)
                way = rng.random()
                if way < 0.70:
                    body.append(f"<p>{p}" + ("</p>" if self._maybe(0.9) else ""))
                elif way < 0.78:
                    body.append(f"<p><b>{p}<br>")
                elif way < 0.83:
                    body.append(f"<h2>{self._words(2, 8)}</h2><p>{p}</p>")
                elif way < 0.88:
                    body.append("<ul>" + "".join(f"<li>{self._words(3, 20)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
                elif way < 0.92:
                    body.append(f"<blockquote><p>{p}</p></blockquote>")
                elif way < 0.95:
                    body.append(f"<pre>{p}</pre>")
                elif way < 0.98:
                    body.append(f"<div>{p}</div>")
                else:
                    body.append("<table>" + "".join(f"<tr><td>{self._words(1, 4)}</td><td>{self._words(1, 6)}</td></tr>"
                                                    for _ in range(rng.integers(2, 6))) + "</table>")
                if k and self._maybe(0.04):
                    body.append(self._part(rng.choice(["ad", "share", "notice", "form", "side"])))
            inner = "".join(body)
        elif part in ("nav", "share"):
            items = [f'<a href="/x">{self._words(1, 4)}</a>' for _ in range(rng.integers(2, 12))]
            inner = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self._maybe(0.7) else " | ".join(items)
        elif part == "header":
            inner = f'<a href="/">{self._words(1, 3)}</a>' + (f"<p>{self._words(3, 10)}</p>" if self._maybe(0.6) else "") + (
                self._part("nav") if self._maybe(0.5) else "")
        elif part == "footer":
            inner = f"&copy; {self._words(1, 25)}" + (f'<p>{self._words(4, 30)} <a href="/t">{self._words(1, 3)}</a></p>'
                                                       if self._maybe(0.5) else "")
        elif part == "side":
            inner = "".join(f"<h3>{self._words(1, 4)}</h3>" + (
                f"<p>{self._words(5, 60)}</p>" if self._maybe(0.5) else
                "<ul>" + "".join(f'<li><a href="/y">{self._words(2, 8)}</a></li>' for _ in range(rng.integers(2, 7))) + "</ul>")
                for _ in range(rng.integers(1, 4)))
        elif part == "ad":
            inner = self._words(3, 25) if self._maybe(0.6) else f'<p>{self._words(3, 30)}</p><a href="/buy">{self._words(1, 3)}</a>'
        elif part == "notice":
            inner = f"<p>{self._words(6, 45)}</p>" + (f"<button>{self._words(1, 2)}</button>" if self._maybe(0.6) else "")
        elif part == "form":
            inner = "".join(f'<label>{self._words(1, 3)}</label><input name="f{k}">' for k in range(rng.integers(1, 5))) + (
                f"<p>{self._words(4, 30)}</p>" if self._maybe(0.4) else "") + f"<button>{self._words(1, 2)}</button>"
        else:  # comments
            inner = f"<h3>{self._words(1, 3)}</h3>" if self._maybe(0.7) else ""
            tag = "li" if start.startswith("<ol") else rng.choice(["div", "article", "li", "p"])
            for _ in range(rng.integers(1, 9)):
                name = rng.choice(["", ' class="comment"', ' class="reply"', ' class="c11"'])
                author = rng.choice(["", f"<b>{self._words(1, 2)}</b> ", f'<span class="author">{self._words(1, 2)}</span> '])
                text = f"<p>{self._words(4, 90)}</p>" if tag != "p" and self._maybe(0.7) else self._words(4, 90)
                inner += f"<{tag}{name}>{author}{text}</{tag}>"
            inner += self._part("form") if self._maybe(0.3) else ""
        return start + inner + end

    def page(self) -> str:
        rng, out = self.rng, []
        for part, share in (("notice", 0.35), ("header", 0.6), ("nav", 0.7), ("ad", 0.5), ("form", 0.15), ("side", 0.2)):
            if self._maybe(share):
                out.append(self._part(part))
        main = self._part("main")
        after = [self._part(part) for part, share in (("share", 0.4), ("comments", 0.45), ("side", 0.4), ("ad", 0.3),
                                                       ("notice", 0.2), ("form", 0.2), ("footer", 0.8)) if self._maybe(share)]
        if self._maybe(0.3):
            main = f'<div class="{rng.choice(["wrap", "container", "layout", "page", "row"])}">{main}{"".join(after[:-1])}</div>'
            after = after[-1:]
        return "<html><head><title>x</title></head><body>" + "".join(out) + main + "".join(after) + "</body></html>"


_MARK = re.compile(r'data-part="([01])"')
_REAL = {"article": 1, "main": 1, "nav": 0, "aside": 0, "footer": 0, "form": 0, "script": 0}


def _labelled(page: str, drawn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes whose label is known. The innermost marked ancestor decides."""
    nodes, runs = parse(page)
    label = [-1] * len(nodes)
    for i, x in enumerate(nodes):
        up = label[x.parent] if i else -1
        if drawn:
            m = _MARK.search(x.attrs)
            label[i] = int(m.group(1)) if m else up
        else:
            own = _REAL.get(x.tag, -1)
            if own < 0 and any(t in BAD for t in tokens(x.attrs)):
                own = 0
            label[i] = 0 if up == 0 else own if own >= 0 else up
    x = features(nodes, runs)
    y = np.array(label)
    # a wrapper that holds main text must be kept for it
    for i in range(len(nodes) - 1, 0, -1):
        if y[i] == 1 and y[nodes[i].parent] < 0:
            y[nodes[i].parent] = 1
    use = (y >= 0) & (np.array([n.leaves for n in nodes]) > 0)
    use[0] = False
    return x[use], y[use]


def learn(pages: list[str], layouts: int = LAYOUTS, seed: int = 11) -> Trees | None:
    """Trees from drawn layouts around the pages' own paragraphs, and from the parts of the pages that say what they are."""
    paragraphs = [line for p in pages for _, line in parse(p)[1] if line.count(" ") >= 3]
    if not paragraphs:
        return None
    draw = Layouts(paragraphs, seed)
    known = [_labelled(draw.page(), True) for _ in range(layouts)] + [_labelled(p, False) for p in pages]
    x, y = np.concatenate([a for a, _ in known]), np.concatenate([b for _, b in known])
    if len(set(y.tolist())) < 2:
        return None
    return Trees().fit(x, y.astype(float))


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = SAMPLE, longest: int = 200_000) -> Trees | None:
    """Learn from at most ``rows`` pages of at most ``longest`` characters: ids first, then one html for each (the
    smallest, where a key has several) reach the driver."""
    some = pages.filter(C(html).isNotNull() & C(key).isNotNull() & (F.length(html) <= longest))
    ids = some.select(C(key).alias("_key")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(rows)
    got = some.select(C(key).alias("_key"), C(html).alias("_html")).join(ids, "_key")
    got = got.groupBy("_key").agg(F.min("_html").alias("_html")).toArrow().sort_by("_key")
    return learn(got.column("_html").to_pylist())


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, ``text``, ``n_chars`` for every page. Narrow after the fit: no shuffle."""
    trees = fit(pages, key, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in batches_by_bytes(pc.binary_length(whole.column(2)).fill_null(0).to_pylist(), BYTES):
                part = whole.slice(lo, hi - lo)
                texts = main_texts(part.column(2).to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())],
                                                 names=["k", "u", "text"])

    kinds = dict(pages.dtypes)
    rows = pages.select(C(key).alias("k"), C(url).alias("u"), C(html).alias("h"))
    out = rows.mapInArrow(run, f"k {kinds[key]}, u {kinds[url]}, text string")
    return out.select(C("k").alias(key), C("u").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
