"""Operator 3: main text of web pages by boosted trees over DOM nodes.

A page is parsed into a tree of elements.  Gradient-boosted trees score every
element from its subtree's text and link density, its tag, the tokens of its
class, id and role, its depth, its siblings and its ancestors.  Decoding works on
the tree as a whole: an element can be content only inside content, and the
labels with the largest total score under that rule are found from the leaves up,
so no article hangs below a rejected ancestor.  The trees are fitted on pages that
this module writes itself in many layouts, where the main text is known.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .trees import Boosted, boost

#: Quotes count only straight after "=", and only where they close: elsewhere an apostrophe is a character.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is characters up to their end tag.  Without one, script and style take the
#: rest of the page and the others are empty.
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
#: Elements whose text never shows.
HIDDEN = frozenset("script style head title noscript template iframe noembed noframes svg select option optgroup textarea button datalist audio video canvas".split())
#: Elements that a page may forget to end: without an end tag further on they are empty.
LOOSE = frozenset("noscript template svg math object select button datalist audio video canvas".split())
#: Of these, those that a block's start tag ends.
INLINE_HIDDEN = frozenset("svg math select option optgroup datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends these open elements, up to the nearest of its bounds.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
FORMATTING = frozenset("a abbr b big cite code em font i ins kbd mark q s small span strong sub sup tt u var label".split())

TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "span", "body", "figure", "dl")
#: Parts of class, id and role values that layouts use, by what they tell.
HINTS = (
    ("article", "post", "entry", "story"),
    ("content", "main", "body", "text", "prose"),
    ("nav", "menu", "breadcrumb", "breadcrumbs", "navigation", "toc", "pagination", "pager", "skip"),
    ("header", "masthead", "banner", "top", "logo", "brand"),
    ("footer", "copyright", "legal", "bottom", "colophon", "contentinfo"),
    ("sidebar", "side", "aside", "widget", "rail", "complementary"),
    ("ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promoted", "adsbygoogle"),
    ("comment", "comments", "disqus", "reply", "replies", "respond", "discussion", "reader"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "paywall", "privacy"),
    ("related", "recommended", "more", "share", "sharing", "social", "tags", "meta", "byline", "author", "popular", "trending", "search", "login"),
)
_HINT = {word: i for i, words in enumerate(HINTS) for word in words}


class Element:
    __slots__ = ("attributes", "children", "depth", "hints", "index", "links", "n_tags", "own", "parent", "parts", "paragraphs", "stops", "tag", "text", "words")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element] = []
        self.parts: list = []  # texts and elements in page order
        self.depth = parent.depth + 1 if parent else 0


def parse(page: str) -> Element:
    """The element tree of a page, in time proportional to its length.

    Tags that aren't closed end where HTML would end them, or with their parent; stray
    end tags are passed over; a comment, tag, script or style that the page's end cuts
    off takes the rest."""
    root = here = Element("html", "", None)
    at, n = 0, len(page)
    is_open: Counter[str] = Counter()  # of the elements from here up to the root
    ends: dict[str, int] = {}  # place of the next end tag by name, n without one

    def leave(node: Element) -> None:
        nonlocal here
        while here is not node.parent:
            is_open[here.tag] -= 1
            here = here.parent

    def end_of(tag: str) -> int:
        """Place of the next end tag, the page's length without one."""
        if ends.get(tag, -1) < at:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            ends[tag] = found.start() if found else n
        return ends[tag]

    while at < n:
        lower = page.find("<", at)
        if lower < 0:
            lower = n
        if lower > at:
            here.parts.append(page[at:lower])
        if lower == n:
            break
        m = _TOKEN.match(page, lower)
        if not m:
            here.parts.append("<")
            at = lower + 1
            continue
        at = m.end()
        name = m[1]
        if not name:
            if page.startswith("<![CDATA[", lower):
                here.parts.append(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = name.lower()
        if page.startswith("</", lower):
            if tag == "br":
                here.parts.append(" ")
            if is_open[tag] <= 0:
                continue
            node = here
            while node.tag != tag and not (tag in FORMATTING and node.tag in BLOCKS):  # an inline end tag doesn't close blocks
                node = node.parent
            if node.tag == tag:
                leave(node)
            continue
        if tag == "br" or tag == "wbr":
            here.parts.append(" " if tag == "br" else "")
            continue
        if tag == "html":
            root.attributes = root.attributes or m[2]
            continue
        if tag in BLOCKS:  # a block ends an open paragraph, and what can't hold blocks
            node = here
            while node is not root and node.tag in FORMATTING:
                node = node.parent
            while node is not root and node.tag in INLINE_HIDDEN:
                leave(node)
                node = here
            if node.tag == "p":
                leave(node)
        if tag in CLOSES and any(is_open[t] > 0 for t in CLOSES[tag][0]):
            closed, bounds = CLOSES[tag]
            node = here
            while node is not root and node.tag not in bounds:
                if node.tag in closed:
                    leave(node)
                    break
                node = node.parent
        child = Element(tag, m[2] or "", here)
        here.children.append(child)
        here.parts.append(child)
        if tag in VOID:  # a slash before ">" ends no other element
            continue
        if tag in RAW:
            end = end_of(tag)
            if end < n:
                at = _TOKEN.match(page, end).end()
            elif tag in ("script", "style"):
                at = n
            continue
        if tag in LOOSE and end_of(tag) == n:
            continue
        here = child
        is_open[tag] += 1
    return root


def _hints(attributes: str) -> list[int]:
    found = [0] * len(HINTS)
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[2] and m[1].lower() in ("class", "id", "role", "aria-label", "itemprop"):
                for word in _WORD.findall(m[2]):
                    at = _HINT.get(word.lower())
                    if at is not None:
                        found[at] = 1
    return found


def nodes_of(root: Element) -> list[Element]:
    """Visible elements in page order, with the sums over their subtrees."""
    found: list[Element] = []
    todo = [root]
    while todo:
        node = todo.pop()
        node.index = len(found)
        found.append(node)
        node.children = [c for c in node.children if c.tag not in HIDDEN]
        todo.extend(reversed(node.children))
    for node in reversed(found):
        text = "".join([p for p in node.parts if isinstance(p, str)])
        node.own = len(text.strip())
        node.text = node.own + sum(c.text for c in node.children)
        node.words = text.count(" ") + bool(node.own) + sum(c.words for c in node.children)
        node.stops = text.count(".") + text.count(",") + sum(c.stops for c in node.children)
        node.links = node.text if node.tag == "a" else sum(c.links for c in node.children)
        node.n_tags = 1 + sum(c.n_tags for c in node.children)
        node.paragraphs = (node.tag == "p") + sum(c.paragraphs for c in node.children)
        node.hints = _hints(node.attributes)
    return found


N_FEATURES = 17 + len(TAGS) + 2 * len(HINTS) + 4


def features(nodes: list[Element]) -> np.ndarray:
    out = np.zeros((len(nodes), N_FEATURES))
    tag_at = {t: i for i, t in enumerate(TAGS)}
    total = max(1, nodes[0].text)
    above: list[list[int]] = []
    same: dict[int, Counter[str]] = {}  # tags and the largest text among a node's children
    largest: dict[int, int] = {}
    for node in nodes:
        same[node.index] = Counter(c.tag for c in node.children)
        largest[node.index] = max((c.text for c in node.children), default=0)
    for row, node in enumerate(nodes):
        parent = node.parent
        inherited = [0] * (len(HINTS) + 4)
        if parent is not None:
            up = above[parent.index]
            inherited = [max(a, b) for a, b in zip(up[: len(HINTS)], parent.hints, strict=True)] + [
                max(up[len(HINTS)], parent.tag in ("nav", "menu")),
                max(up[len(HINTS) + 1], parent.tag in ("header", "footer")),
                max(up[len(HINTS) + 2], parent.tag in ("aside", "form", "dialog")),
                max(up[len(HINTS) + 3], parent.tag in ("article", "main")),
            ]
        above.append(inherited)
        siblings = parent.children if parent else [node]
        size = max(1, node.text)
        around = max(1, parent.text if parent else node.text)
        out[row, :17] = (
            np.log1p(node.text), np.log1p(node.own), np.log1p(node.words), node.text / total, node.text / around, node.links / size,
            node.stops / max(1, node.words), np.log1p(node.n_tags), node.n_tags / (1 + node.words), np.log1p(node.paragraphs),
            node.text / (1 + node.n_tags), node.depth, len(siblings), len(node.children), same[parent.index][node.tag] if parent else 1,
            (largest[parent.index] if parent else node.text) / around, node.words / (1 + node.paragraphs),
        )
        if node.tag in tag_at:
            out[row, 17 + tag_at[node.tag]] = 1
        out[row, 17 + len(TAGS) : 17 + len(TAGS) + len(HINTS)] = node.hints
        out[row, 17 + len(TAGS) + len(HINTS) :] = inherited
    return out


def decode(nodes: list[Element], logit: np.ndarray) -> np.ndarray:
    """The labels with the largest total score among those where content stands only in
    content; the root counts as content.  A score is the log-odds of content.

    Words in a line are one text: a formatting element or link without telling attributes
    goes with the text that it stands in."""
    gain = [0.0] * len(nodes)
    tied = [n.parent is not None and n.tag in FORMATTING and n.parent.own > 0 and not any(n.hints) for n in nodes]
    for node in reversed(nodes):
        own = 0.0 if tied[node.index] else float(logit[node.index])
        gain[node.index] = own + sum(gain[c.index] if tied[c.index] else max(0.0, gain[c.index]) for c in node.children)
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for node in nodes[1:]:
        keep[node.index] = keep[node.parent.index] and (tied[node.index] or gain[node.index] > 0)
    return keep


def blocks(nodes: list[Element], keep: np.ndarray) -> list[str]:
    """Texts of kept elements by block, in page order, with single spaces."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [(nodes[0], 0)]
    while todo:
        node, at = todo.pop()
        block = node.tag in BLOCKS
        if at == 0 and block:
            end()
        parts = node.parts
        while at < len(parts):
            part = parts[at]
            at += 1
            if isinstance(part, str):
                line.append(part)
            elif part.tag not in HIDDEN and keep[part.index]:
                todo.append((node, at))
                todo.append((part, 0))
                break
            elif part.tag in BLOCKS:
                end()
        else:
            if block:
                end()
    end()
    return out


def _page(r: random.Random) -> str:
    """A page in one of many layouts; main text is written with the mark \x01."""
    vowels, rest = "aeiouéü", "bcdfghklmnprstvwz"

    def word() -> str:
        return "".join(r.choice(rest) + r.choice(vowels) for _ in range(r.randint(1, 4)))

    def words(low: int, high: int, mark: str = "") -> str:
        n = r.randint(low, high)
        out = []
        for i in range(n):
            out.append(mark + word() + (r.choice([",", ".", "!!", "***"]) if r.random() < 0.12 else ""))
        return " ".join(out).capitalize()

    def links(n: int, wrap: str = "li") -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(n)]
        return "".join(f"<{wrap}>{i}</{wrap}>" for i in items) if wrap else " | ".join(items)

    def box(kind: str, inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        name = r.choice([kind, f"{kind}-box", f"page-{kind}", f"{kind} wrapper", f"site_{kind}"])
        attribute = r.choice(["class", "class", "id"])
        return f'<{(tag := r.choice(tags))} {attribute}="{name}">{inner}</{tag}>'

    def paragraph(mark: str, low: int = 5, high: int = 90) -> str:
        text = words(low, high, mark)
        if r.random() < 0.2:
            text = f"<b>{text}</b>" if r.random() < 0.5 else f"<b>{text}<br>"
        elif r.random() < 0.25:
            text += f' <a href="/{word()}">{words(1, 3, mark)}</a> ' + words(2, 20, mark)
        return f"<p>{text}" + ("</p>" if r.random() < 0.9 else "")

    def body_text() -> str:
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.08:
                out.append(f"<h2>{words(2, 7, M)}</h2>")
            elif kind < 0.14:
                out.append("<ul>" + "".join(f"<li>{words(2, 12, M)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.18:
                out.append(f"<blockquote>{paragraph(M)}</blockquote>")
            elif kind < 0.21:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3, M)}</td><td>{words(1, 3, M)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.24:
                out.append(box("ad", words(3, 10), ("div", "aside")))
            elif kind < 0.27:
                out.append(f"<pre>{words(3, 20, M)}</pre>")
            else:
                out.append(paragraph(M, *r.choice([(1, 6), (5, 40), (30, 120)])))
        return "".join(out)

    M = "\x01"
    inner = (f"<h1>{words(2, 10, M)}</h1>" if r.random() < 0.85 else "") + body_text()
    kind = r.random()
    if kind < 0.45:
        main = f"<article>{inner}</article>"
    elif kind < 0.6:
        main = f"<main>{inner}</main>" if r.random() < 0.5 else f'<main id="main"><article class="post">{inner}</article></main>'
    else:
        main = box(r.choice(["content", "article", "post-body", "entry-content", "story", "main-text", "prose"]), inner)
    before, after = [], []
    if r.random() < 0.8:
        before.append(r.choice([f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", box("menu", f"<ul>{links(r.randint(3, 8))}</ul>"), f"<nav>{links(4, '')}</nav>"]))
    if r.random() < 0.4:
        before.append(r.choice([f"<header>{words(1, 5)}<p>{words(3, 10)}</p></header>", box("header", f"<a href='/'>{words(1, 3)}</a><p>{words(2, 9)}</p>")]))
    for place, chance in ((before, 0.5), (after, 0.3)):
        if r.random() < chance:
            place.append(box(r.choice(["ad", "ads", "sponsored", "advert", "promo"]), r.choice([words(3, 30), f"<p>{words(3, 25)}</p>"]), ("div", "aside")))
    if r.random() < 0.35:
        r.choice([before, after]).append(box(r.choice(["cookie-notice", "consent", "notice", "newsletter", "subscribe popup"]), f"<p>{words(6, 30)}</p><button>{words(1, 2)}</button>"))
    if r.random() < 0.4:
        r.choice([before, after]).append(r.choice([f"<aside>{words(2, 4)}<ul>{links(4)}</ul><p>{words(5, 30)}</p></aside>", box("sidebar", f"<h3>{words(1, 3)}</h3><ul>{links(5)}</ul><p>{words(3, 40)}</p>")]))
    if r.random() < 0.3:
        r.choice([before, after]).append(f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><p>{words(2, 12)}</p><button>{words(1, 1)}</button></form>')
    if r.random() < 0.4:
        comments = "".join(r.choice([f'<li><p>{words(3, 60)}</p></li>', f'<div class="comment"><b>{word()}</b><p>{words(3, 60)}</p></div>']) for _ in range(r.randint(1, 6)))
        after.append(r.choice([f'<section id="comments"><h2>{words(1, 2)}</h2>{comments}</section>', f'<div class="comments-list"><ol>{comments}</ol></div>', f'<div class="reader-comments">{comments}</div>']))
    if r.random() < 0.25:
        after.append(box("related", f"<h3>{words(1, 3)}</h3><ul>{links(5)}</ul>"))
    if r.random() < 0.85:
        after.append(r.choice([f"<footer>&copy; {words(2, 4)} &middot; {words(2, 15)}</footer>", box("footer", f"<p>{words(3, 20)}</p>{links(3, '')}")]))
    r.shuffle(after)
    if r.random() < 0.4:
        main = f'<div class="{r.choice(["container", "wrap", "row", "page", "layout"])}">' + (after.pop(0) if after and r.random() < 0.5 else "") + main + "</div>"
    if r.random() < 0.3 and after and main.endswith("</article>"):  # comments and the like inside the article
        main = main.removesuffix("</article>") + after.pop() + "</article>"
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{main}{''.join(after)}</body></html>"


@functools.lru_cache(maxsize=1)
def model(n_pages: int = 700, seed: int = 3) -> Boosted:
    """Trees fitted on pages from ``_page``; an element is content if most of its own text
    is main text or, without own text, if it holds main text at all."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(n_pages):
        nodes = nodes_of(parse(_page(r)))
        marked = [sum(p.count("\x01") for p in n.parts if isinstance(p, str)) for n in nodes]
        under = list(marked)
        for node in reversed(nodes):
            if node.parent is not None:
                under[node.parent.index] += under[node.index]
        rows = features(nodes)
        for node in nodes[1:]:
            if node.text:
                x.append(rows[node.index])
                y.append(1.0 if under[node.index] and (marked[node.index] or not node.own or node.tag == "body") else 0.0)
    return boost(np.array(x), np.array(y), n_trees=50, depth=4, rate=0.3)


def main_text(pages: list[str | None], fitted: Boosted) -> list[str]:
    """Main texts of pages; they are scored together."""
    trees = [nodes_of(parse(p)) if p else [] for p in pages]
    rows = [features(nodes) for nodes in trees if nodes]
    logits = fitted.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes in trees:
        if not nodes:
            out.append("")
            continue
        logit = logits[at : at + len(nodes)]
        at += len(nodes)
        out.append("\n".join(blocks(nodes, decode(nodes, logit))))
    return out


def extract(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """``id_columns``, ``text`` and ``n_chars`` long (code points) of every page of ``df`` (``html``).

    Null and empty pages, and pages without an article, have an empty text.  Rows are
    independent, so repeated rows have equal results.  Other columns are dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in id_columns) + ", text string, n_chars long"
    fitted = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = main_text(part.column(len(id_columns)).to_pylist(), fitted)
                arrays = [part.column(i) for i in range(len(id_columns))]
                arrays += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*id_columns, "text", "n_chars"])

    return df.select(*id_columns, "html").mapInArrow(run, schema)


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
