"""Main text of HTML pages by tag-path ratios.

A page is cut into text blocks, each with its path of block tags (and their classes) from the root. Text length and
punctuation are summed per path; their ratios to the number of blocks on the path are smoothed over
neighbouring blocks, fused (text ratio times punctuation ratio, less the share of link text), and
blocks above the page's own threshold are content. Blocks in the same containers as content come
along (a heading, a short paragraph), unless a container's own ratio is far below that of the best one.

Elements that HTML itself sets apart (navigation, footers, asides, forms, scripts, hidden ones) never
count. Class and id names are hints. A name made of words such as ``sidebar`` or ``comments`` and of words for parts of a layout (``comment-list``,
``ad``) takes its subtree out, unless that holds nearly all of the page's scored text and no article stands outside it. A
name that says something else besides (``share-price``, ``notice-of-meeting``) only weakens the score of its paths. An ``article`` or ``main`` element narrows the
page to itself if it holds at least half of the scored text.

Defined results: null html is empty; a page without such blocks has an empty text; character
references are decoded as browsers do; unclosed and stray tags are tolerated; null and repeated ids
and extra columns make no difference; no pages, no rows; a very long page is worked on whole, by one task.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.llm import ids

PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<", re.S)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
CLOSES_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}

# HTML's void elements, phrasing elements and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math semantics annotation mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr body html article section div main select".split())
# What is never main text: by tag, by landmark role, and by words of class and id.
SKIP_TAGS = frozenset("head nav footer aside form script style noscript template svg button select textarea iframe menu dialog object title xmp noembed noframes".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
HINT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices popup modal overlay comment comments disqus replies reply share sharing social related newsletter subscribe widget "
    "toolbar login signup masthead topbar skip pagination".split()
)
# Words for parts of a layout: beside hint words they leave the name what it was.
LAYOUT_WORDS = frozenset(
    "list lists item items entry entries box bar wrapper wrap container block section area zone region slot unit panel group thread row col column grid card cards link links inner outer left right top bottom "
    "head header body title content text count counter button buttons icon icons form site page primary secondary main global sticky fixed mobile desktop layout view".split()
)
# Parts of a compound that turn the hint around: no-sidebar, has-comments, ad-free.
DENIES = frozenset("no not non without with has hide hides free less allow allows enabled disabled open closed".split())
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
HINT_HOLDS = 0.8
WEAKENED = 0.5
CONTAINER_SHARE = 0.25


@dataclass
class Node:
    tag: str
    parent: Node | None
    path: tuple
    skip: bool
    hint: Node | None  # the outermost element above or here whose class or id says that it is no main text
    weak: bool  # a name above or here might say so
    inline: bool
    link: bool
    article: bool


@dataclass
class Block:
    node: Node
    text: list = field(default_factory=list)
    linked: int = 0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _skips(tag: str, at: dict[str, str], in_article: bool) -> bool:
    if tag in SKIP_TAGS or (tag == "header" and not in_article):
        return True
    return at.get("role", "").lower() in SKIP_ROLES or "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "")


def _hints(tag: str, at: dict[str, str]) -> tuple[bool, bool]:
    """(a class or id is made of words for what is not main text, one holds such a word among others); compounds that deny it do not count."""
    sure = weak = False
    if tag in ("html", "body", "main"):
        return sure, weak
    for name in f"{at.get('class', '')} {at.get('id', '')}".split():
        parts = [p.lower() for p in PARTS.findall(name)]
        if not HINT_WORDS.isdisjoint(parts) and DENIES.isdisjoint(parts):
            other = any(p not in HINT_WORDS and p not in LAYOUT_WORDS for p in parts)
            sure, weak = sure or not other, weak or other
    return sure, weak


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. A block ends where any block tag or line break stands."""
    root = Node("", None, (), False, None, False, False, False, False)
    top, out, current, at = root, [], None, 0
    n = len(page)
    while at < n:
        m = PIECES.match(page, at)
        piece, at = m[0], m.end()
        if m[2] is None:
            loose = LOOSE_TAG.match(page, at - 1) if piece == "<" else None
            if loose is None:
                if piece[0] != "<" or piece == "<":
                    if not top.skip:
                        if current is None:
                            holder = top
                            while holder.inline:
                                holder = holder.parent
                            current = Block(holder)
                            out.append(current)
                        current.text.append(piece)
                        if top.link:
                            current.linked += len(piece.strip())
                continue
            m, at = loose, loose.end()
        tag = m[2].lower()
        inline = tag in INLINE
        if not inline and tag != "wbr":
            current = None
        if m[1]:
            found = top
            while found.parent is not None and found.tag != tag and not (inline and not found.inline):
                found = found.parent
            if found.tag == tag and found.parent is not None:
                top = found.parent
            continue
        if tag in VOID:
            continue
        if not inline:
            top = _implied_ends(top, tag)
        attributes = _attributes(m[3])
        article = top.article or tag in ("article", "main") or attributes.get("role") == "main"
        path = top.path if inline else (*top.path, f"{tag} {attributes['class']}" if attributes.get("class") else tag)
        node = Node(tag, top, path, top.skip or _skips(tag, attributes, top.article), top.hint, top.weak, inline, top.link or tag == "a", article)
        if attributes:
            sure, weak = _hints(tag, attributes)
            node.weak |= weak
            if sure and node.hint is None:
                node.hint = node
        if tag in CLOSES_RAW:
            end = CLOSES_RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if not m[3].rstrip().endswith("/") or tag not in ("svg", "path"):
            top = node
    return out


def _implied_ends(top: Node, tag: str) -> Node:
    """Close an open paragraph (with what is inside it), or the previous item of a list or table."""
    ends = SAME_CLOSES.get(tag, ())
    at = top
    while at.parent is not None:
        if at.tag == "p" or at.tag in ends:
            top = at.parent
            if at.tag != "p":
                break
        elif not at.inline and at.tag in SCOPES:
            break
        at = at.parent
    return top


@dataclass
class Sums:
    length: float = 0
    marks: float = 0
    linked: float = 0
    count: int = 0

    def add(self, b: Block, text: str) -> None:
        self.length += len(text)
        self.marks += len(PUNCTUATION.findall(text))
        self.linked += min(b.linked, len(text))
        self.count += 1

    @property
    def ratio(self) -> float:
        return self.length / self.count * (1 + self.marks / self.count) * (1 - self.linked / self.length)


def _ratios(found: list[tuple[Block, str]], key) -> list[float]:
    """The ratio of each block's group."""
    sums: dict = defaultdict(Sums)
    for b, t in found:
        sums[key(b.node)].add(b, t)
    return [sums[key(b.node)].ratio for b, _ in found]


def _without_hinted(found: list[tuple[Block, str]]) -> list[tuple[Block, str]]:
    """Blocks outside subtrees that their names set apart. A name over nearly all scored text says nothing, unless
    an article stands outside it."""
    if any(b.node.article and b.node.hint is None for b, _ in found):
        return [(b, t) for b, t in found if b.node.hint is None]
    score = [r * len(t) for r, (_, t) in zip(_ratios(found, lambda node: node.path), found, strict=True)]
    held: dict[int, float] = defaultdict(float)
    for (b, _), s in zip(found, score, strict=True):
        if b.node.hint is not None:
            held[id(b.node.hint)] += s
    whole = sum(score)
    return [(b, t) for b, t in found if b.node.hint is None or held[id(b.node.hint)] > HINT_HOLDS * whole]


def main_text(page: str) -> str:
    found = []
    for b in blocks(page):
        text = " ".join(html.unescape("".join(b.text)).split())
        if text:
            found.append((b, text))
    found = _without_hinted(found)
    if not found:
        return ""
    ratio = np.array(_ratios(found, lambda node: node.path))
    padded = np.pad(ratio, 2, mode="edge")
    smooth = np.convolve(padded, np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16, mode="valid")
    fused = np.sqrt(np.maximum(ratio * smooth, 0)) * np.array([WEAKENED if b.node.weak else 1.0 for b, _ in found])
    size = np.array([len(t) for _, t in found])
    named = np.array([b.node.article for b, _ in found])
    if (fused * size * named).sum() >= 0.5 * (fused * size).sum() and named.any():
        found, fused = [x for x, ok in zip(found, named, strict=True) if ok], fused[named]
    least = min(fused.std(), 0.5 * fused.max())
    inside: dict[int, Sums] = defaultdict(Sums)
    for (b, t), v in zip(found, fused, strict=True):
        if v >= least and v > 0:
            inside[id(b.node.parent or b.node)].add(b, t)
    best = max((s.ratio for s in inside.values()), default=0)
    holders = {k for k, s in inside.items() if named.any() or s.ratio >= CONTAINER_SHARE * best}
    kept = []
    for b, t in found:
        at = b.node
        while at is not None and id(at) not in holders:
            at = at.parent
        if at is not None:
            kept.append(t)
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``."""
    schema = T.StructType([ids.text_field("page_id"), pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            text = [main_text(h) for h in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"].array, "url": f["url"].array, "text": text, "n_chars": [len(t) for t in text]})

    texts = pages.select(ids.as_text("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return ids.restored(texts.mapInPandas(run, schema), pages.schema["page_id"])
