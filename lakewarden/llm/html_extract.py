"""HTML extraction by tag-path ratios.

The text nodes of a page are grouped by their root-to-leaf tag path. A path's text ratio is its text length by its number of
nodes, its punctuation ratio the same with marks that end words; both, times what is not link text, are smoothed over the
path sequence and fused by a product. The same lengths, summed along the paths, give a path's support: the share of the page's text
in the branch that the path belongs to, times the share of the page title's word pairs found there. Names are a weak feature: a path in an
element that names itself boilerplate, or outside the page's article, has half its ratio, and passes if that is still above the threshold.
Paths above the threshold are content; it spreads to the innermost element that holds nearly all of it, and there takes in
headings and short texts that are neither links nor named boilerplate.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from lakewarden.llm.common import map_column

THRESHOLD = 0.5  #: of the mean fused ratio, each weighed by itself and its text
SHARE = 0.95  #: of the selected text that the content element holds
PENALTY = 0.5  #: factor of the ratios of paths in elements that name themselves boilerplate, or outside article and main on pages with text in one
UNTITLED = 0.1  #: factor of the support of a branch that holds no word pair of the page's title
#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
SKIP = RAW | frozenset("head form button select option svg canvas object audio video dialog label fieldset input annotation annotation-xml map".split())
ASIDE = frozenset("nav footer aside menu header".split())  #: boilerplate by name; a header is none inside an article
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label math mrow mi mo mn ms mtext mspace mstyle mpadded msup msub msubsup mfrac msqrt mroot munder mover munderover mmultiscripts semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt|dd", ("dl",)), "dd": ("dt|dd", ("dl",)), "tr": ("tr|td|th", ("table",)), "td": ("td|th", ("tr", "table")), "th": ("td|th", ("tr", "table")), "option": ("option", ("select",)), "thead": ("thead|tbody|tfoot", ("table",)), "tbody": ("thead|tbody|tfoot|tr|td|th", ("table",)), "tfoot": ("thead|tbody|tfoot|tr|td|th", ("table",))}
MOST = 0.9  #: of a page's text; an element that holds it, or half of it with an article, main or h1, is no boilerplate by its marks
#: Class names, ids and roles that mark boilerplate, as whole tokens.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner promo promoted promotion sponsor sponsored cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay sidebar side aside rail widget widgets menu menubar nav navbar navigation navigationbar breadcrumb breadcrumbs topbar toolbar masthead header footer foot copyright legal comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox pagination pager tags tagcloud skip complementary contentinfo".split())
CONTAINERS = frozenset(("article", "main"))
PUNCTUATION = re.compile(r"[,.;:!?](?=[\s\"')\]]|\Z)|[。，、；：！？…]")  #: not the dots of hosts and numbers
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]+))?")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\w+")


class Element:
    """path is the number of its tag path on the page; good says that neither it nor an element around it is named boilerplate."""

    __slots__ = ("name", "path", "depth", "parent", "skip", "marked", "good", "link", "container", "held", "head")

    def __init__(self, name: str, attributes: str, parent: Element | None, paths: dict[tuple[int, str], int]):
        self.name, self.parent = name, parent
        words: set[str] = set()
        tokens: set[str] = set()
        hidden = False
        if attributes:
            for k, v in ATTRIBUTE.findall(attributes):
                k, v = k.lower(), v.strip("\"'").lower()
                if k in ("hidden", "aria-hidden"):
                    hidden |= v in ("", "true", "hidden")
                elif k in ("class", "id", "role"):
                    words.update(re.split(r"[^a-z0-9]+", v))
                    tokens.update(v.split())
        mark = ".".join(sorted(words - {""}))
        self.path = paths.setdefault((parent.path if parent else -1, f"{name}.{mark}"), len(paths))
        self.depth = parent.depth + 1 if parent else 0
        self.skip = name in SKIP or hidden or bool(parent and parent.skip)
        self.container = name in CONTAINERS or bool(parent and parent.container)
        self.marked = (bool(tokens & BOILERPLATE) or name in ASIDE and not (name == "header" and parent and parent.container)) and name not in ("html", "body")
        self.link = name == "a" or bool(parent and parent.link)
        self.good, self.held, self.head = True, 0, False


class Node:
    """A piece of text between two marks of markup; block counts the block boundaries before it."""

    __slots__ = ("text", "element", "block")

    def __init__(self, text: str, element: Element, block: int):
        self.text, self.element, self.block = text, element, block


def text_nodes(html: str) -> tuple[list[Node], list[Element], int, str]:
    """The page's text outside scripts, styles and comments, in page order; its elements, outer ones first; the number of its tag paths; its title.
    Unclosed and crossed tags are mended as browsers do. Linear in the page: a path is a number, whatever its depth."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", "", None, paths)
    stack, nodes, elements, block, at, title = [root], [], [root], 0, 0, ""
    opened: Counter = Counter()

    def cut(i: int) -> None:
        opened.subtract(e.name for e in stack[i:])
        del stack[i:]

    def close(names: tuple[str, ...] | frozenset[str], stop: tuple[str, ...] = (), ends: bool = True) -> None:
        if not any(opened[n] > 0 for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                cut(i)
                return
            if ends and (stack[i].name in stop or stack[i].name in CONTAINERS):
                return

    def text(raw: str) -> None:
        if raw:
            nodes.append(Node(entities.unescape(raw), stack[-1], block))

    while m := TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name == "html":
            continue
        if name not in INLINE:
            block += 1
        if m[1]:
            close((name,), ends=False)
        else:
            if name in CLOSES_P and stack[-1].name not in ("html", "body"):
                close(("p",), ("td", "th", "li", "div", "section", "blockquote"))
            if name in SIBLINGS:
                own, stop = SIBLINGS[name]
                close(tuple(own.split("|")), stop)
            if name == "body":
                close(("head",))
            element = Element(name, m[3] or "", stack[-1], paths)
            elements.append(element)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if name == "title":
                    title = title or entities.unescape(html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
            elif name not in VOID and not (m[3] or "").endswith("/"):
                stack.append(element)
                opened[name] += 1
    text(html[at:])
    return nodes, elements, len(paths), title


def pairs(text: str) -> set[tuple[str, ...]]:
    """The pairs of successive words of a text in lower case; its word, if it has but one."""
    words = WORD.findall(text.lower())
    return set(zip(words, words[1:])) or {(w,) for w in words}


def support(nodes: list[Node], length: np.ndarray, title: str) -> np.ndarray:
    """The share of the text in each path's branch, its outermost part that does not hold nearly all of the page, and how much of the title is there.
    length is that of each path's own text. Branches are told by path, so they overlap in no node."""
    above = np.full(len(length), -1)
    for n in nodes:
        e = n.element
        while e.parent and above[e.path] < 0:
            above[e.path] = e.parent.path
            e = e.parent
    held = length.copy()
    for p in range(len(held) - 1, 0, -1):  # a path's number is above that of the path it goes on
        if above[p] >= 0:
            held[above[p]] += held[p]
    top = np.arange(len(held))
    for p in range(1, len(held)):
        if above[p] >= 0 and held[above[p]] <= SHARE * held[0]:
            top[p] = top[above[p]]
    out = held[top] / max(held[0], 1)
    want = pairs(title)
    if want:
        found: dict[int, set[str]] = {}
        for n in nodes:
            if not n.element.link:
                found.setdefault(int(top[n.element.path]), set()).update(want & pairs(n.text))
        out *= UNTITLED + (1 - UNTITLED) * np.array([len(found.get(t, ())) / len(want) for t in top.tolist()])
    return out


def path_ratios(nodes: list[Node], paths: int, title: str = "") -> np.ndarray:
    """The fused, smoothed ratio of each tag path, in the order in which they begin; 0 for those without text."""
    count, length, marks, links, within, named = (np.zeros(paths) for _ in range(6))
    for n in nodes:
        size = len(n.text.strip())
        if size:
            e = n.element
            count[e.path] += 1
            length[e.path] += size
            marks[e.path] += len(PUNCTUATION.findall(n.text))
            links[e.path] += size * e.link
            within[e.path] += size * (e.container and e.good)
            named[e.path] += size * (not e.good)
    out = np.zeros(paths)
    used = np.flatnonzero(count)
    if len(used):
        branch = support(nodes, length - links, title)[used]
        count, length, marks, links, within, named = (x[used] for x in (count, length, marks, links, within, named))
        free = 1 - links / length
        smooth = np.array([0.1, 0.8, 0.1])
        text_ratio, mark_ratio = (np.convolve(np.pad(x, 1, mode="edge"), smooth, "valid") for x in (length / count * free, (marks + 0.1) / count * free))
        weak = length - within if within.any() else named
        out[used] = np.sqrt(text_ratio * mark_ratio) * branch * (1 - (1 - PENALTY) * weak / length)
    return out


def hold(nodes: list[Node], elements: list[Element], sizes: list[int]) -> int:
    """Sum the nodes' sizes up into all elements around them; the total."""
    for e in elements:
        e.held = 0
    for n, k in zip(nodes, sizes):
        n.element.held += k
    for e in reversed(elements):
        if e.parent:
            e.parent.held += e.held
    return elements[0].held


def judge(nodes: list[Node], elements: list[Element]) -> None:
    """Set good: marks count, but for those of an element that holds most of the page's text outside links, or half of it with an article, main or h1."""
    total = hold(nodes, elements, [0 if n.element.link or n.element.skip else len(n.text.strip()) for n in nodes])
    for n in nodes:
        n.element.head |= n.element.name == "h1" and bool(n.text.strip())
    for e in reversed(elements):
        e.head |= e.name in CONTAINERS and e.held > 0
        if e.parent:
            e.parent.head |= e.head
    for e in elements:
        named = e.marked and e.held <= (0.5 if e.head else MOST) * total
        e.good = not named and (e.parent is None or e.parent.good)


def extract(html: str | None) -> str:
    """The main text of a page."""
    nodes, elements, paths, title = text_nodes(html or "")
    nodes = [n for n in nodes if n.text and not n.element.skip]
    judge(nodes, elements)
    ratios = path_ratios(nodes, paths, title)
    if not ratios.any():
        return ""
    sizes = [len(n.text.strip()) for n in nodes]
    weight = np.zeros(paths)
    np.add.at(weight, [n.element.path for n in nodes], sizes)
    chosen = ratios >= THRESHOLD * np.average(ratios, weights=weight * ratios)
    total = hold(nodes, elements, [k if chosen[n.element.path] else 0 for n, k in zip(nodes, sizes)])
    content = max((e for e in elements if e.held >= SHARE * total), key=lambda e: e.depth)
    around = content
    while around is not None and around.name not in CONTAINERS:
        around = around.parent
    content = around or content
    while around is None and content.parent and content.name in INLINE | {"p"}:
        content = content.parent
    inside = {id(content)}
    for e in elements:
        if e.parent and id(e.parent) in inside:
            inside.add(id(e))
    held_in = [n for n in nodes if id(n.element) in inside and (n.element.good or chosen[n.element.path])]
    running = {n.block for n in held_in if not n.element.link and any(c.isalnum() for c in n.text)}  # blocks whose links are part of their text
    blocks: dict[int, list[str]] = {}
    for n in held_in:
        if n.block in running or chosen[n.element.path] or n.element.name in ("h1", "h2", "h3", "h4", "h5", "h6") or not n.element.link:
            blocks.setdefault(n.block, []).append(n.text)
    parts = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return " ".join(p for p in parts if p)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text. Null, empty and markup-free-of-text pages give an empty text; plain text
    without markup is its own content; repeated rows are handled alike; other columns are ignored; an empty table gives an empty one.
    A page is read whole by one task, in time and memory linear in its length."""

    def start() -> Callable[[list], dict]:
        return lambda htmls: {"text": [extract(h) for h in htmls]}

    return map_column(pages, ["page_id", "url"], "html", start, "text string")
