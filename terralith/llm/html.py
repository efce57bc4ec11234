"""HTML extraction: boosted trees over DOM-node features, decoded down the tree.

A page is read into a tree of elements and text blocks (a block is the text between two block-level tags; inline tags and
br are inside it). Every node gets features: subtree density of text, links and tags, tag and attribute-token statistics,
those of its ancestors, depth, and its place and its neighbours among its siblings. The trees give the probability that
a node holds main text. Decoding maximises the likelihood of all labels under the rule that a node that is dropped drops
all below it, so no ancestor and descendant contradict each other.

The model is fitted here on `PAGES` generated pages of many layouts, whose nodes are labelled as they are written. Tests hold
it against layouts written by hand apart from that generator.

Text of script, style, template, noscript, head and the like is never a block. Character references are decoded, white
space in a block becomes one space, blocks are joined by a line feed. null html is an empty page. Repeated rows stay rows.
Reading is linear in a page's length, so one of many MB takes seconds a MB and some 100 bytes a byte. A node as likely main
text as not is dropped.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import gbt

PAGES = 1200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without readable text.
HIDDEN = RAW | frozenset("head template noscript svg math canvas object audio video select datalist button".split())
#: Hidden elements that stand inside a line without ending it.
_VEILED = HIDDEN - RAW - {"head"}
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr button".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: Elements that end tags and implied ends inside them don't reach over.
_BOUNDS = frozenset("table caption td th template object button".split())
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: A start tag ends the open elements of these names, but for those around the nearest of the second.
_SAME = {"li": (["li"], ["ul", "ol", "menu", "table", "td", "th"]), "dt": (["dt", "dd"], ["dl", "table", "td", "th"]), "dd": (["dt", "dd"], ["dl", "table", "td", "th"]), "tr": (["tr", "td", "th"], ["table"]), "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"]), "option": (["option"], ["select"])}
_MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_LABEL = re.compile(r"\bdata-main=(\d)")
FEATURES = ["tag", "attr_least", "attr_most", "above", "best_above", "parent_tag", "depth", "place", "siblings", "chars", "links", "tags", "block", "stops", "paragraphs", "start", "share", "before", "after", "parent_links", "controls"]


_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\s/>])[^>]*>?", re.I)


def _script_end(html: str, at: int) -> int:
    """Where a script's content ends: behind its end tag, but not behind one that answers a start tag within a comment."""
    escaped = inner = False
    for m in _SCRIPT.finditer(html, at):
        if m[0] == "<!--":
            escaped = True
        elif m[0] == "-->":
            escaped = inner = False
        elif not m[1]:
            inner = escaped
        elif inner:
            inner = False
        else:
            return m.end()
    return len(html)


class Page:
    """Nodes in page order: tag ("#" for a block), parent, attribute tokens, text (blocks), label (training pages).

    One pass, whose cost is linear in the page: open elements are counted by name, so no tag looks through the others.
    Start tags that can't be in head end it, as in HTML; inline elements never hold blocks open. A hidden element without
    an end tag in the rest of the page hides nothing, but script, style and textarea run to the end of the page. Hidden
    elements inside a line, such as buttons, don't end it.
    """

    def __init__(self, html: str):
        self.tag, self.parent, self.tokens, self.text, self.label, self.linked = ["html"], [-1], [()], [""], [1], [0]
        self._html, self._ends = html, {}
        self._stack: list[tuple[str, int, int]] = [("html", 0, 0)]  # open block-level and hidden elements: name, node, open links
        self._open: dict[str, list[int]] = {}  # places in the stack by name
        self._bounds: list[int] = [0]  # places of elements that no end tag inside them reaches over
        self._veiled: list[int] = []  # places in the stack of hidden elements inside a line
        self._hidden = self._links = self._linked = 0
        self._piece: list[str] = []
        self._read()
        del self._html, self._stack, self._open, self._piece

    def _node(self, tag: str, tokens=(), text: str = "", label: int | None = None, linked: int = 0) -> int:
        parent = self._stack[-1][1]
        for col, v in ((self.tag, tag), (self.parent, parent), (self.tokens, tokens), (self.text, text), (self.label, self.label[parent] if label is None else label), (self.linked, linked)):
            col.append(v)
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._veiled:
            return
        if self._piece:
            text = "".join(self._piece)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self._node("#", text=text, linked=min(self._linked, len(text)))
            self._piece.clear()
        self._linked = 0

    def _take(self, text: str) -> None:
        if not text:
            return
        if "head" in self._open and self._stack[-1][0] == "head" and not text.isspace():
            self._pop_to(self._open["head"][-1])
        if not self._hidden:
            self._piece.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _push(self, name: str, node: int) -> None:
        at = len(self._stack)
        self._open.setdefault(name, []).append(at)
        if name in _BOUNDS:
            self._bounds.append(at)
        if name in _VEILED:
            self._veiled.append(at)
        self._hidden += name in HIDDEN
        self._stack.append((name, node, self._links))

    def _pop_to(self, k: int) -> None:
        if self._veiled:  # the line goes on behind what it hides
            self._drop_to(max(k, self._veiled[0]))
            if len(self._stack) <= k:
                return
        self._flush()
        self._drop_to(k)

    def _drop_to(self, k: int) -> None:
        while len(self._stack) > k:
            name, _, self._links = self._stack.pop()
            places = self._open[name]
            places.pop()
            if not places:
                del self._open[name]
            if name in _BOUNDS:
                self._bounds.pop()
            if name in _VEILED:
                self._veiled.pop()
            self._hidden -= name in HIDDEN

    def _last(self, name: str) -> int:
        places = self._open.get(name)
        return places[-1] if places else -1

    def _has_end(self, name: str, at: int) -> bool:
        """Whether an end tag of that name is somewhere after at."""
        if name not in self._ends:
            found = [m.start() for m in re.finditer(rf"</{name}(?![a-z0-9-])", self._html, re.I)]
            self._ends[name] = found[-1] if found else -1
        return self._ends[name] >= at

    def _close_for(self, name: str) -> None:
        """Ends what a start tag ends."""
        if "head" in self._open and name not in _IN_HEAD:
            self._pop_to(self._open["head"][-1])
        if name in _CLOSES_P:
            p = self._last("p")
            if p > self._bounds[-1]:
                self._pop_to(p)
            if name in _HEADINGS and self._stack[-1][0] in _HEADINGS:
                self._pop_to(len(self._stack) - 1)
        if name in _SAME:
            closes, within = _SAME[name]
            stop = max(self._last(w) for w in within)
            first = min((k for k in map(self._last, closes) if k > stop), default=-1)
            if first > 0:
                self._pop_to(first)

    def _end(self, name: str) -> None:
        if name == "a":
            self._links = max(self._links - 1, 0)
        elif (k := self._last(name)) > 0 and (k >= self._bounds[-1] or name in _TABLE):
            self._pop_to(k)

    def _read(self) -> None:
        html, at, size = self._html, 0, len(self._html)
        while at < size:
            m = _MARKUP.search(html, at)
            if not m:
                self._take(html[at:])
                break
            self._take(html[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            if name == "html":
                continue
            self._close_for(name)
            if name == "body":
                continue
            if name == "br":
                self._take(" ")
            if name in ("input", "button", "select", "textarea") and not self._hidden:
                self._node("control")
            if name in VOID:
                if name not in INLINE:
                    self._flush()
            elif name == "a":
                self._links = 1  # a link within a link ends the outer one
            elif name in HIDDEN:
                if name == "script":
                    at = _script_end(html, at)
                elif name in ("style", "textarea"):
                    end = re.compile(rf"</{name}(?![a-z0-9-])[^>]*>?", re.I).search(html, at) if self._has_end(name, at) else None
                    at = end.end() if end else size
                elif name in RAW:
                    if self._has_end(name, at):
                        at = re.compile(rf"</{name}(?![a-z0-9-])[^>]*>?", re.I).search(html, at).end()
                    elif name == "title":  # its text is up to the next tag then
                        at = html.find("<", at) if html.find("<", at) >= 0 else size
                elif name == "head" or self._has_end(name, at):
                    if name == "head":
                        self._flush()
                    self._push(name, self._stack[-1][1])
            elif name not in INLINE:
                self._flush()
                attrs = m[3]
                found = [t.lower() for a in _NAMES.findall(attrs) for t in _TOKEN.findall("".join(a))] if "=" in attrs else ()
                label = _LABEL.search(attrs) if "data-main" in attrs else None
                self._push(name, self._node(name, tuple(found), label=int(label[1]) if label else None))
        self._flush()

    def features(self, tags: dict[str, float], tokens: dict[str, float]) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        chars = np.array([len(t) for t in self.text], dtype=float)
        links = np.array(self.linked, dtype=float)
        count = np.ones(n)
        blocks = (chars > 0).astype(float)
        stops = np.array([sum(map(t.count, ".!?,")) for t in self.text], dtype=float)
        words = np.array([t.count(" ") + 1 if t else 0 for t in self.text], dtype=float)
        paragraphs = np.array([t in ("p", "li") for t in self.tag], dtype=float)
        controls = np.array([t == "control" for t in self.tag], dtype=float)
        start = np.concatenate([[0], np.cumsum(chars)[:-1]])
        sums = np.column_stack([chars, links, count, blocks, stops, words, paragraphs, controls])
        for k in range(n - 1, 0, -1):
            sums[parent[k]] += sums[k]
        chars, links, count, blocks, stops, words, paragraphs, controls = sums.T
        out = np.zeros((n, len(FEATURES)))
        depth, above, best, place = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(n)
        children: list[int] = [0] * n
        last = [-1] * n
        before, after = np.zeros(n), np.zeros(n)
        own = np.array([tags.get(t, 0.5) for t in self.tag])
        least, most = own * 0 + 0.5, own * 0 + 0.5
        for k in range(n):
            if self.tokens[k]:
                got = [tokens.get(t, 0.5) for t in self.tokens[k]]
                least[k], most[k] = min(got), max(got)
            p = self.parent[k]
            if p >= 0:
                depth[k] = depth[p] + 1
                above[k] = min(above[p], own[p], least[p])
                best[k] = max(best[p], own[p], most[p]) if p else 0.5
                place[k] = children[p]
                children[p] += 1
                if last[p] >= 0:
                    before[k], after[last[p]] = chars[last[p]], chars[k]
                last[p] = k
        total = max(chars[0], 1)
        link_share = links / np.maximum(chars, 1)
        siblings = np.array([children[p] if p >= 0 else 1 for p in self.parent])
        cols = [own, least, most, above, best, own[np.maximum(parent, 0)], depth, place, siblings, np.log1p(chars), link_share, count / np.maximum(chars, 1), chars / np.maximum(blocks, 1), stops / np.maximum(words, 1), np.log1p(paragraphs), start / total, chars / total, np.log1p(before), np.log1p(after), link_share[np.maximum(parent, 0)], np.minimum(controls, 5)]
        for k, c in enumerate(cols):
            out[:, k] = c
        return out

    def decode(self, odds: np.ndarray) -> str:
        """The kept blocks under the best labels: a dropped node drops all below it."""
        n = len(self.tag)
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        keep[0] = 0.0
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            keep[p] += max(keep[k], drop[k])
            drop[p] += drop[k]
        kept = np.zeros(n, dtype=bool)
        kept[0] = True
        out = []
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and keep[k] > drop[k]
            if kept[k] and self.text[k]:
                out.append(self.text[k])
        return "\n".join(out)


_SYLLABLES = "an ar be co da de el en er es fa ge ha il in ka la le li lo ma mi mo na ne no on or pa po ra re ri ro sa se so ta te ti to tu un va ve zo ñé ü ß ça".split()
_DROP = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu toc links",
    "header": "header masthead topbar banner logo siteheader branding",
    "footer": "footer foot copyright legal bottom sitefooter colophon",
    "aside": "sidebar side aside widget rail column related recommended trending popular latest promo box teaser",
    "ad": "ad ads advert advertisement sponsor sponsored banner promo dfp adsense outbrain taboola",
    "notice": "cookie consent notice alert gdpr banner popup modal overlay message warning paywall",
    "form": "form newsletter subscribe signup login search searchbox contact register",
    "comments": "comments comment reply replies discussion respond disqus thread commentlist responses",
    "social": "share sharing social follow buttons tags toolbar tools pagination pager print",
}
_HEADS = "title headline entry-header post-header article-header heading lead intro hero".split()
_MAIN = "article content post entry main story body text articlebody postcontent entrycontent prose maincontent single page".split()


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, rng.randint(5, 14)):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += rng.choice([".", ".", ",", "?"])
    return " ".join(out) + "."


def _attr(rng: random.Random, names: list[str]) -> str:
    if not names or rng.random() < 0.25:
        return ""
    name = rng.choice(names) if rng.random() < 0.92 else "".join(rng.choices(_SYLLABLES[:30], k=3))  # an unheard name now and then
    if rng.random() < 0.3:
        name += rng.choice(["-", "_", " "]) + rng.choice(["wrap", "box", "inner", "1", "block", "area", "list", "item", rng.choice(names)])
    return f' {rng.choice(["class", "class", "id"])}="{name}"'


def _junk(rng: random.Random, kind: str) -> str:
    names = _DROP[kind].split()
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, rng.choice(["div", "section", "div", "ins" if kind == "ad" else "div"]))
    plain = rng.random() < 0.45
    if plain and tag != "form":
        tag = "div"
    attr = _attr(rng, names) or (f' class="{rng.choice(names)}"' if tag in ("div", "section", "ins") else "")
    link = lambda n: f'<a href="/{rng.randint(1, 99)}">{_words(rng, n).rstrip(".,?")}</a>'
    if kind in ("nav", "social") or kind == "aside" and rng.random() < 0.6:
        items = "".join(f"<li>{link(rng.randint(1, 6))}{rng.choice(['', '</li>'])}" for _ in range(rng.randint(2, 9)))
        body = f"{rng.choice(['', '<h3>' + _words(rng, 2) + '</h3>'])}<ul>{items}</ul>" if rng.random() < 0.8 else " | ".join(link(2) for _ in range(rng.randint(2, 8)))
    elif kind == "comments":
        named = rng.choice([' class="comment"', ' class="reply"', ' class="c"', ""])
        body = f"<{rng.choice(['h2', 'h3', 'h4'])}>{_words(rng, 2)}</h3>" + "".join(f'<div{named}><b>{_words(rng, 1)}</b><p>{_words(rng, rng.randint(4, 60))}</p></div>' for _ in range(rng.randint(1, 6)))
    elif kind == "form":
        body = f'<label>{_words(rng, 3)}</label><input type="text" name="q"><button>{_words(rng, 1)}</button>' + rng.choice(["", f"<p>{_words(rng, rng.randint(5, 20))}</p>"])
    elif kind == "footer":
        body = rng.choice(["&copy; ", "&copy; 2024 ", ""]) + _words(rng, rng.randint(3, 25)) + rng.choice(["", f"<p>{link(2)} &middot; {link(1)}</p>"])
    else:
        body = rng.choice([_words(rng, rng.randint(3, 30)), f"<p>{_words(rng, rng.randint(3, 40))}</p>", f"<p>{_words(rng, 8)}</p>{link(3)}", f"<h2>{_words(rng, 3)}</h2>"])
    return f'<{tag}{attr} data-main=0>{body}</{tag}>'


def _main(rng: random.Random) -> str:
    title = f"<h1>{_words(rng, rng.randint(2, 12)).rstrip('.')}</h1>"
    if rng.random() < 0.25:
        head = rng.choice(["header", "header", "div"])
        title = f"<{head}{_attr(rng, _HEADS)}>{title}{rng.choice(['', '<p>' + _words(rng, 9) + '</p>'])}</{head}>"
    parts = [title] if rng.random() < 0.85 else []
    lists = rng.random() < 0.2  # a page that is mostly lists
    for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 14])):
        text = escape(_words(rng, rng.choice([1, 2, 5, 12, 25, 40, 80, 120])), quote=False)
        if rng.random() < 0.12:
            text = text.replace(" ", " | ")
        if rng.random() < 0.15:
            text += f' <a href="/x">{_words(rng, 2)}</a>'
        kind = 0.85 if lists and rng.random() < 0.6 else rng.random()
        if kind < 0.72:
            parts.append(rng.choice([f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text[:9]}</em>{text[9:]}</p>"]))
        elif kind < 0.8:
            parts.append(f"<h2>{_words(rng, 4).rstrip('.')}</h2><p>{text}</p>")
        elif kind < 0.87:
            listed, close = rng.choice(["ul", "ul", "ol"]), rng.choice(["</li>", ""])
            parts.append(rng.choice(["", f"<h3>{_words(rng, 2)}</h3>"]) + f"<{listed}>" + "".join(f"<li>{_words(rng, rng.randint(2, 15))}{close}" for _ in range(rng.randint(2, 7))) + f"</{listed}>")
        elif kind < 0.92:
            parts.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.95:
            parts.append("<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.98:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(_junk(rng, rng.choice(["ad", "social", "form", "aside"])))
    if not parts:
        parts = [f"<p>{_words(rng, 20)}</p>"]
    if rng.random() < 0.15:
        parts.append(_junk(rng, rng.choice(["comments", "social", "aside"])))
    tag = rng.choice(["article", "article", "main", "div", "section", "td"])
    attr = _attr(rng, _MAIN) or (f' class="{rng.choice(_MAIN)}"' if tag in ("div", "section", "td") and rng.random() < 0.85 else "")
    body = f"<{tag}{attr} data-main=1>{''.join(parts)}</{tag}>"
    return f"<table><tr>{body}</tr></table>" if tag == "td" else body


def training_page(rng: random.Random) -> str:
    """A page whose elements say in data-main what they are."""
    pick = lambda kinds, p: "".join(_junk(rng, k) for k in kinds if rng.random() < p)
    top = pick(["notice", "header", "nav", "ad", "form"], 0.45)
    side = pick(["aside", "ad", "form", "social"], 0.35)
    end = pick(["social", "comments", "aside", "notice"], 0.35) + pick(["footer"], 0.85)
    main = _main(rng)
    any_name = [n for names in _DROP.values() for n in names.split()]
    outer = lambda: _attr(rng, ["wrap", "container", "row", "page", "layout", "site", "grid", rng.choice(any_name)])  # noqa: E731  wrappers are named after anything
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        main = f"<div{outer()}>{main}</div>"
    inner = rng.choice([side + main, main + side])
    body = rng.choice([top + inner + end, f"{top}<div{outer()}>{inner}</div>{end}", f"<div{outer()}>{top}{inner}{end}</div>", f"<div{outer()}>{top}<div{outer()}>{inner}</div>{end}</div>"])
    return f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style></head><body>{body}</body></html>"


@lru_cache(maxsize=1)
def train(pages: int = PAGES, seed: int = 7) -> tuple[gbt.Forest, dict[str, float], dict[str, float]]:
    """(trees, tag statistics, attribute-token statistics); deterministic."""
    rng = random.Random(seed)
    read = [Page(training_page(rng)) for _ in range(pages)]

    def shares(groups: Iterator[tuple]) -> dict[str, float]:
        good, n = Counter(), Counter()
        for names, y in groups:
            n.update(names)
            good.update(names if y else ())
        return {k: (good[k] + 1) / (n[k] + 2) for k in n}

    tags = shares(((t,), y) for p in read for t, y in zip(p.tag, p.label, strict=True))
    tokens = shares((set(t), y) for p in read for t, y in zip(p.tokens, p.label, strict=True) if t)
    x = np.concatenate([p.features(tags, tokens)[1:] for p in read])
    y = np.concatenate([np.array(_holds(p)[1:], dtype=float) for p in read])
    return gbt.fit(FEATURES, x, y, trees=80, depth=4, rate=0.2, least=12), tags, tokens


def _holds(page: Page) -> list[int]:
    """1 for nodes with main text in or below them."""
    out = [int(bool(t) and y == 1) for t, y in zip(page.text, page.label, strict=True)]
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] |= out[k]
    return out


def extract_many(pages: list[str], model) -> list[str]:
    """The main text of each page."""
    forest, tags, tokens = model
    read = [Page(h) for h in pages]
    x = [p.features(tags, tokens) for p in read]
    odds = forest.raw(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p, f in zip(read, x, strict=True):
        out.append(p.decode(odds[at : at + len(f)]))
        at += len(f)
    return out


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = extract_many([h or "" for h in part.column(2).to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    model = pages.sparkSession.sparkContext.broadcast(train())
    rows = pages.select(F.col("`page_id`").cast("bigint").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").cast("string").alias("html"))
    return rows.mapInArrow(_extracted(model), "page_id bigint, url string, text string, n_chars bigint")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
