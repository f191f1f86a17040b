"""Main text of a web page by a tree-structured graphical model.

A page is parsed into a tree of block elements; each run of text and inline markup is a leaf. Every node has a
hidden label, content or not. A node's own potential is linear in its features (tag, words of class,
id and role, share of text in links, length, place); each parent-child pair has a potential by tag class. Sum-product
messages from the leaves to the root and back give every node's exact marginal. A leaf is content if its
marginal is over 1/2; the text of content leaves, block by block in page order, is the result.

Training maximises the likelihood of labelled pages by gradient steps on expected feature counts, which
the same messages give. Labelled pages are (html) with the attribute data-main="1" on elements whose inside is content and
data-main="0" on elements within that aren't; without any, the pages of labelled_pages() are used, which
vary tags, names, order and kinds of boilerplate."""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import mapped, slices

WIDTH = 4096
KINDS = 12

# Elements by kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style title template noscript textarea select option button svg iframe object embed noembed noframes canvas audio video datalist input xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math maction annotation annotation-xml merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
BOXES = {"ins"}  # inline elements that stand for a block of their own if they have names, as adverts do
HEAD = set("head html base basefont bgsound link meta title style script noscript noframes template".split())  # what doesn't end a head
CLOSES = {  # a start tag ends an open element of these names, unless one of the fences is met first
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
_KIND = {t: k for k, ts in enumerate(("", "p", "h1 h2 h3 h4 h5 h6", "li dd dt td th tr", "ul ol dl table tbody", "article main", "nav menu", "header footer", "aside", "form fieldset", "section div body html", "#text")) for t in ts.split()}

_PARTS = set("article main section aside nav header footer form ul ol table menu dialog".split())

# a quote opens a value only after an equals sign and if it is closed
_tag = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
_none = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_attr = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_names = re.compile(r"[a-z]+|[0-9]+")
_camel = re.compile(r"(?<=[a-z])(?=[A-Z])")
_space = re.compile(r"\s+")


class Page:
    """The nodes of one page in document order; node 0 is the root. A parent comes before its children."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.words, self.text, self.label = ["html"], [-1], [()], [""], [-1]
        self.depth, self.linked = [0], [0]
        self._parse(source or "")

    def _node(self, tag: str, parent: int, words: tuple = (), label: int = -1) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.text.append("")
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.linked.append(0)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open block elements
        inline: list[str] = []  # open inline elements: only links matter
        leaf, unseen, links, at = -1, 0, 0, 0

        def add(text: str) -> None:
            nonlocal leaf, unseen
            if hidden == ["head"] and not text.isspace() and text:  # text can't stand in a head
                hidden.clear()
                unseen = 0
            if unseen or not text:
                return
            if leaf < 0:
                if text.isspace():
                    return
                leaf = self._node("#text", stack[-1][1])
            self.text[leaf] += text
            if links:
                self.linked[leaf] += len(text)

        hidden: list[str] = []  # an open unseen element and the unseen and block elements within
        while True:
            m = _tag.search(source, at)
            add(entities.unescape(source[at : m.start() if m else len(source)]))
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name in UNSEEN or name in INLINE and name in hidden:
                    if name in hidden:
                        del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                        unseen = len(hidden)
                elif name == "a":
                    links = max(0, links - 1)
                elif name not in INLINE or name in BOXES and any(t == name for t, _ in stack):
                    if name in hidden:
                        del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                        unseen = len(hidden)
                        continue
                    if any(t == name for t, _ in stack[1:]):
                        while stack.pop()[0] != name:
                            pass
                        links = 0
                        hidden.clear()  # an unseen element ends with the block around it
                        unseen = 0
                    leaf = -1
                continue
            if hidden == ["head"] and name not in HEAD:
                hidden.clear()
                unseen = 0
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                stop = end.start() if end else len(source)
                at = source.find(">", stop) + 1 if end and source.find(">", stop) >= 0 else len(source)
                continue
            if name == "br" or name == "hr":
                add("\n")
                if name == "hr":
                    leaf = -1
                continue
            if name in UNSEEN:
                if name not in VOID and not m[3].rstrip().endswith("/"):
                    hidden.append(name)
                    unseen = len(hidden)
                continue
            if name in VOID:
                continue
            if hidden and hidden[-1] == "p" and name in ENDS_P:
                hidden.pop()
                unseen = len(hidden)
            if unseen and name != "body":
                if (name not in INLINE or name in hidden) and name != "html" and not m[3].rstrip().endswith("/"):
                    hidden.append(name)
                    unseen = len(hidden)
                continue
            if name == "body":
                hidden.clear()
                unseen = 0
            words, label, shown = self._attributes(m[3])
            if not shown and name not in ("html", "body"):
                if not m[3].rstrip().endswith("/"):
                    hidden.append(name)
                    unseen = len(hidden)
                    if name not in INLINE:
                        leaf = -1
                continue
            if name in INLINE and not (name in BOXES and (words or label >= 0)):
                links += name == "a"
                continue
            leaf = -1
            if name in ENDS_P:
                self._close(stack, {"p"}, {"table", "td", "button", "div", "article", "section", "li", "blockquote"})
            if name in CLOSES:
                self._close(stack, *CLOSES[name])
            if name in ("html", "body"):
                continue
            stack.append((name, self._node(name, stack[-1][1], words, label)))

    @staticmethod
    def _close(stack: list, names: set, fences: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in fences:
                return

    @staticmethod
    def _attributes(source: str) -> tuple[tuple, int, bool]:
        """The words of its names, its mark, and whether it is shown."""
        words, label, shown = [], -1, True
        if source and not source.isspace():
            for name, *values in _attr.findall(source):
                value = values[0] or values[1] or values[2]
                name = name.lower()
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    words += _names.findall(_camel.sub(" ", value).lower())
                elif name == "data-main":
                    label = int(value == "1")
                elif name == "aria-hidden" and value == "true":
                    words.append("hidden")
                elif name == "hidden" or name == "style" and _none.search(value):
                    shown = False
        return tuple(words), label, shown


class _Code(dict):
    """Feature to number, forgetting all when full."""

    def __missing__(self, feature: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[feature] = out = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % WIDTH
        return out


_code = _Code()


def _bucket(x: int) -> int:
    return (x * x * x).bit_length() // 2


def _features(page: Page) -> list[list[int]]:
    """For each node the numbers of its features."""
    n = len(page.tag)
    size, link, below, mine = [0] * n, [0] * n, [0] * n, [len(t) for t in page.text]
    for i in range(n - 1, -1, -1):
        size[i] += mine[i]
        link[i] += page.linked[i]
        below[i] += page.tag[i] == "#text"
        if i:
            for x in (size, link, below):
                x[page.parent[i]] += x[i]
    whole, before, out = max(1, size[0]), 0, []
    around: list[tuple] = [((), ())] * n  # what the nearest part of the page that a node stands in says of itself, and the part around that
    for i in range(n):
        tag, up = page.tag[i], page.tag[page.parent[i]] if i else ""
        if tag in _PARTS or page.words[i]:
            own = (f"a:{tag}", *(x for w in page.words[i] for x in (f"w:{w}", f"x:{w[:6]}")))
            around[i] = (own, around[page.parent[i]][0] if i else ())
        elif i:
            around[i] = around[page.parent[i]]
        share = 4 * link[i] // max(1, size[i])
        f = [f"t:{tag}", f"l:{min(share, 4)}", f"s:{_bucket(size[i])}", f"k:{_KIND.get(tag, 0)}:{min(share, 4)}", f"f:{4 * size[i] // whole}:{_KIND.get(tag, 0)}"]
        f += [f"c:{w}" for w in page.words[i]]
        f += around[i][0]
        f += [f"+{x}" for x in around[i][1]]
        if tag == "#text":
            t = page.text[i]
            marks = sum(t.count(c) for c in ".!?,;")
            f += [f"u:{up}", f"m:{min(marks, 4)}", f"e:{t.rstrip()[-1:] in '.!?:'}", f"o:{4 * before // whole}"]
            before += mine[i]
        else:
            f.append(f"n:{_bucket(below[i])}:{_KIND.get(tag, 0)}")
        out.append([_code[x] for x in f])
    return out


class Forest:
    """The trees of several pages as arrays, by level, so that one step of messages is one numpy operation."""

    def __init__(self, pages: list[Page]):
        starts = np.cumsum([0, *(len(p.tag) for p in pages)])
        self.start = starts
        features = [f for p in pages for f in _features(p)]
        self.rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
        self.columns = np.array([c for f in features for c in f], np.int64)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, starts, strict=False)] or [np.zeros(0, np.int64)])
        kind = np.array([_KIND.get(t, 0) if t != "#text" else KINDS - 1 for p in pages for t in p.tag], np.int64)
        depth = np.array([d for p in pages for d in p.depth], np.int64)
        self.edge = kind
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]
        self.n = len(features)

    def marginals(self, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(content) of each node, P(parent, child) of each edge, log of the partition function. w: weights of 'content'
        by feature; v: potentials [kind, parent label, child label]."""
        own = np.zeros((self.n, 2))
        own[:, 1] = np.bincount(self.rows, w[self.columns], self.n)
        up = np.zeros((self.n, 2))  # message to the parent
        inside = own.copy()
        for at in reversed(self.levels):
            up[at] = np.logaddexp.reduce(v[self.edge[at]] + inside[at][:, None, :], axis=2)
            np.add.at(inside, self.parent[at], up[at])
        down = np.zeros((self.n, 2))
        pair = np.zeros((self.n, 2, 2))
        for at in self.levels:
            p = self.parent[at]
            outside = inside[p] + down[p] - up[at]
            joint = outside[:, :, None] + v[self.edge[at]] + inside[at][:, None, :]
            down[at] = np.logaddexp.reduce(outside[:, :, None] + v[self.edge[at]], axis=1)
            joint -= np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
            pair[at] = np.exp(joint)
        belief = inside + down
        roots = np.flatnonzero(self.parent < 0)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), pair, float(np.logaddexp.reduce(inside[roots], axis=1).sum())


def _gold(page: Page) -> np.ndarray:
    """Each node's label: its own mark or else its parent's; unmarked is 0. A node with content below is content
    only if marked so."""
    out = np.zeros(len(page.tag), np.int64)
    for i in range(len(page.tag)):
        out[i] = page.label[i] if page.label[i] >= 0 else out[page.parent[i]] if i else 0
    return out


def fit(sources: list[str], rounds: int = 120, rate: float = 0.15, decay: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """The weights of labelled pages' features and of parent-child pairs."""
    pages = [Page(s) for s in sources]
    forest, y = Forest(pages), np.concatenate([_gold(p) for p in pages])
    inner = np.flatnonzero(forest.parent >= 0)
    gold = np.zeros((KINDS, 2, 2))
    np.add.at(gold, (forest.edge[inner], y[forest.parent[inner]], y[inner]), 1)
    w, v = np.zeros(WIDTH), np.zeros((KINDS, 2, 2))
    state = [np.zeros_like(x) for x in (w, w, v, v)]
    for t in range(1, rounds + 1):
        p, pair, _ = forest.marginals(w, v)
        gw = np.bincount(forest.columns, (p - y)[forest.rows], WIDTH) / len(pages) + decay * w
        gv = np.zeros((KINDS, 2, 2))
        np.add.at(gv, forest.edge[inner], pair[inner])
        gv = (gv - gold) / len(pages) + decay * v
        for k, (x, g) in enumerate(((w, gw), (v, gv))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            x -= rate * (1 - t / (rounds + 1)) * state[2 * k] / (1 - 0.9**t) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**t)) + 1e-8)
    return w, v


# Names that pages give to their parts, for the labelled pages.
_MAIN = "content main article post entry body story text page markdown prose".split()
_SIDE = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav tabs toc pagination pager links".split(),
    "head": "header masthead banner branding site logo topbar hero".split(),
    "foot": "footer bottom copyright colophon legal credits foot".split(),
    "aside": "sidebar aside related widget recommended more popular trending tags share social author bio newsletter".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner dfp outbrain".split(),
    "note": "cookie consent notice notification alert popup modal gdpr privacy overlay subscribe disclaimer message".split(),
    "comment": "comment comments discussion reply replies respond disqus thread feedback reader".split(),
    "form": "form search login signup subscribe newsletter contact".split(),
}


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Invented pages with data-main marks: tags, names, order, nesting and boilerplate vary."""
    rnd = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v th st".split() for b in "a e i o u an er in on es".split()]

    def word() -> str:
        return "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))

    def sentence(low: int = 3, high: int = 18) -> str:
        return " ".join(word() for _ in range(rnd.randint(low, high))).capitalize() + rnd.choice(["."] * 6 + ["?", "!"])

    def prose(low: int = 1, high: int = 7) -> str:
        odd = rnd.random()
        if odd < 0.06:  # poor text is text, too
            return " ".join(w for w in (word().capitalize() for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 60)))
        if odd < 0.1:
            return rnd.choice([" | ", "!! ", "%%% ", "*** "]).join(word() for _ in range(rnd.randint(5, 150)))
        out = " ".join(sentence() for _ in range(rnd.randint(low, high)))
        if rnd.random() < 0.3:
            w = rnd.choice(out.split())
            out = out.replace(w, rnd.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<span>{}</span>"]).format(w), 1)
        if rnd.random() < 0.08:
            out += rnd.choice(["***", " &amp;&amp;", " $$$", " %%%"])
        return out

    def named(kind: str) -> str:
        if rnd.random() < 0.2:
            return ""
        name = rnd.choice(_SIDE[kind] if kind in _SIDE else _MAIN)
        if rnd.random() < 0.4:
            name = rnd.choice(["{}-box", "site-{}", "{}-area", "{}_wrap", "js-{}", "{}-list", "page-{}", "{}-1", "c-{}"]).format(name)
        return rnd.choice([' class="{}"', ' id="{}"', ' class="{} col"', ' class="box {}"', ' role="{}"']).format(name)

    def links() -> str:
        items = "".join(rnd.choice(['<li><a href="/{0}">{0}</a></li>', '<li><a href="/{0}">{0} {0}</a>', '<a href="/{0}">{0}</a> ']).format(word()) for _ in range(rnd.randint(2, 12)))
        return f"<ul>{items}</ul>"

    def side(kind: str) -> str:
        tag = {"nav": ["nav", "div", "ul", "menu"], "head": ["header", "div"], "foot": ["footer", "div", "footer"], "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "ins"], "note": ["div", "section", "aside", "p"], "comment": ["section", "div", "ol"], "form": ["form", "div"]}[kind]
        tag = rnd.choice(tag)
        name = named(kind)
        if tag in ("div", "section", "p", "ol", "ul") and not name:
            name = f' class="{rnd.choice(_SIDE[kind])}"'
        body = {
            "nav": lambda: rnd.choice([links(), " | ".join(f'<a href="/{w}">{w}</a>' for w in (word() for _ in range(4)))]),
            "head": lambda: rnd.choice([f"<h1>{word()} {word()}</h1><p>{sentence()}</p>", f"<div>{word()}</div>" + links(), f'<a href="/">{word()}</a>', sentence()]),
            "foot": lambda: rnd.choice([f"&copy; {word()} &middot; {sentence()}", f"<p>{prose(1, 2)}</p>" + links(), links(), f"<p>&copy; 2020 {word()}</p>", prose(1, 3)]),
            "aside": lambda: rnd.choice([f"<h3>{word()}</h3>" + links(), f"<h3>{word()}</h3><p>{prose(1, 3)}</p>", f"<p>{prose(1, 4)}</p>", links()]),
            "ad": lambda: rnd.choice([sentence(), prose(1, 3), f"<p>{prose(1, 2)}</p>", f'<a href="/buy">{sentence()}</a>']),
            "note": lambda: rnd.choice([prose(1, 3), f"<p>{prose(1, 3)}</p><button>{word()}</button>", sentence()]),
            "comment": lambda: f"<h3>{word()}</h3>" * rnd.randint(0, 1) + "".join(rnd.choice(['<div class="comment"><b>{1}</b><p>{0}</p></div>', "<li><p>{0}</p></li>", '<article class="comment"><p>{0}</p></article>', "<p>{0}</p>", '<div class="reply">{1}: {0}</div>']).format(prose(1, 4), word()) for _ in range(rnd.randint(1, 5))),
            "form": lambda: f'<label>{word()}</label><input name="q"><p>{sentence()}</p><button>{word()}</button>',
        }[kind]()
        return f'<{tag}{name} data-main="0">{body}</{tag}>'

    def article() -> str:
        title = f"<h1>{sentence(2, 9)}</h1>"
        blocks = [rnd.choice([title, title, title, f"<header>{title}</header>", f"<div>{title}</div>"])] if rnd.random() < 0.8 else []
        bare = rnd.random() < 0.2
        if bare:  # text without any block of its own
            blocks.append(rnd.choice(["{}", "{}<br>{}", "{}<br><br>{}<br>{}"]).format(*(prose() for _ in range(3))))
        if rnd.random() < 0.2:  # many short blocks are no sign of a menu
            blocks += [f"<p>{sentence(1, 5)}" + rnd.choice(["</p>", ""]) for _ in range(rnd.randint(8, 60))]
        for _ in range(rnd.choice([0, 0, 3]) if bare else rnd.randint(1, 12)):
            blocks.append(
                rnd.choices(
                    [lambda: f"<p>{prose()}</p>", lambda: f"<{rnd.choice(['p', 'p', 'p', 'div'])} {rnd.choice(['class', 'id'])}={rnd.choice([word(), word()[:1], 'x', 'lead', 'quote', 'intro', 'p1'])}>{prose()}</{'p'}>".replace("<div", "<p"), lambda: f"<p>{prose()}", lambda: f"<h2>{sentence(1, 6)}</h2><p>{prose()}</p>", lambda: "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(rnd.randint(2, 5))) + "</ul>",
                     lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: f"<div>{prose()}</div>", lambda: f"<p><b>{sentence()}<br>", lambda: f"<table><tr><td>{sentence()}</td><td>{word()}</td></tr></table>",
                     lambda: f"<pre>{prose()}</pre>", lambda: f"<section><h3>{word()}</h3><p>{prose()}</p></section>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>"],
                    [10, 2, 2, 2, 1, 1, 1, 1, 0.5, 0.3, 0.7, 0.3],
                )[0]()
            )
        for kind, chance in (("ad", 0.25), ("aside", 0.15), ("note", 0.1), ("form", 0.05), ("nav", 0.08), ("comment", 0.1)):
            if rnd.random() < chance:
                at = len(blocks) if kind == "comment" else rnd.randint(0, len(blocks))
                blocks.insert(at, side(kind))
        if rnd.random() < 0.12:  # no element around the article: each block is marked
            return "".join(re.sub(r"^<(\w+)((?: (?!data-main)[^<>]*)?)>", r'<\1\2 data-main="1">', b) if "data-main" not in b.split(">")[0] and b.startswith("<") else b if b.startswith("<") else f'<p data-main="1">{b}</p>' for b in blocks)
        tag = rnd.choice(["article", "article", "main", "div", "div", "section"])
        name = named("main")
        if tag in ("div", "section") and not name:
            name = f' class="{rnd.choice(_MAIN)}"'
        body = f'<{tag}{name} data-main="1">{"".join(blocks)}</{tag}>'
        if rnd.random() < 0.35:
            outer = rnd.choice(["div", "main", "section"])
            body = f'<{outer}{named("main") if rnd.random() < 0.6 else ""}>{side("aside") if rnd.random() < 0.3 else ""}{body}{side(rnd.choice(["comment", "aside", "ad"])) if rnd.random() < 0.5 else ""}</{outer}>'
        return body

    out = []
    for i in range(n):
        if i % 12 == 0:  # nothing but text
            blocks = [f'<p data-main="1">{prose()}' + rnd.choice(["</p>", ""]) for _ in range(rnd.randint(1, 9))]
            heading = rnd.choice(["", "", f'<h1 data-main="1">{sentence(2, 9)}</h1>'])
            out.append(rnd.choice(["{}", "<html><body>{}</body></html>"]).format(heading + "".join(blocks)))
            continue
        parts = [side(k) for k, c in (("note", 0.2), ("head", 0.6), ("nav", 0.8), ("form", 0.2), ("ad", 0.5)) if rnd.random() < c]
        rnd.shuffle(parts)
        after = [side(k) for k, c in (("aside", 0.4), ("ad", 0.3), ("comment", 0.4), ("note", 0.1), ("form", 0.15)) if rnd.random() < c]
        rnd.shuffle(after)
        tail = side("foot") if rnd.random() < 0.85 else ""
        out.append(f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(parts)}{article()}{''.join(after)}{tail}</body></html>")
    return out


_trained: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def trained(sources: tuple[str, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The model of the given labelled pages, or of labelled_pages(); kept for the process."""
    key = hash(sources)
    if key not in _trained:
        _trained[key] = fit(list(sources) if sources else labelled_pages())
    return _trained[key]


def extract(sources: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    p, _, _ = forest.marginals(*model)
    out = []
    for page, start in zip(pages, forest.start, strict=False):
        blocks = (_space.sub(" ", t).strip() for i, t in enumerate(page.text) if t and p[start + i] > 0.5)
        out.append(" ".join(b for b in blocks if b))
    return out


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] | None = None) -> DataFrame:
    """(id, url, text, n_chars) for each row of pages. A null or empty page, or one without content, has
    the empty text. Pages of any length are read whole; repeated rows and null ids give a row each; an
    empty table gives none; further columns are not read."""
    model = trained(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            texts = extract(b.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return mapped(rows, run, "id long, url string, text string, n_chars long")
