"""A small tree of an HTML page, enough to find tables by the heading above them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Element:
    """A tag with attributes, children (elements and strings) and its parent."""

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attributes, self.parent = tag, attributes or {}, parent
        self.children: list[Element | str] = []

    def get(self, name: str) -> str | None:
        return self.attributes.get(name)

    @property
    def classes(self) -> list[str]:
        return (self.get("class") or "").split()

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order."""
        for c in self.elements:
            yield c
            yield from c.walk()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            else:
                yield from c.strings()

    @property
    def text(self) -> str:
        """All text below with single spaces."""
        return " ".join("".join(self.strings()).split())

    @property
    def own_text(self) -> str:
        return " ".join("".join(c for c in self.children if isinstance(c, str)).split())

    def all(self, *tags: str, where: Callable[[Element], bool] = lambda e: True) -> list[Element]:
        return [e for e in self.walk() if e.tag in tags and where(e)]

    def up(self, n: int) -> Element | None:
        """The n-th ancestor."""
        at: Element | None = self
        for _ in range(n):
            at = at.parent if at is not None else None
        return at

    def within(self, tag: str) -> bool:
        at = self.parent
        while at is not None:
            if at.tag == tag:
                return True
            at = at.parent
        return False

    def next(self) -> Element | None:
        """The next sibling element."""
        if self.parent is None:
            return None
        siblings = self.parent.elements
        k = next(i for i, e in enumerate(siblings) if e is self)
        return siblings[k + 1] if k + 1 < len(siblings) else None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = self.root = Element("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(page: str) -> Element:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def rows(table: Element) -> list[list[Element]]:
    """The cells of a table's rows."""
    return [r.all("td", "th") for r in table.all("tr")]
