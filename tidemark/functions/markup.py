"""A page as flat lists of elements and texts, for the parsing jobs of ``operators.pages``.

Elements are numbered in document order and know where their content ends, so "inside" is a range
test and no tree is kept. Unclosed tags stay open until an enclosing one ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser

# Fixed values of HTML.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
UNSEEN = frozenset("script style template rt rp".split())

# Tags that need no further look: no attributes, and no name that changes how the text after them is read.
_RAW = "script|style|textarea|title|plaintext|xmp|iframe|noembed|noframes|noscript"
_BARE_START = re.compile(rf"<(?!(?:{_RAW})>)([a-z][a-z0-9]*)>")
_BARE_END = re.compile(r"</([a-z][a-z0-9]*)>")


class Element:
    __slots__ = ("index", "name", "attrs", "parent", "unseen", "first_text", "end_text", "end_index")

    def __init__(self, index, name, attrs, parent, first_text):
        self.index, self.name, self.attrs, self.parent = index, name, attrs, parent
        self.unseen = name in UNSEEN or (parent is not None and parent.unseen)
        self.first_text, self.end_text, self.end_index = first_text, None, None

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class Page(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.texts: list[tuple[str, bool]] = []
        self._pending: list[str] = []
        self.root = Element(0, "", {}, None, 0)
        self.elements = [self.root]
        self._open = [self.root]
        self.feed(html or "")
        self.close()
        self._flush()
        while self._open:
            self._end(self._open.pop())

    # parser events

    def updatepos(self, i, j):
        return j  # lines and columns are not asked for

    def parse_starttag(self, i):
        bare = _BARE_START.match(self.rawdata, i)
        if bare is None:
            return super().parse_starttag(i)
        self.handle_starttag(bare[1], ())
        return bare.end()

    def parse_endtag(self, i):
        bare = _BARE_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if bare is None:
            return super().parse_endtag(i)
        self.handle_endtag(bare[1])
        return bare.end()

    def handle_starttag(self, tag, attrs):
        self._flush()
        values = {k: v or "" for k, v in attrs}
        element = Element(len(self.elements), tag, values, self._open[-1], len(self.texts))
        self.elements.append(element)
        self._open.append(element)
        if tag in VOID:
            self._end(self._open.pop())

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if self._open[-1].name == tag or any(e.name == tag for e in self._open[1:]):
            while True:
                element = self._open.pop()
                self._end(element)
                if element.name == tag:
                    return

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def _flush(self):
        if self._pending:
            self.texts.append(("".join(self._pending), self._open[-1].unseen))
            self._pending = []

    def _end(self, element):
        element.end_text, element.end_index = len(self.texts), len(self.elements)

    # queries

    def inside(self, element: Element) -> list[Element]:
        return self.elements[element.index + 1 : element.end_index]

    def all(self, names: Iterable[str] | None, test: Callable = lambda e: True, within: Element | None = None):
        return (e for e in self.inside(within or self.root) if (names is None or e.name in names) and test(e))

    def first(self, names, test: Callable = lambda e: True, within: Element | None = None) -> Element | None:
        return next(self.all(names, test, within), None)

    def pieces(self, element: Element) -> list[str]:
        return [t for t, unseen in self.texts[element.first_text : element.end_text] if not unseen]

    def source(self, element: Element) -> str:
        """Everything inside, also what is not shown, as of a script."""
        return "".join(t for t, _ in self.texts[element.first_text : element.end_text])

    def words(self, element: Element) -> str:
        """Non-blank texts, stripped, with a blank between them."""
        return " ".join(filter(None, (p.strip() for p in self.pieces(element))))

    def joined(self, element: Element) -> str:
        """Non-blank texts, stripped, with nothing between them."""
        return "".join(p.strip() for p in self.pieces(element))

    def cell(self, element: Element) -> str:
        return "".join(self.pieces(element)).strip()

    def paragraphs(self, element: Element) -> str:
        return " ".join(self.words(p) for p in self.all(("p",), within=element))
