"""Main text of a page by tree scoring.

Every block of text passes points to the elements around it: one for being there (less if it is very
short), one per comma, one per hundred characters up to three, discounted by its link density; the
parent gets all, the next half, those further up less and less. The element with the most points, again
discounted by its own link density, is the container; the outermost article around it is taken whole (with sibling articles that
score), or else an element named for its content, else siblings with enough points, headings, lists and real paragraphs next to it are kept too. Menus, headers, footers, sidebars,
notices, adverts, forms, comments and everything that is not shown are left out from the start.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

_MARKUP = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)(>|\Z))""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript textarea title iframe svg math canvas object select button xmp noembed noframes".split())
_ENDED = frozenset("svg math canvas object select button".split())  # these end at their end tag, or where a block starts or ends
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = _HEADINGS | frozenset("p pre li td th dd dt figcaption caption blockquote summary".split())
# What an opening tag closes first, up to the element that bounds it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
_OUT = frozenset("nav footer aside form dialog menu search fieldset head".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar status".split())
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|menu\w*|nav(?:bar\w*|igation\w*|s)?|breadcrumbs?|footer\w*|masthead|"
    r"cookies?|consent|notices?|alerts?|popups?|modals?|overlay|newsletter|subscri\w*|share|sharing|social|related|recommend\w*|"
    r"comments?|disqus\w*|repl(?:y|ies)|respond|widgets?|login|signup|paginat\w*|pager|outbrain|taboola)(?:$|[\s_-])"
)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|repl(?:y|ies)|respond)(?:$|[\s_-])")
_ADVERT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adsbygoogle|advert\w*|sponsor\w*|promo\w*)(?:$|[\s_-])")
# Names that tell a state or layout of the element that has them, and names of what holds the text.
_STATES = re.compile(r"(?:has|no|with|without|is|not)[_-].*|.*[_-](?:open|opened|closed|active|enabled|disabled|visible|hidden|left|right)")
_CONTENT = re.compile(r"(?:(?:page|main|site|post|entry|article|story)[_-]?)?(?:content|article|entry|post|story|body|text|main)(?:[_-]?(?:content|body|text))?")
_WHOLE = frozenset(("article", "main"))


_LEVELS = 40  # elements above a block that get points from it; the last one's share is below a hundredth
_LISTS = frozenset("ul ol dl table blockquote pre figure".split())


def _named_out(names: str, out: re.Pattern = _OUT_NAMES) -> bool:
    """Whether a class or id names something beside the text, and none names the text itself."""
    words = [w for w in names.split() if not _STATES.fullmatch(w)]
    return not any(_CONTENT.fullmatch(w) for w in words) and out.search(" ".join(words)) is not None


def _ends(tag: str) -> re.Pattern:
    """The end of an element whose text is left out."""
    closing = f"</{tag}(?![a-zA-Z0-9])[^>]*>?"
    return re.compile(closing + (f"|(?=</?(?:{'|'.join(sorted(_BLOCK))})[\\s/>])" if tag in _ENDED else ""), re.IGNORECASE)


_END_OF = {tag: _ends(tag) for tag in _RAW}


class Page:
    """Elements as parallel lists, in page order, and the shown blocks of text with the element each is in.

    Reading takes time linear in the page, however deep its elements are nested.
    """

    def __init__(self, source: str, by_name: bool = True):
        self.by_name = by_name  # whether classes and ids tell what is left out
        self.tags, self.parents = ["html"], [-1]
        self.content: set[int] = set()  # elements that are named for holding the text
        self.blocks: list[tuple[int, str, float]] = []  # element, text, share of it in links
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.walls = [0]  # depths of the open elements that a paragraph does not reach across
        self.whole = 0  # open articles and mains
        self.hidden = 0  # element that hides what is open now
        self.firm = False  # whether it hides articles, too
        self.muted = ("", 0, 0)  # inline element that hides its text: tag, how many of it are open, depth of its block
        self.linked = 0  # depth at which a link is open
        self.parts: list[str] = []
        self.plain = self.in_links = 0
        self._read(source)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.hidden:
                whole = self.plain + self.in_links
                self.blocks.append((self.stack[-1], text, self.in_links / whole if whole else 0.0))
            self.parts = []
        self.plain = self.in_links = 0

    def _close(self, depth: int) -> None:
        """Closes elements until ``depth`` are open."""
        self._flush()
        while len(self.stack) > depth:
            element = self.stack.pop()
            tag = self.tags[element]
            self.depths[tag].pop()
            self.whole -= tag in _WHOLE
            if self.walls[-1] == len(self.stack):
                self.walls.pop()
            if element == self.hidden:
                self.hidden = 0
        if self.linked > depth:
            self.linked = 0
        if self.muted[2] > depth:
            self.muted = ("", 0, 0)

    def _last(self, tags) -> int:
        """Depth of the innermost open element with one of the tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        closed, bounds = _CLOSES.get(tag, ((), ()))
        wall = max(self.walls[-1], self._last(bounds))
        ended = self._last({"p"} | (_HEADINGS if tag in _HEADINGS else set()))
        ended = ended if ended > wall else 0
        own = self._last(closed)
        ended = max(ended, own if own > self._last(bounds) else 0)
        if ended:
            self._close(ended)
        if tag in _WHOLE and self.hidden and not self.whole and not self.firm:
            self._close(1)  # a menu or advert that was never closed does not swallow the article
        inside = self.whole > 0
        depth = len(self.stack)
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.stack.append(len(self.tags) - 1)
        self.depths.setdefault(tag, []).append(depth)
        self.whole += tag in _WHOLE
        if tag not in _LEAVES:
            self.walls.append(depth)
        if not self.hidden and (tag in _OUT or (tag == "header" and not inside) or (attributes and self._left_out(tag, attributes))):
            self.hidden = self.stack[-1]
            self.firm = bool(attributes) and _COMMENT_NAMES.search(self._names(attributes)) is not None

    @staticmethod
    def _values(attributes: str) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}

    def _names(self, attributes: str) -> str:
        values = self._values(attributes)
        return values.get("class", "") + " " + values.get("id", "")

    @staticmethod
    def _not_shown(values: dict[str, str]) -> bool:
        return "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")

    def _left_out(self, tag: str, attributes: str) -> bool:
        values = self._values(attributes)
        if self._not_shown(values):
            return True
        if tag in ("html", "body"):
            return False
        names = values.get("class", "") + " " + values.get("id", "")
        if tag in _WHOLE:  # only a reader's comment is an article that is left out
            return self.by_name and _named_out(names, _COMMENT_NAMES)
        if values.get("role", "") in _OUT_ROLES:
            return True
        if any(_CONTENT.fullmatch(w) for w in names.split()):
            self.content.add(len(self.tags) - 1)
        return self.by_name and _named_out(names)

    def _mute(self, tag: str, attributes: str) -> None:
        """An inline element that is not shown, or a span or insertion named for an advert, hides its text up to its end or that of its block."""
        values = self._values(attributes)
        named = tag in ("span", "ins") and _named_out(values.get("class", "") + " " + values.get("id", ""), _ADVERT_NAMES)
        if self._not_shown(values) or (self.by_name and named):
            self.muted = (tag, 1, len(self.stack))

    def _text(self, text: str) -> None:
        if not self.hidden and not self.muted[1] and text:
            if "&" in text:
                text = html.unescape(text)
            self.parts.append(text)
            size = len(text.strip())
            if self.linked:
                self.in_links += size
            else:
                self.plain += size

    def _read(self, source: str) -> None:
        at, match = 0, _MARKUP.search
        while found := match(source, at):
            self._text(source[at : found.start()])
            at = found.end()
            if not found[2]:
                continue  # a comment or declaration
            tag = found[2].lower()
            if self.muted[0] == tag and found[3][-1:] != "/":
                self.muted = (tag, self.muted[1] + (-1 if found[1] else 1), self.muted[2])
                if self.muted[1] == 0:
                    self.muted = ("", 0, 0)
            if found[1]:
                if tag in _BLOCK:
                    if self.depths.get(tag):
                        self._close(self.depths[tag][-1])
                    else:
                        self._flush()
                elif tag == "a":
                    self.linked = 0
            elif tag in _RAW:
                if tag in _ENDED and found[3][-1:] == "/":
                    continue
                end = _END_OF[tag].search(source, at)
                at = end.end() if end else at if tag in _ENDED else len(source)
            elif tag == "hr":
                self._flush()
            elif tag == "br":
                self._text(" ")
            elif tag in ("html", "body"):
                self._flush()
                if tag == "body":
                    self._close(1)
            elif tag in _BLOCK:
                self._open(tag, found[3])
            elif tag in _VOID:
                continue
            else:
                if tag == "a":
                    self.linked = len(self.stack)
                if found[3] and not self.muted[1] and found[3][-1:] != "/":
                    self._mute(tag, found[3])
        self._text(source[at:])
        self._flush()

    def _above(self, element: int) -> list[int]:
        """The elements that get a block's points, nearest first."""
        out = []
        if self.tags[element] in _LEAVES:
            element = self.parents[element]
        while element >= 0 and len(out) < _LEVELS:
            out.append(element)
            element = self.parents[element]
        return out

    def _outermost(self, element: int, wanted) -> int:
        """The outermost of an element and those around it that is wanted, -1 if none is."""
        found = -1
        while element >= 0:
            if wanted(element):
                found = element
            element = self.parents[element]
        return found

    def container(self) -> tuple[set[int], dict[int, float]]:
        """The elements whose text is kept, and the points."""
        points: dict[int, float] = {}
        size, links = [0.0] * len(self.tags), [0.0] * len(self.tags)
        for element, text, density in self.blocks:
            worth = (min(1.0, len(text) / 25) + text.count(",") + min(len(text) / 100, 3.0)) * (1 - density)
            for level, above in enumerate(self._above(element)):
                points[above] = points.get(above, 0.0) + worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            size[element] += len(text)
            links[element] += len(text) * density
        if not points:
            return set(), points
        for element in range(len(self.tags) - 1, 0, -1):  # parents come before their children
            size[self.parents[element]] += size[element]
            links[self.parents[element]] += links[element]
        points = {e: p * (1 - links[e] / size[e]) for e, p in points.items()}
        best = max(points, key=lambda e: (points[e], -e))
        article = self._outermost(best, lambda e: self.tags[e] == "article")
        if article >= 0:
            enough = max(2.0, 0.2 * points.get(article, 0.0))
            beside = {e for e, p in points.items() if self.tags[e] == "article" and self.parents[e] == self.parents[article] and p >= enough}
            return {article} | beside, points
        around = self._outermost(best, lambda e: self.tags[e] == "main")
        if around < 0:
            around = self._outermost(best, lambda e: e in self.content)
        if around >= 0:
            return {around}, points
        kept = {best}
        for element, parent in enumerate(self.parents):
            if parent == self.parents[best] >= 0 and element != best:
                own = [(t, d) for e, t, d in self.blocks if e == element] if self.tags[element] == "p" else []
                text, density = " ".join(t for t, _ in own), links[element] / size[element] if size[element] else 0.0
                paragraph = self.tags[element] == "p" and density < 0.25 and (len(text) > 80 or text[-1:] in ".!?…")
                heading = self.tags[element] in _HEADINGS and element < best and density < 0.5
                listed = self.tags[element] in _LISTS and density < 0.25 and size[element] >= 25
                if paragraph or heading or listed or points.get(element, 0.0) >= max(2.0, 0.2 * points[best]):
                    kept.add(element)
        return kept, points

    def main_text(self) -> str:
        kept, _ = self.container()
        inside: dict[int, bool] = {-1: False}

        def of(element: int) -> bool:
            path = []
            while element not in inside:
                path.append(element)
                if element in kept:
                    inside[element] = True
                    break
                element = self.parents[element]
            for e in path:
                inside[e] = inside[element]
            return inside[element]

        return "\n".join(text for element, text, _ in self.blocks if of(element))


def main_text(source: str | None) -> str:
    if not source:
        return ""
    return Page(source).main_text() or Page(source, by_name=False).main_text()  # names may hide all there is


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    ``text`` is the main text: blocks in page order, a line each, white space inside a block as one space,
    character references decoded. Pages without any, and null or empty html, have an empty text. Unclosed and broken
    markup is read as far as it goes. Repeated rows, null ids and null urls stay as they are.
    """

    def run(batches):
        for batch in sliced(batches, 64):
            texts = [main_text(source.as_py()) for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
