"""Main text of web pages by two passes over their blocks.

The first pass decides blocks by link density, length and density of stop words; the second gives
short and doubtful blocks the label of the nearest decided ones. Both go over every page. The page's
own marks are features of them: what stands in navigation, forms, asides, adverts or comments, or
outside of an article that the page marks, is decided in the first pass; inside of a marked article a
block of few stop words is doubtful rather than bad, and the mark counts as a good neighbour beyond
either end.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ._rows import map_texts

# Frequent function words of six languages.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with this be at by not from or an have which but
    der die das und ist nicht ein eine zu den mit von für auf im dem des sich auch es
    le la les des du un une et est que qui dans pour pas sur au avec ce par il
    el los las del una y en que por con para su lo como más se no al
    di che non per una sono con del della il
    de het een van niet dat op te met""".split()
)
# Elements whose content is never text of a page, and elements that don't end a block.
RAW = ("script", "style", "textarea", "title", "iframe")
UNSEEN = ("noscript", "template", "svg", "object", "select", "button")
# Elements that end one of UNSEEN that is never closed.
ENDING = """address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that hold the text of one block; blocks in one parent of these are of one home.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption address summary center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav footer aside form dialog menu".split())
# Words of a class, id or role that name what isn't the article, and what is.
OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
    consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar aside
    menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager search share sharing
    social related recommended comment comments commentlist replies reply disqus respond widget copyright
    disclaimer alert complementary contentinfo dialog outbrain taboola""".split()
)
# Words that go with the above in one name and leave its meaning.
WITH_OUT_WORDS = frozenset(
    """site page main top bottom left right primary secondary global list area section block box bar wrap wrapper container
    inner outer item items links link button buttons icons header head body form title text post posts entry article articles content
    story widgets menus tags meta message""".split()
)
IN_WORDS = frozenset("article story post entry content main maincontent articlebody".split())

SHORT, LONG = 70, 200
#: The lists above hold the commonest words only, so running text has less of them than of full lists.
SOME_STOPS, MANY_STOPS = 0.08, 0.2
#: Below this share of stop words over a page, its language has no list here.
FEW_STOPS = 0.12
MOST_LINKED, LINKED_IN_ARTICLE = 0.2, 0.8
#: Blocks between a doubtful block of few stop words and the nearest good one, at most.
FAR = 40

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_INSIDE = r"(?:[^<]++|<(?!/?\2\b))"
# Unseen elements may hold one level of their own kind; those without an end go up to the next block tag.
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|(?=<body\b)|\Z)"
    r"|<svg\b(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*+/>"
    rf"|<({'|'.join(UNSEEN)})\b{_ATTRIBUTES}>(?:(?:{_INSIDE}|<\2\b[^>]*>{_INSIDE}*+</\2\s*>)*+</\2\s*>|.*?(?=</?(?:{'|'.join(ENDING)})\b|\Z))"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WIDE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_WORD = re.compile(r"[^\W\d_]+")


def names_out(name: str) -> bool:
    """Whether a whole class, id or role names what isn't the article; ``has-sidebar`` and ``content-sidebar`` name a layout."""
    words = {w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()}
    if not words & OUT_WORDS or {"content", "sidebar"} <= words:
        return False
    return words <= OUT_WORDS | WITH_OUT_WORDS


@dataclass
class Block:
    """``out`` is 0 in the page's text, 1 in a marked article inside of what is out, 2 in what is out, 3 if hidden."""

    text: str
    linked: int
    out: int
    level: int
    home: int = 0
    heading: bool = False
    apart: bool = False
    label: str = ""

    @property
    def link_density(self) -> float:
        return self.linked / max(len(self.text), 1)

    @property
    def size(self) -> int:
        """Length, where a character of scripts without blanks counts as three letters."""
        return len(self.text) + 2 * len(_WIDE.findall(self.text))

    @property
    def stop_density(self) -> float:
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


@dataclass
class _Page:
    """Blocks of a page as its tags come by; ``open`` has each open element with what it says about its content."""

    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, int, int, int]] = field(default_factory=lambda: [("", 0, 0, 0)])
    homes: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len("".join(html.unescape(raw).split()))

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, out, level, home = self.open[-1]
                self.blocks.append(Block(text, self.linked, out, level, home, any(self.counts.get(h) for h in HEADING)))
            self.parts = []
        self.linked = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.links += 1
        names = {w for _, value in _NAMED.findall(attributes) for w in re.split(r"[^a-z0-9]+", value.lower())} if attributes else set()
        if tag not in INLINE:
            self.end_block()
            if tag == "br":
                return
            if self.open[-1][0] == "p":  # a paragraph ends where another block begins
                self._pop("p")
        if tag in VOID:
            return
        _, out, level, _ = self.open[-1]
        whole = (n for _, value in _NAMED.findall(attributes) for n in value.lower().strip("\"'").split()) if names & OUT_WORDS else ()
        here = 2 if tag in OUT or (tag == "header" and level == 0) or any(map(names_out, whole)) else 0
        if "hidden" in attributes.lower().split():
            here = 3
        if tag in ("body", "html"):
            here = 0
        mine = 3 if tag == "article" else 2 if tag == "main" or "main" in names and "role" in attributes.lower() else 1 if names & IN_WORDS and tag not in ("body", "html") else 0
        if tag in INLINE:
            if here and tag != "a":
                self.end_block()
                self._push(tag, max(out, here), level)
            return
        out = max(out, here)
        self._push(tag, 1 if mine >= 2 and out == 2 else out, max(level, mine))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE:
            self.end_block()
        elif self.counts.get(tag):
            self.end_block()
        self._pop(tag)

    def _push(self, tag: str, out: int, level: int) -> None:
        home = self.open[-1][3]
        if tag not in INLINE and tag not in LEAF:
            self.homes += 1
            home = self.homes
        self.open.append((tag, out, level, home))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _pop(self, tag: str) -> None:
        """Close the last open element of this name and what is open inside it; an end without a start does nothing."""
        if self.counts.get(tag):
            while True:
                name = self.open.pop()[0]
                self.counts[name] -= 1
                if name == tag:
                    return


def blocks(page: str) -> list[Block]:
    """Text blocks in page order."""
    state, at = _Page(), 0
    for m in _TOKEN.finditer(page):
        state.text(page[at : m.start()])
        at = m.end()
        if tag := m[4] or m[7]:
            tag = tag.lower()
            if m[3] or m[6]:
                state.end(tag)
            else:
                state.start(tag, m[5] or m[8] or "")
        elif m[1] or m[2]:
            state.end_block()
    state.text(page[at:])
    state.end_block()
    return state.blocks


def has_stop_words(found: list[Block]) -> bool:
    """Whether the page is of a language with stop words here, by all its longer blocks with few links."""
    words = [w for b in found if not b.out and b.link_density <= MOST_LINKED and b.size >= SHORT for w in _WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) >= FEW_STOPS * len(words)


def marks(found: list[Block]) -> tuple[int, int]:
    """The strongest mark of an article on the page, and how far out a block may stand to be in it.

    An article or main mark inside of what is out counts if the page has none elsewhere (comments and
    teasers are often marked so).
    """
    marked, most = max((b.level for b in found if not b.out), default=0), 0
    if marked < 2 and any(b.out == 1 for b in found):
        marked, most = max(b.level for b in found if b.out == 1), 1
    return marked, most


def first_pass(found: list[Block]) -> None:
    """Labels good and bad where a block can be decided, near and short where not, off what is hidden.

    The page's marks move the thresholds: what an article mark holds may have more links, and what
    stands outside of it, or in a part that is marked as none of it, isn't good by itself, however
    long and dense. Blocks of a language without stop words here go by links and length.
    """
    marked, most = marks(found)
    listed = has_stop_words(found)
    for b in found:
        size = len(b.text) if listed else b.size
        b.apart = b.out > most or b.level < marked
        article = marked and not b.apart
        if b.out == 3:
            b.label = "off"
        elif b.link_density > (LINKED_IN_ARTICLE if article else MOST_LINKED):
            b.label = "bad"
        elif size < SHORT:
            b.label = "bad" if b.linked and not article else "short"
        elif b.apart:
            b.label = "near"
        elif b.link_density > MOST_LINKED:
            b.label = "near"
        elif not listed:
            b.label = "good" if size > LONG else "near"
        else:
            density = b.stop_density
            if density >= MANY_STOPS:
                b.label = "good" if size > LONG else "near"
            else:
                b.label = "near" if density >= SOME_STOPS or marked else "bad"


def _decided(found: list[Block], places: list[int], edge: str | None) -> dict[int, list[tuple[str, int]]]:
    """For each undecided place the nearest decided labels before and after it, with how many blocks away; ``edge`` stands beyond the ends."""
    sides: dict[int, list[tuple[str, int]]] = {}
    for order in (range(len(places)), range(len(places) - 1, -1, -1)):
        last = (edge, -1 if order.step > 0 else len(places))
        for k in order:
            block = found[places[k]]
            if block.label in ("good", "bad"):
                last = (block.label, k)
            elif last[0]:
                sides.setdefault(places[k], []).append((last[0], abs(k - last[1])))
            else:
                sides.setdefault(places[k], []).append(("", 0))
    return sides


def second_pass(found: list[Block]) -> None:
    """Short and doubtful blocks take the label of the nearest decided blocks.

    Neighbours with the same parent go first; where it has none that is decided, those before and
    after on the page, and beyond the ends the article's mark, or bad on a page without. Doubtful
    blocks are good next to a good one. Short ones are good between two; where both sides differ, the
    nearer of one parent decides, at equal distance the later for a heading and the earlier for
    others, and over parents they are bad. A doubtful block of few stop words is bad if no good one is
    within ``FAR`` blocks. What is apart from the article has neighbours there only, and bad beyond its ends.
    """
    for apart, edge in ((False, "good" if marks(found)[0] else "bad"), (True, "bad")):
        _settle(found, [i for i, b in enumerate(found) if b.label != "off" and b.apart == apart], edge)


def _settle(found: list[Block], inside: list[int], edge: str) -> None:
    """The second pass over some of the page's blocks, with what stands beyond their ends."""
    homes: dict[int, list[int]] = {}
    for i in inside:
        homes.setdefault(found[i].home, []).append(i)
    on_page = _decided(found, inside, edge)
    labels = {}
    for places in homes.values():
        for i, sides in _decided(found, places, None).items():
            near = [s for s in sides if s[0]]
            at_home = bool(near)
            near = near or on_page[i]
            kinds = {label for label, _ in near}
            if found[i].label == "near" and min((d for label, d in near + on_page[i] if label == "good"), default=0) > FAR and found[i].stop_density < SOME_STOPS:
                labels[i] = "bad"
            elif len(kinds) == 1:
                labels[i] = kinds.pop()
            elif found[i].label == "near":
                labels[i] = "good"
            elif not at_home:
                labels[i] = "bad"
            else:
                (before, b), (after, a) = near
                labels[i] = before if b < a or b == a and not found[i].heading else after
    for i, label in labels.items():
        found[i].label = label


def main_text(page: str | None) -> str:
    """The good blocks of a page, joined by a blank; null and empty pages have none, very long ones are read as a whole."""
    found = blocks(page or "")
    first_pass(found)
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``result`` (text, n_chars) of every page; null html gives the empty text, repeated rows the same one each, an empty table none. Carried columns are in ``row``, so their names can't clash."""

    def run(column: pa.Array) -> list[pa.Array]:
        texts = [main_text(p) for p in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(pages, run, "text string, n_chars bigint", text="html", carry=carry)
