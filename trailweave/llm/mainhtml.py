"""The main text of web pages by minimum cut.

A page becomes a row of text blocks. A classifier's log-odds that a block is content, a logistic regression whose
weights are fitted (boilerplate.py), are the capacities of its edges to the two terminals; blocks that follow one another, and blocks with the same parent in the document tree, are tied by
edges of their own. The minimum cut, found as a maximum flow, is the labelling of least total cost: a block is kept
against its own odds where its surroundings outweigh them. Blocks whose odds outweigh all their ties are decided
beforehand, which is exact and leaves little for the flow."""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements of HTML by how they are treated; their names are fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style template noscript iframe canvas object audio video head title textarea select button form input datalist map applet noframes".split())
_RAW = frozenset("script style textarea title iframe noscript noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends: open elements of these names, unless one of the second row is open within.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}

#: What elements, roles and the words of classes and ids tell of what is in them: fixed values, stems ending in *.
BOILER_TAGS = frozenset("nav footer aside header menu dialog search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CONTENT_TAGS = CONTENT_ROLES = frozenset("article main".split())
_BOILER = """comment* disqus* respond reply replies cookie* consent* gdpr adsbygoogle ad ads adv advert* adslot adbox sponsor* promo* popup*
modal* overlay* newsletter* subscri* signup login nav navbar navig* menu* breadcrumb* sidebar* side rail footer* masthead topbar banner* widget*
related recommend* share sharing social* pagination pager paging notice* notif* disclaimer* copyright legal toolbar skip search* teaser* trending
popular outbrain taboola tags tagcloud form alert* header byline meta metadata author* dateline timestamp""".split()
_CONTENT = "article articles content contents post posts entry story stories body maintext main prose text".split()
_LAYOUT = "area bar block bottom box col column container grid group inline inner item items left link links list module outer page panel right row section site the top wrap wrapper".split()
_STEMS = tuple(w[:-1] for w in _BOILER if w.endswith("*"))
_EXACT = frozenset(w for w in _BOILER if not w.endswith("*"))
_KNOWN = frozenset(_CONTENT + _LAYOUT)
#: What a name tells of which only a part is known, as side-effects, to what one tells that is known whole.
PARTLY = 0.25

FEATURES = ["one", "boiler", "content", "words", "linked", "sentence", "heading", "copyright", "depth"]
#: By feature: fitted by `python -m trailweave.llm.boilerplate` to the pages of sf0.1, rounded.
WEIGHTS = [2.47, -10.48, 2.08, 0.31, -10.0, 0.49, -1.07, -8.66, 0.92]
#: Ties: between neighbours of one parent, between other neighbours, and to the last block before of the same parent.
SIBLING, NEIGHBOUR, PARENT = 1.2, 0.3, 0.6


def _is_boiler(word: str) -> bool:
    return word in _EXACT or word.startswith(_STEMS)


#: Signs that were found before: a plain table, which travels to workers with the functions.
_SIGNS: dict[tuple[str, str], tuple[float, float, bool]] = {}


def own_signs(tag: str, attributes: str) -> tuple[float, float, bool]:
    """What an element tells of what is in it, as boilerplate and as content; whether it is never seen."""
    if (tag, attributes) not in _SIGNS:
        if len(_SIGNS) >= 20_000:
            _SIGNS.clear()
        _SIGNS[tag, attributes] = _signs(tag, attributes)
    return _SIGNS[tag, attributes]


def _signs(tag: str, attributes: str) -> tuple[float, float, bool]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()) is not None
    roles = found.get("role", "").lower().split()
    boiler = [1.0 for _ in BOILER_ROLES.intersection(roles)] + [1.0] * (tag in BOILER_TAGS)
    content = [1.0 for _ in CONTENT_ROLES.intersection(roles)] + [1.0] * (tag in CONTENT_TAGS)
    if tag not in ("html", "body"):
        names = re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}").lower()
        for name in names.split():
            parts = re.findall(r"[a-z]+", name)
            bad = [w for w in parts if _is_boiler(w)]
            whole = 1.0 if all(w in _KNOWN or _is_boiler(w) for w in parts) else PARTLY
            if bad:
                boiler.append(whole)
            elif any(w in _CONTENT for w in parts):
                content.append(whole)
    return max(boiler, default=0.0), max(content, default=0.0), unseen


@dataclass
class Block:
    """texts; how many of their characters are in links; what its place tells; its tag, parent and depth."""

    boiler: float
    content: float
    tag: str
    parent: int
    depth: int
    texts: list[str] = field(default_factory=list)
    linked: int = 0

    def features(self) -> list[float]:
        text = self.text
        letters = max(1, sum(not c.isspace() for c in text))
        return [
            1.0, self.boiler, self.content, math.log1p(text.count(" ") + 1), min(1.0, self.linked / letters),
            float(re.search(r"[.!?。！？…:;][\"\'”’»)\]]?(?:\s|$)", text) is not None), float(self.tag in _HEADINGS),
            float(re.match(r"(?:©|\(c\)|copyright\b)", text, re.I) is not None), math.log1p(self.depth),
        ]

    def odds(self) -> float:
        """The log-odds that the block is content."""
        return sum(w * x for w, x in zip(WEIGHTS, self.features(), strict=True))

    @property
    def text(self) -> str:
        return " ".join("".join(self.texts).split())


class _Open:
    """The open elements, and for each name where it is open, so that no tag has to look through them all."""

    def __init__(self) -> None:
        #: tag, number, signs of boilerplate and content, whether unseen.
        self.stack: list[tuple[str, int, float, float, bool]] = [("", 0, 0.0, 0.0, False)]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, names: Iterable[str]) -> int:
        """Where the innermost open element of these names is; 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def push(self, element: tuple[str, int, float, float, bool]) -> None:
        self.at.setdefault(element[0], []).append(len(self.stack))
        if element[0] in _BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def close(self, upto: int) -> bool:
        """Closes the elements from a place on; whether a block was among them."""
        some = False
        while len(self.stack) > upto:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in _BLOCKS:
                self.blocks.pop()
                some = True
        return some


#: Elements that end tags of no blocks don't reach out of.
_BARRIERS = ("td", "th", "table", "article", "nav", "aside", "footer", "main", "header")


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text that can be seen, in order."""
    opened = _Open()
    stack = opened.stack
    out: list[Block] = []
    current: Block | None = None
    number = 0

    def text(data: str) -> None:
        nonlocal current
        if not data or stack[-1][4]:
            return
        data = entities.unescape(data) if "&" in data else data
        if current is None:
            if data.isspace():
                return
            at = opened.blocks[-1] if opened.blocks else 0
            current = Block(stack[-1][2], stack[-1][3], stack[at][0], stack[max(0, at - 1)][1], len(opened.blocks))
            out.append(current)
        current.texts.append(data)
        if opened.at.get("a"):
            current.linked += sum(not c.isspace() for c in data)

    def close(upto: int) -> None:
        nonlocal current
        if opened.close(upto):
            current = None

    def ended_by(tag: str) -> None:
        if tag in _ENDS:
            ends, within = _ENDS[tag]
            barrier = opened.last(within)
            while (at := opened.last(ends)) > barrier:
                close(at)
                if tag != "tr":
                    break
        elif tag in _BLOCKS and opened.blocks and stack[opened.blocks[-1]][0] == "p":
            close(opened.blocks[-1])

    at = 0
    while found := _TOKEN.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        ending, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if ending:
            place = opened.last((tag,))
            if place and (tag in _BLOCKS or place > opened.last(_BARRIERS)):
                close(place)
            if tag in _BLOCKS:
                current = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag == "body":
            close(1)
        ended_by(tag)
        if tag in _BLOCKS:
            current = None
        if tag in _VOID:
            continue
        if tag == "a" and opened.at.get("a"):  # links don't nest
            close(opened.at["a"][-1])
        boiler, content, unseen = own_signs(tag, attributes or "")
        _, _, around, inside, hidden = stack[-1]
        if tag == "header" and inside > around and own_signs("div", attributes or "")[0] == 0:
            boiler = 0.0
        if boiler or content:
            # The nearest tells most; a content element in boilerplate tells little.
            boiler, content = boiler + 0.7 * around, content * (1.0 if around < 0.5 else 0.3) + 0.4 * inside
        else:
            boiler, content = around, inside
        number += 1
        opened.push((tag, number, boiler, content, unseen or tag in _UNSEEN or hidden))
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    text(page[at:])
    return [b for b in out if b.text]


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the side of positive odds, in the labelling of least cost: a node against its
    odds costs their size, a tie between the sides its weight. On equal cost, as few nodes as can be are."""
    n = len(odds)
    weight = [round(1000 * o) for o in odds]
    tied: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in ties:
        if a != b:
            tied[a][b] = tied[b][a] = tied[a].get(b, 0) + round(1000 * w)
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        v = todo.popleft()
        if side[v] is None and abs(weight[v]) > sum(tied[v].values()):
            side[v] = weight[v] > 0
            for u, w in tied[v].items():
                del tied[u][v]
                weight[u] += w if side[v] else -w
                todo.append(u)
            tied[v] = {}
    if None in side:
        _flow(weight, tied, side)
    return [bool(s) for s in side]


def _flow(weight: list[int], tied: list[dict[int, int]], side: list[bool | None]) -> None:
    """Decides the rest: maximum flow by blocking flows on levels, then what the source still reaches."""
    nodes = [v for v, s in enumerate(side) if s is None]
    source, sink = len(weight), len(weight) + 1
    left: dict[int, dict[int, int]] = {v: dict(tied[v]) for v in nodes}
    left[source] = {v: weight[v] for v in nodes if weight[v] > 0}
    left[sink] = {}
    for v in nodes:
        if weight[v] > 0:
            left[v][source] = 0
        elif weight[v] < 0:
            left[v][sink] = -weight[v]
            left[sink][v] = 0

    def levels() -> dict[int, int]:
        level, todo = {source: 0}, deque([source])
        while todo:
            v = todo.popleft()
            for u, w in left[v].items():
                if w > 0 and u not in level:
                    level[u] = level[v] + 1
                    todo.append(u)
        return level

    while sink in (level := levels()):
        onward = {v: iter([*left[v]]) for v in level}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                pushed = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                back = 0
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    left[a][b] -= pushed
                    left[b][a] = left[b].get(a, 0) + pushed
                    if not left[a][b] and not back:
                        back = k + 1
                del path[back:]
                # The saturated edge's first node is tried on with what it has not been through.
                continue
            for u in onward[v]:
                if left[v][u] > 0 and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                path.pop()
    reached = levels()
    for v in nodes:
        side[v] = v in reached


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks, one a line."""
    found = blocks(page or "")
    labels = labelled(found)
    return "\n".join(b.text for b, content in zip(found, labels, strict=True) if content)


def labelled(found: list[Block]) -> list[bool]:
    """For each block whether it is content, by the minimum cut of the page."""
    return minimum_cut([b.odds() for b in found], page_ties(found))


def page_ties(found: list[Block]) -> list[tuple[int, int, float]]:
    ties, last = [], {}
    for i, b in enumerate(found):
        if i:
            ties.append((i - 1, i, SIBLING if found[i - 1].parent == b.parent else NEIGHBOUR))
        if b.parent in last and last[b.parent] != i - 1:
            ties.append((last[b.parent], i, PARENT))
        last[b.parent] = i
    return ties


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html, ...).

    A null or empty html, and one without content, gives the empty text. Repeated rows are each extracted; null numbers
    and addresses are kept; a page of any length is read whole, in time that grows as it does; other columns are ignored,
    whatever their names; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
