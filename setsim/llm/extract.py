"""Main text of web pages by tree scoring.

A tolerant parser builds the page's tree. Paragraphs pass points for their length and
commas to the elements above them, fewer with each level, discounted by the share of their
text that is links. The element with the most points is the article; siblings of it with
enough points, and plain paragraphs beside it, are kept with it.

Menus, asides, forms and elements whose class or id says that they are such are left out,
but not against the text itself: a form, a header or an element that a class only hints at
stays if it holds half of the page's text or more, or heads an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements and of classes, by what they mean for extraction.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
DROPPED = frozenset(
    "script style head title noscript template iframe object embed svg canvas audio video map nav footer aside button select option textarea input label dialog menu".split()
)
#: Left out unless they hold the page's text or, for a header, stand in an article.
DOUBTFUL = frozenset("header form fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An opening element ends an open one of its own family, up to the element that bounds the family.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus foot footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promoted promotion related recommended reply replies respond rss share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola tags toolbar widget widgets alert".split()
)
#: Words that say nothing in a class beside unwanted ones; with any other word an unwanted one is only a hint.
NEUTRAL = frozenset("area bar block bottom box button center col column container content cta footer form group head header inner item left link links list main message nav outer page panel post posts right row section site slot text title top unit wrap wrapper".split())
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
GOOD = frozenset("article body content entry main page post story text".split())
WEIGHTS = {"article": 25, "main": 15, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "th": -5, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5}
LEAST_LENGTH = 25
COMMAS = re.compile("[,،、，]")

TOKEN = re.compile(r"<!--|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<[A-Za-z/][^<>]*>")
COMMENT_END = re.compile("--!?>|-->")
ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile("[^a-z0-9]+")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


#: Families of elements that end one another, and the elements that hide an open one; "p" is ended by all blocks.
SCOPES = {"p": ({"p"}, {"table", "td", "th", "button", "object", "article", "section", "div", "li"}), "li": ENDS["li"], "dt": ENDS["dt"], "tr": ENDS["tr"], "td": ENDS["td"], "option": ENDS["option"]}
FAMILY = {"dd": "dt", "th": "td"}
NO_SCOPE = dict.fromkeys(SCOPES)
SCOPED = frozenset(t for ends, within in SCOPES.values() for t in ends | within)


class Element:
    """An element with its children and text pieces in order, and what scoring finds out about it.

    `block` is the nearest element above that is no inline one, `open` the nearest open
    element of each family that a new element might end.
    """

    __slots__ = ("tag", "parent", "block", "open", "content", "dropped", "doubtful", "weight", "score", "chars", "linked", "commas", "candidate")

    def __init__(self, tag: str, parent: "Element | None", attrs: str) -> None:
        self.tag, self.parent, self.content = tag, parent, []
        self.block = parent if parent is None or parent.tag not in INLINE else parent.block
        self.open = NO_SCOPE if parent is None else parent.open
        if tag in SCOPED:
            self.open = {f: self if tag in ends else None if tag in within else self.open[f] for f, (ends, within) in SCOPES.items()}
        self.score = self.chars = self.linked = self.commas = 0
        self.candidate = False
        self.weight, self.dropped, self.doubtful = WEIGHTS.get(tag, 0), tag in DROPPED, tag in DOUBTFUL
        if attrs and not attrs.isspace():
            self.look_at(attrs)

    def look_at(self, attrs: str) -> None:
        for name, value in ATTR.findall(attrs):
            name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
            if name in ("class", "id"):
                for word in value.split():
                    parts = {x for x in NAME_PARTS.split(word) if x and not x.isdigit()}
                    if parts & UNWANTED and self.tag not in ("html", "body", "article", "main"):
                        if parts <= UNWANTED | NEUTRAL:
                            self.dropped = True
                        else:
                            self.doubtful = True
                    if parts & GOOD:
                        self.weight += 10
                if self.tag == "article" and any(set(NAME_PARTS.split(w)) <= UNWANTED | NEUTRAL and set(NAME_PARTS.split(w)) & UNWANTED for w in value.split()):
                    self.dropped = True
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in UNWANTED_ROLES) or (name == "style" and INVISIBLE.search(value)):
                self.dropped = True
            elif name == "role" and value in ("main", "article"):
                self.weight += 15


def parse(page: str) -> Element:
    """The page's tree; unclosed, misnested and truncated markup all give some tree, in linear time."""
    root = Element("#root", None, "")
    here, at = root, 0
    is_open: Counter[str] = Counter()

    def leave(e: Element) -> Element:
        """Closes elements up to and including e."""
        nonlocal here
        while here is not e:
            is_open[here.tag] -= 1
            here = here.parent
        is_open[e.tag] -= 1
        return e.parent

    while m := TOKEN.search(page, at):
        if m.start() > at:
            here.content.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = COMMENT_END.search(page, max(at - 2, 0))
            at = end.end() if end and end.end() > at else (len(page) if not end else at)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if is_open[tag] > 0:
                there = here
                while there.tag != tag:
                    there = there.parent
                here = leave(there)
            elif tag in ("p", "br"):
                here.content.append(Element("br", here, ""))
            continue
        if tag in CLOSES_P and here.open["p"] is not None:
            here = leave(here.open["p"])
        if tag in ENDS and (old := here.open[FAMILY.get(tag, tag)]) is not None:
            here = leave(old)
        new = Element(tag, here, m["attrs"] or "")
        here.content.append(new)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m["attrs"] or "").endswith("/"):
            is_open[tag] += 1
            here = new
    here.content.append(page[at:])
    return root


def elements(top: Element) -> list[Element]:
    """All kept elements below and including top, each after its parent."""
    out, stack = [], [top]
    while stack:
        e = stack.pop()
        if not e.dropped:
            out.append(e)
            stack += [c for c in reversed(e.content) if type(c) is Element]
    return out


def measure(kept: list[Element]) -> None:
    """Characters, linked characters and commas of each element, its children included."""
    for e in kept:
        for c in e.content:
            if type(c) is str:
                text = c.strip()
                e.chars += len(text)
                e.commas += len(COMMAS.findall(text))
    for e in reversed(kept):
        if e.tag == "a":
            e.linked = e.chars
        if (p := e.parent) is not None:
            p.chars, p.linked, p.commas = p.chars + e.chars, p.linked + e.linked, p.commas + e.commas


def settle(kept: list[Element]) -> list[Element]:
    """Leaves out the doubtful elements that neither head an article nor hold half of the page's text; takes their text off the counts."""
    whole = kept[0].chars - kept[0].linked
    out, gone = [], set()
    for e in kept:  # parents come first
        if e.parent in gone:
            gone.add(e)
            continue
        if e.doubtful and not (e.tag == "header" and in_article(e)) and 2 * (e.chars - e.linked) < whole:
            e.dropped = True
            gone.add(e)
            continue
        out.append(e)
    for e in kept:
        e.chars = e.linked = e.commas = 0
    measure(out)
    return out


def in_article(e: Element) -> bool:
    above = e.parent
    for _ in range(4):
        if above is None:
            return False
        if above.tag == "article":
            return True
        above = above.parent
    return False


def pass_points(kept: list[Element]) -> None:
    for e in kept:
        own = sum(len(c.strip()) for c in e.content if type(c) is str)
        if (e.tag in PARAGRAPHS or (e.tag in ("div", "section", "article", "main", "body") and own >= LEAST_LENGTH)) and e.chars >= LEAST_LENGTH:
            points = (1 + e.commas + min(e.chars / 100, 3)) * (1 - e.linked / e.chars)
            above = e if e.tag not in PARAGRAPHS else e.block
            for share in (1, 2, 6, 9, 12, 15):
                if above is None:
                    break
                if not above.candidate:
                    above.candidate, above.score = True, above.score + above.weight
                above.score += points / share
                above = above.block


def blocks(top: Element) -> list[str]:
    """Texts of the blocks below top in page order; inline elements do not end a block."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = [top]
    while stack:
        c = stack.pop()
        if type(c) is str:
            line.append(c)
        elif c is None:
            end()
        elif not c.dropped:
            if c.tag not in INLINE:
                end()
                stack.append(None)
            stack += reversed(c.content)
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as one line; empty for a null, empty or textless page."""
    if not page:
        return ""
    root = parse(page)
    kept = elements(root)
    measure(kept)
    kept = settle(kept)
    pass_points(kept)
    density = lambda e: e.linked / e.chars if e.chars else 0.0
    best = max((e for e in kept if e.candidate), key=lambda e: e.score * (1 - density(e)), default=None)
    if best is None:  # no paragraph is long enough to score
        best = next((e for t in ("article", "main", "body") for e in kept if e.tag == t and e.chars), root)
    outer = best.parent
    while outer is not None and outer.tag in INLINE:
        best, outer = outer, outer.parent
    if outer is None or best.tag in ("main", "body", "html"):
        chosen = [best]
    else:
        least = max(10.0, 0.2 * best.score)
        chosen = []
        for e in outer.content:
            if e is best or type(e) is Element and not e.dropped and ((e.candidate and e.score * (1 - density(e)) >= least) or (e.tag == "p" and e.chars >= 80 and density(e) < 0.25) or (e.tag in ("h1", "h2", "h3") and not e.linked)):
                chosen.append(e)
    return " ".join(b for e in chosen for b in blocks(e))


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """Replaces the html column by text and n_chars; one row per input row, repeated rows included.

    A null, empty or textless page has an empty text. Columns named text or n_chars in the
    input are replaced.
    """
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    schema = pages.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(page)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(*rest, page).mapInArrow(run, schema)
