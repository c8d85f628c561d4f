"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Scripts, styles, heads, forms, menus and
elements whose tag, role, class or id names them as boilerplate are left out. Inside an
article only names that can hardly mean anything else count, so a heading in a header, a
section named discussion, or a paragraph named social-policy stays.

Pass one, by stop-word density, length and link density, for every block: one that is mostly
links is bad; a long one is good with many stop words, bad with next to none, near good in
between; a short one is not decided. Inside an article a long block with some stop words is
good, and one with next to none (a table, code, another language) near good.
Then the page's article mark (or main part) is held against the labels: it counts unless
nothing inside is good and much more outside is. If it counts, only what lies inside is looked at.
Pass two: a block that is not decided takes the label of its nearest decided neighbours; if
they differ, a near good block is good, and so is a short one inside an article; another
short one takes the nearer neighbour's. Beyond the ends of an article lies good text, beyond
those of a page bad text.

White space, any that Unicode calls so, becomes one space inside a block. A single <br> is
white space, two or more in a row end a block. Null and empty pages have no text. Pages are
handled row by row whatever their ids; other columns are ignored. Time is in proportion to a
page's length, whatever is broken in it: a tag with a quote that never ends is taken to end
at the next >, as are all behind it.
"""

from __future__ import annotations

import html
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 70
LONG = 200
MAX_LINKS = 0.5
STOP_LOW, STOP_HIGH = 0.08, 0.16

STOP_WORDS = frozenset(
    "the of and to in is that it for on was as with be by are this at from a an or not "
    "de la le les et des un une du que en pour dans est sur qui pas au avec ce par il se "
    "der die das und den von mit zu ist nicht ein auf dem sich im als auch es eine war "
    "el los las y por con no una su para al lo del como más pero".split()
)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes svg math object canvas audio video select".split())
FOREIGN = frozenset("svg math".split())
#: Left out with all that they hold.
DROPPED = frozenset("head nav aside form button dialog footer menu label fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Class or id names, or parts of them, that say the same.
STRONG_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner promo promoted promotion sponsor sponsored "
    "sidebar sidebars widget widgets navbar nav navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr "
    "popup modal newsletter subscribe subscription signup comment comments disqus respond replies share sharing social "
    "related recommended teaser teasers pagination pager".split()
)
#: Parts that say so outside an article.
HINTS = STRONG_HINTS | frozenset("rail menu masthead topbar header notice notices alert overlay login reply discussion copyright disclaimer skip hidden".split())
#: Words that say nothing of what a name is about. Inside an article a name says boilerplate if nothing else is in it.
NEUTRAL = frozenset(
    "area article articles bar block blocks body bottom box btn button buttons card cards col column container content count entry extra feed form grid group icons id info inline inner "
    "item items js layout left link links list main mobile module more outer panel post posts right row section slot small space story stories tools top unit widget widgets wrap wrapper zone".split()
)
#: These name parts of an article too.
OF_ARTICLES = frozenset("header masthead topbar discussion".split())
#: An article of these kinds is not the page's.
MINOR_ARTICLES = frozenset("comment comments reply teaser related ad promo".split())
#: An article that starts inside one of these is still the article: the tag was not closed.
LEAKY = frozenset("head nav form footer menu header button label fieldset".split())
#: An end tag of another kind does not end what lies around the article that it is in.
OUTER = frozenset("article main body html".split())
#: A mark without good text inside is passed over if so many times its text is good outside.
MUCH_MORE = 4

_OPEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: Signs that may stand at the edge of a word.
_SIGNS = string.punctuation + "“”„‘’«»‹›¿¡…–—"


@dataclass
class Block:
    text: str
    links: int
    tag: str
    inside: bool
    label: str = "short"


@dataclass
class _Page:
    """What is gathered while the tags of a page go by."""

    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    tag: str = ""
    breaks: int = 0

    def end_block(self, inside: bool) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, len(" ".join("".join(self.linked).split())), self.tag, inside))
        self.parts, self.linked, self.breaks = [], [], 0


def _attributes(rest: str) -> dict[str, str]:
    """Those of class, id, role, hidden and aria-hidden that a tag has."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(rest):
        if name.lower() in ("class", "id", "role", "hidden", "aria-hidden"):
            found.setdefault(name.lower(), "".join(values))
    return found


def _names(attributes: dict[str, str]) -> list[str]:
    return [n for k in ("class", "id") for n in attributes.get(k, "").split()]


def _parts(names: list[str]) -> set[str]:
    return {p.lower() for n in names for p in _NAME_PART.findall(n)}


def _boilerplate(tag: str, rest: str, inside: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not rest or tag in ("html", "body", "main"):
        return False
    attributes = _attributes(rest)
    names = _names(attributes)
    if tag == "article":
        return bool(_parts(names) & MINOR_ARTICLES)
    if attributes.get("role", "").lower() in DROPPED_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if not inside:
        return bool(_parts(names) & HINTS)
    return any(_says_boilerplate(n) for n in names)


def _says_boilerplate(name: str) -> bool:
    """Of an element inside an article: `share-buttons` does, `social-policy` and `related-work` may be what it is about."""
    if name.lower() in HINTS - OF_ARTICLES:
        return True
    parts = _parts([name])
    return bool(parts & STRONG_HINTS) and parts <= STRONG_HINTS | NEUTRAL


class _Stack:
    """Open elements, with what is asked of them kept up to date, so nothing is ever searched for."""

    def __init__(self):
        self.tags: list[tuple[str, bool, bool]] = []  # tag, left out, marks an article
        self.blocks: list[int] = []
        self.dropped: list[int] = []
        self.links = self.inside = 0
        #: How many of each tag are open: in all, and since each article began.
        self.open: list[Counter[str]] = [Counter()]
        self.total: Counter[str] = Counter()

    def push(self, tag: str, drop: bool, marks: bool) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.tags))
        if drop:
            self.dropped.append(len(self.tags))
        self.tags.append((tag, drop, marks))
        self.links += tag == "a"
        self.inside += marks
        self.total[tag] += 1
        if marks:
            self.open.append(Counter())
        else:
            self.open[-1][tag] += 1

    def pop(self) -> str:
        tag, drop, marks = self.tags.pop()
        if drop:
            self.dropped.pop()
        if tag in BLOCKS:
            self.blocks.pop()
        self.links -= tag == "a"
        self.inside -= marks
        self.total[tag] -= 1
        if marks:
            self.open.pop()
        else:
            self.open[-1][tag] -= 1
        return tag

    def cut(self, upto: int) -> None:
        while len(self.tags) > upto:
            self.pop()

    def close(self, tag: str) -> None:
        if (self.total if tag in OUTER else self.open[-1])[tag]:
            while self.pop() != tag:
                pass

    def begin_block(self, tag: str) -> None:
        """A block ends an open paragraph, and an item the one before it."""
        if self.blocks and self.tags[self.blocks[-1]][0] == "p":
            self.cut(self.blocks[-1])
        if tag == "li":
            for k in range(len(self.tags) - 1, max(len(self.tags) - 4, -1), -1):
                if self.tags[k][0] == "li":
                    self.cut(k)
                    break


def _tags(source: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag, is it an end, attributes) of each tag, and the text behind the last.

    Comments and declarations have no tag name. What raw elements hold is passed over.
    """
    at, careful, last = 0, True, source.rfind(">")
    while m := _OPEN.search(source, at):
        if m[0] == "<!--":
            end = source.find("-->", m.end())
            yield source[at : m.start()], "", False, ""
            at = len(source) if end < 0 else end + 3
            continue
        if m.start() > last:
            break  # nothing is closed any more
        rest = _REST.match(source, m.end()) if careful and m[2] else None
        careful = careful and (not m[2] or rest is not None)
        end = rest.end() if rest else source.index(">", m.end()) + 1
        tag, ends, given = (m[2] or "").lower(), bool(m[1]), source[m.end() : end - 1]
        yield source[at : m.start()], tag, ends, given
        at = end
        # a slash at the end closes foreign elements; of others HTML takes no notice of it
        if tag in RAW and not ends and not (tag in FOREIGN and given.rstrip().endswith("/")):
            close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
            end = source.find(">", close.end()) if close else -1
            at = len(source) if end < 0 else end + 1
    yield source[at:], "", False, ""


def cut(source: str) -> list[Block]:
    """The blocks of a page that its own names leave in, in page order."""
    page, stack = _Page(), _Stack()

    def put(text: str) -> None:
        if stack.dropped or not text:
            return
        text = html.unescape(text)
        if text.strip():
            page.breaks = 0
        page.parts.append(text)
        if stack.links:
            page.linked.append(text)

    for text, tag, ends, rest in _tags(source):
        put(text)
        if not tag or (tag in RAW and not ends):
            continue
        if ends:
            if tag in BLOCKS:
                page.end_block(stack.inside > 0)
            stack.close(tag)
            continue
        if tag == "br":
            page.breaks += 1
            put(" ")
            if page.breaks > 1:
                page.end_block(stack.inside > 0)
            continue
        if tag in ("td", "th"):
            put(" ")
        if tag in BLOCKS:
            page.end_block(stack.inside > 0)
            page.tag = tag
            stack.begin_block(tag)
        if tag in VOID:
            continue
        if tag in ("body", "article", "main") and stack.dropped and stack.tags[stack.dropped[0]][0] in LEAKY:
            stack.cut(stack.dropped[0])
        drop = _boilerplate(tag, rest, stack.inside > 0)
        stack.push(tag, drop, tag in ("article", "main") and not drop and not stack.dropped)
    page.end_block(stack.inside > 0)
    return page.blocks


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w in STOP_WORDS or w.strip(_SIGNS) in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(blocks: list[Block]) -> None:
    """Pass one."""
    for b in blocks:
        if b.links > MAX_LINKS * len(b.text):
            b.label = "bad"
        elif len(b.text) < SHORT:
            b.label = "short"
        else:
            density = stop_density(b.text)
            if density >= STOP_LOW if b.inside else density >= STOP_HIGH and len(b.text) >= LONG:
                b.label = "good"
            else:
                b.label = "bad" if density < STOP_LOW and not b.inside else "near"


def confirmed(blocks: list[Block]) -> bool:
    """Whether what the page marks as its article can be that."""
    inside = [b for b in blocks if b.inside]
    found = sum(len(b.text) for b in inside)
    outside = sum(len(b.text) for b in blocks if not b.inside and b.label == "good")
    return bool(inside) and (outside <= MUCH_MORE * found or any(b.label == "good" for b in inside))


def inherit(blocks: list[Block], marked: bool) -> None:
    """Pass two."""
    edge = "good" if marked else "bad"
    decided = [i for i, b in enumerate(blocks) if b.label in ("good", "bad")]
    before, k = -1, 0
    for i, b in enumerate(blocks):
        if b.label in ("good", "bad"):
            before, k = i, k + 1
            continue
        after = decided[k] if k < len(decided) else len(blocks)
        left = blocks[before].label if before >= 0 else edge
        right = blocks[after].label if after < len(blocks) else edge
        if left == right:
            label = left
        elif b.label == "near" or marked:
            label = "good"
        else:
            label = left if i - before < after - i else right
        b.label = f"{label} by neighbours"


def main_text(source: str | None) -> str:
    blocks = cut(source or "")
    classify(blocks)
    marked = confirmed(blocks)
    blocks = [b for b in blocks if b.inside] if marked else blocks
    inherit(blocks, marked)
    if not marked:  # a heading right above good text goes with it
        for b, below in zip(blocks, blocks[1:], strict=False):
            if b.tag in ("h1", "h2", "h3") and not b.links and below.label.startswith("good"):
                b.label = "good by heading"
    return "\n".join(b.text for b in blocks if b.label.startswith("good"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page; n_chars are code points."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(read, "page_id long, url string, text string, n_chars long")
