"""Main text of web pages (operator 3): the maximum-scoring run of words and tags.

A page is read as a sequence of blocks. Words score by the kind of block they stand in (its tag, whether they are
link text, whether an ancestor is a menu, footer, advert ...), tags score negative; the weights are log odds of lying
inside the main text, counted on labelled pages: a bounded sample (``fit_rows``) of pages that mark their main
element themselves. One linear scan finds the contiguous region with the largest sum. Blocks inside it that belong to
menus, adverts, forms, comments and the like are left out at no cost; everything else there is kept.

What belongs to the page's frame: content of nav, aside, footer, menu and search elements, of forms and dialogs, of
headers outside the main element (an article's own header is part of it), and of elements whose class, id or role says
so. Class words that articles use as well (``DOUBTFUL``) only tell outside the main element, or where most of the block
is link text, and labelled pages overrule them. An article or main element is not frame because it stands in a form, a
dialog or an element with a class of the page's layout; where all text of a page stands in such, that counts as none.

Reading takes time in proportion to the page: what is open is kept as running state, and what can't end (a quoted
value, a tag) is looked for once.

Defined cases: a null or empty page, and one without a block that scores above zero, has the empty text; markup may be
broken (unclosed or crossed elements, a lone "<"; a comment without an end reaches to the end of the page); without
labelled pages fixed default weights are used; repeated rows get equal results; an empty table gives an empty one; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import slices, texts_of

# Element names by how they are read.
#: Their content is never text of the page.
HIDDEN = frozenset("head script style noscript template svg math iframe object embed canvas audio video select option textarea button datalist map applet frameset".split())
#: Their content is plain characters up to the end tag.
RAW = frozenset("script style textarea noscript iframe template xmp noembed noframes title".split())
#: They have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: They begin and end blocks.
BLOCK = frozenset("html body article section nav aside header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary hr center dialog menu search hgroup".split())
#: Elements of the page's frame, wherever they stand.
FRAME = frozenset("nav aside footer menu search".split())
#: Frame as well, but an article or main element inside them is none.
WRAPPERS = frozenset("form fieldset dialog".split())
#: A page marks its main text by these.
MAIN = frozenset(["article", "main"])
#: Parts of class names, ids and roles that mark what is not main text; an article or main element inside is none either.
SURE_INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|comments?|commentlist|discussion|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Parts that mark what is not main text, unless an article or main element stands inside.
SURE = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|breadcrumbs?|masthead|footer|share|sharing|social|cookie\w*|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe\w*|signup|login|toolbar|pagination|pager|"
    r"copyright|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Parts that articles use as well.
DOUBTFUL = re.compile(r"(?:^|[\s_-])(header|banner|side|widget\w*|related|recommend\w*|overlay|search\w*|legal|complementary)(?:$|[\s_-])", re.I)
#: Class names that only say whether a page has such a part.
LAYOUT = re.compile(r"\b(?:has|no|with|without|hide|show|is)[-_][\w-]+", re.I)
#: Default log odds of a word by its kind, and of any tag, where labelled pages say nothing.
DEFAULT_WORD = {"frame": -3.0, "link": -1.5, "item": 0.4, "text": 1.0, "head": 0.6}
DEFAULT_TAG = -0.2
#: What a word gains by standing in a main element, whatever its kind.
MAIN_BONUS = 1.5
#: Words that text in forms and such must have to count as main text, on a page without other.
LEAST_WRAPPED = 30

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
VALUE = re.compile(r">|=\s*([\"'])")
COMMENT_END = re.compile(r"--!?>")
UNQUOTED_SLASH = re.compile(r"=[^\s\"'=]*/$")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Block:
    """A block of text with what the scan needs: its kind, what it stands in, its words, its link words, the tags before it."""

    __slots__ = ("doubt", "frame", "kind", "link_words", "main", "parts", "tags", "text", "words")

    def __init__(self, place: Place, tags: list[str]):
        self.kind, self.frame, self.doubt, self.main = place.kind, place.frame, place.doubt, place.main
        self.tags, self.parts, self.link_words, self.text, self.words = tags, [], 0, "", 0


class Place(NamedTuple):
    """What an open element and its ancestors say about text in it."""

    name: str = ""
    kind: str = "text"  # head, item or text
    frame: str = ""  # "": none; "wrapped": frame, unless a main element stands inside; "sure"
    doubt: str = ""  # a doubtful class word
    main: bool = False


def class_marks(attributes: str) -> tuple[str, str]:
    """(frame, doubt) that the class, id and role of an element tell."""
    frame, doubt = "", ""
    for found in ATTRIBUTE.findall(attributes):
        value = LAYOUT.sub(" ", found[0] or found[1] or found[2])
        if SURE_INSIDE.search(value):
            return "sure", ""
        if SURE.search(value):
            frame = "wrapped"
        elif m := DOUBTFUL.search(value):
            doubt = m[1].lower()
    return frame, doubt


_short_marks = lru_cache(1 << 14)(class_marks)


def inner(place: Place, name: str, attributes: str) -> Place:
    """The place inside a new element."""
    kind, frame, doubt, main = place.kind, place.frame, place.doubt, place.main
    if name in BLOCK:
        kind = "head" if name[0] == "h" and name[1:].isdigit() else "item" if name in ("li", "td", "th", "dt", "dd") else "text"
    if name in MAIN:
        if frame != "sure":
            frame = doubt = ""
        return Place(name, kind, frame, doubt, True)
    if name in FRAME:
        frame = "sure"
    elif (name in WRAPPERS or name == "header" and not main) and not frame:
        frame = "wrapped"
    if attributes and name not in ("html", "body"):
        of_class, new_doubt = _short_marks(attributes) if len(attributes) < 256 else class_marks(attributes)
        frame = "sure" if "sure" in (frame, of_class) else frame or of_class
        doubt = doubt or ("" if new_doubt == "header" and main else new_doubt)
    return Place(name, kind, frame, doubt, main)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in its order; empty blocks only pass their tags on."""
    out: list[Block] = []
    stack: list[Place] = [Place()]
    opened: Counter = Counter()  # open elements by name
    blocks: list[int] = []  # places of open BLOCK elements on the stack
    lists: list[int] = []  # and of open lists and their items
    block: Block | None = None
    tags: list[str] = []
    hidden = links = 0
    at, n = 0, len(page)
    last = page.rfind(">")  # beyond it no tag can end
    quotes = True  # False once a quoted value had no end: from there on a tag ends at the next ">"

    def close() -> None:
        nonlocal block, tags
        if block is not None:
            text = " ".join(html.unescape("".join(block.parts)).split())
            if text:
                block.text, block.words, block.parts = text, text.count(" ") + 1, []
                out.append(block)
            else:
                block.tags += tags
                tags = block.tags
        block = None

    def characters(text: str) -> None:
        nonlocal block, tags
        if hidden or not text:
            return
        if block is None:
            if text.isspace():
                return
            block, tags = Block(stack[-1], tags), []
        block.parts.append(text)
        if links:
            block.link_words += len(text.split())

    def pop_to(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            name = stack.pop().name
            opened[name] -= 1
            hidden -= name in HIDDEN
            links -= name == "a"
        while blocks and blocks[-1] >= depth:
            blocks.pop()
        while lists and lists[-1] >= depth:
            lists.pop()

    def tag_end(start: int) -> int:
        """Where the tag whose attributes begin at ``start`` has its ">"."""
        nonlocal quotes
        where = start
        while quotes:
            m = VALUE.search(page, where)
            if m is None:
                break
            if m[1] is None:
                return m.start()
            where = page.find(m[1], m.end()) + 1
            if not where:
                break
        quotes = False
        return page.find(">", start)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            characters(page[at:])
            break
        if lt > at:
            characters(page[at:lt])
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):
                at = page.index(">", lt) + 1
            else:
                m = COMMENT_END.search(page, lt + 4)
                at = m.end() if m else n
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            characters(page[lt + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if lt > last:  # no tag any more
            if page.startswith(("<!", "<?"), lt):
                break
            characters(page[lt:])
            break
        if page.startswith(("<!", "<?"), lt):
            at = page.index(">", lt) + 1
            continue
        m = NAME.match(page, lt)
        end = tag_end(m.end()) if m else -1
        if end < 0:
            characters("<")
            at = lt + 1
            continue
        at = end + 1
        attributes = page[m.end() : end]
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            close()
        elif name == "br":
            characters(" ") if block is not None else None
        if not hidden:
            tags.append(name)
        if closing:
            if opened[name]:
                while stack[-1].name != name:
                    pop_to(len(stack) - 1)
                pop_to(len(stack) - 1)
            continue
        if name in VOID or attributes.endswith("/") and not UNQUOTED_SLASH.search(attributes):
            continue
        if name in BLOCK and blocks and stack[blocks[-1]].name == "p":  # a block ends an open paragraph
            pop_to(blocks[-1])
        if name == "li" and lists and stack[lists[-1]].name == "li":
            pop_to(lists[-1])
        if name in RAW:
            if name not in _RAW_ENDS:
                _RAW_ENDS[name] = re.compile(rf"</{name}\s*[^>]*>", re.I)
            found = _RAW_ENDS[name].search(page, at)
            if name not in HIDDEN and name != "title" and not hidden:
                characters(page[at : found.start() if found else n])
            at = found.end() if found else n
            continue
        if name == "body" and hidden:  # an unclosed head ends where the body begins
            pop_to(1)
        if name in BLOCK:
            blocks.append(len(stack))
        if name in ("ul", "ol", "menu", "li"):
            lists.append(len(stack))
        stack.append(inner(stack[-1], name, attributes))
        opened[name] += 1
        hidden += name in HIDDEN
        links += name == "a"
    close()
    return out


_RAW_ENDS: dict[str, re.Pattern] = {}


class Weights:
    """Log odds of words by kind, of tags by name, and of words under a doubtful class word."""

    def __init__(self, counts: dict[tuple[str, str], tuple[int, int]] | None = None, limit: float = 3.0, smooth: float = 5.0):
        self.word, self.tag, self.doubt = dict(DEFAULT_WORD), {}, {}
        for (sort, name), (inside, outside) in (counts or {}).items():
            odds = max(-limit, min(limit, math.log((inside + smooth) / (outside + smooth))))
            if sort == "word":
                self.word[name] = odds
            elif sort == "doubt":
                self.doubt[name] = odds
            else:
                self.tag[name] = min(-0.02, max(-1.0, odds))  # tags are never evidence for text

    def leaves_out(self, b: Block, wrapped: bool = True) -> bool:
        """Whether a block is of the page's frame; ``wrapped``: forms and doubtful class words say so too."""
        if b.frame == "sure" or b.frame and wrapped:
            return True
        if not b.doubt or not wrapped:
            return False
        if b.main and 2 * b.link_words < b.words:
            return False
        return self.doubt.get(b.doubt, -1.0) <= 0

    def block(self, b: Block, left_out: bool) -> float:
        if left_out:  # left out of the text anyway: what is amid an article must not cut it in two
            return 0.0 if b.main else self.word["frame"] * min(b.words, 2)
        bonus = MAIN_BONUS if b.main else 0.0
        own = self.word[b.kind] + bonus
        link = min(self.word["link"] + bonus, own)
        return own * (b.words - b.link_words) + link * b.link_words if b.link_words <= b.words else link * b.words

    def gap(self, b: Block) -> float:
        return sum(self.tag.get(t, DEFAULT_TAG) for t in b.tags)


def best_run(scores: list[float], gaps: list[float]) -> tuple[int, int]:
    """The contiguous blocks [i, j) with the largest sum; a gap counts between two blocks of the run."""
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (score, gap) in enumerate(zip(scores, gaps)):
        if run + gap > 0 and i > start:
            run += gap + score
        else:
            run, start = score, i
        if run > best:
            best, at = run, (start, i + 1)
        if run <= 0:
            run, start = 0.0, i + 1
    return at


def main_text(page: str, weights: Weights) -> str:
    blocks = blocks_of(page)
    gaps = [weights.gap(b) for b in blocks]
    for wrapped in (True, False):
        out = [weights.leaves_out(b, wrapped) for b in blocks]
        i, j = best_run([weights.block(b, x) for b, x in zip(blocks, out)], gaps)
        kept = [b for b, x in zip(blocks[i:j], out[i:j]) if not x]
        if kept and (wrapped or sum(b.words for b in kept) >= LEAST_WRAPPED):
            return "\n\n".join(b.text for b in kept)
    return ""


def page_counts(page: str) -> Counter:
    """Words and tags inside and outside the main element of a page that marks one; else nothing."""
    blocks = blocks_of(page)
    out: Counter = Counter()
    if not any(b.main for b in blocks):
        return out
    for b in blocks:
        inside = b.main and not b.frame
        out["word", "frame" if b.frame else b.kind, inside] += b.words - min(b.words, b.link_words)
        out["word", "link", inside] += b.link_words
        if b.doubt:
            out["doubt", b.doubt, inside] += b.words
        for t in b.tags:
            out["tag", t, inside] += 1
    return out


def fit_weights(pages: DataFrame, fit_rows: int = 2000, id_col: str = "page_id", html_col: str = "html") -> Weights:
    """Count on at most about ``fit_rows`` pages; what comes back is a number for each kind and tag name of the sample."""
    n = pages.count()
    taken = pages.filter(F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col)), F.lit(1_000_000)) < int(min(1.0, fit_rows / max(n, 1)) * 1_000_000))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in slices(batches, html_col):
            for page in texts_of(part, html_col).to_pylist():
                total.update(page_counts(page))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["sort", "name", "inside", "n"])

    rows = taken.select(html_col).mapInArrow(counted, "sort string, name string, inside boolean, n long").groupBy("sort", "name").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("b"))
    return Weights({(r.sort, r.name): (r.a, r.b) for r in rows.collect()})


def extract_text(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page; a narrow step."""
    weights = fit_weights(pages, id_col=id_col, html_col=html_col) if weights is None else weights
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_col):
            texts = [main_text(page, weights) for page in texts_of(part, html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(extracted, f"`{id_col}` {id_type}, `{url_col}` {url_type}, text string, n_chars long")
