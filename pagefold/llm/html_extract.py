"""Main text of web pages as a maximum-scoring run of markup.

A page is cut into tags and pieces of text. Words score positive where labelled pages have
content and tags negative where they have boilerplate: a token's weight is the log ratio of
how often its feature stands inside and outside the article of labelled pages (pages that
mark their article themselves), clipped, with plain defaults for what no labelled page
shows. Pages that mark no article take the default for words and no less than it for tags. A
word's feature is its nearest section-like ancestor, a tag's its name and the same. One
linear scan finds the contiguous run with the largest sum; that is the content region.
Inside it, parts that are by their own markup not article text are left out (menus, forms,
asides, scripts, adverts, comments and the like); between the first and the last word of a
marked article, and anywhere in a page that marks none, they weigh nothing, so the run passes
over them whatever their length.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined in page order by one newline.

The weights are sums over all labelled pages, made in Spark and hashed into a fixed number
of features; only those weights reach the driver and the tasks.

Defined results: null and empty html give an empty text; a page without words gives one as
well; unclosed tags, comments, scripts, styles, textareas and titles end with the page, after other unclosed raw
elements reading goes on; a formula's text stays; repeated rows give equal texts;
without any labelled page the default weights are used; columns named like the new ones are
replaced.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Markup pieces: comment, declaration, tag; a tag's quotes may hide a closing bracket.
MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: Elements, fixed values of HTML.
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes svg title".split())
#: These end with the page if nothing ends them; after any other unclosed raw element reading goes on behind its tag.
TO_THE_END = frozenset("script style textarea title".split())
#: A formula's tags neither weigh nor part its text, but for these that end a cell or the shown formula.
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup "
                 "msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation "
                 "annotation-xml".split())
MATH_PARTS = frozenset("mtr mlabeledtr mtd annotation annotation-xml".split())
UNQUOTED_END = re.compile(r"""=\s*[^\s"'=<>`]+/\Z""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ARTICLE = ("article", "main")
SECTIONS = frozenset("article main nav header footer aside form body head".split())
NOT_TEXT = frozenset("nav aside footer form head button select option dialog menu".split()) | RAW
#: Names of classes, ids and roles that say what a part is, fixed values. A name counts by itself or with other such names
#: and words for a box (ad-slot, cookie-banner, related-posts), not as a part of any other (has-sidebar, entry-header).
SURE = r"(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|comments?|replies|disqus)"
NAMES = (r"(?:banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|alert|popup|"
         r"modal|newsletter|subscribe|related|recommended|share|sharing|social|widget)")
BOX = r"(?:box|slot|unit|block|bar|container|wrapper|section|area|list|links?|buttons?|items?|posts?|form|\d+)"
HINT = re.compile(rf"(?:{SURE}|{NAMES})(?:[_-]+(?:{SURE}|{NAMES}|{BOX}))*", re.I)
SURELY = re.compile(rf"{SURE}(?:[_-]|$)", re.I)
#: Inside an article these name its own head.
HEADS = re.compile(r"(?:header|masthead)(?:[_-]|$)", re.I)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
FEATURES = 1 << 16
CLIP = 4.0
WORD, TAG = 0.5, -1.0


def tokens(page: str):
    """('text', raw text) and ('tag', name, closing, attributes) in page order; contents of raw elements are left out."""
    at, n = 0, len(page)
    missing: set[str] = set()
    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            yield "text", page[at:], False, ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], False, ""
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1] or m[4])
        yield "tag", name, closing, m[3] or m[6] or ""
        if name in RAW and not closing:
            end = _raw_end(page, at, name, m[3] or m[6] or "", missing)
            at = end if end is not None else n if name in TO_THE_END else at


def _raw_end(page: str, at: int, name: str, attributes: str, missing: set[str]) -> int | None:
    """Where the contents end of a raw element whose tag ends at ``at``; None if nothing ends it. ``missing`` keeps the names
    that have no end tag further on."""
    if name == "svg" and attributes.endswith("/") and not UNQUOTED_END.search(attributes):
        return at
    if name in missing:
        return None
    depth = 1  # only svg nests
    for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])([^>]*)", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
            if not depth:
                return m.start()
        elif name == "svg" and not (m[2].endswith("/") and not UNQUOTED_END.search(m[2])):
            depth += 1
    missing.add(name)
    return None


def _hints(attributes: str) -> list[str]:
    """The names that mark a part."""
    if "=" not in attributes:
        return []
    return [name for a, b, c in NAMED.findall(attributes) for name in (a or b or c).lower().split() if HINT.fullmatch(name)]


class _Open:
    """A section-like ancestor, or inside a named part (``at`` is -1) one that its end tag could be taken for."""

    __slots__ = "tag", "names", "bad", "at"

    def __init__(self, tag: str, names: list[str], bad: bool, at: int):
        self.tag, self.names, self.bad, self.at = tag, names, bad, at


def _walk(toks, applied):
    """(number, kind, value, closing, stack of _Open before and after) of every token; ``applied`` tells if names of the
    element opened by token number n count."""
    stack: list[_Open] = []
    for n, (kind, value, closing, attributes) in enumerate(toks):
        before = stack
        if kind == "tag" and value not in INLINE and value not in MATH:
            stack = list(stack)
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == value:
                        del stack[i:]
                        break
            elif value == "body":
                stack = [s for s in stack if s.tag != "head"]
            else:
                if stack and stack[-1].tag == "p" or stack and stack[-1].tag == value == "li":
                    stack.pop()  # ends where the next block starts
                inside = any(s.tag in ARTICLE for s in stack)
                names = _hints(attributes) if value not in ARTICLE and value != "html" else []
                if inside:
                    names = [] if value == "header" else [x for x in names if not HEADS.match(x)]
                if names and not applied(n):
                    names = []
                if (value in SECTIONS or value in NOT_TEXT or names) and value not in VOID and value not in RAW:
                    # a header that opens the article holds its title; one outside is the page's own
                    bad = value in NOT_TEXT or bool(names) or value == "header" and not inside
                    stack.append(_Open(value, names, bad, n))
                elif any(s.names and (s.tag == value or s.tag == "li" and value in ("ul", "ol")) for s in stack):
                    stack.append(_Open(value, [], False, -1))  # so that its end tag does not end the named part
        yield n, kind, value, closing, before, stack


def _wrappers(toks) -> set[int]:
    """Numbers of the tags whose names do not make them left-out parts: they hold an article, or most words of the page (of
    the article that they are in, if any), or for adverts and comments all of them. Next to an article that is marked no
    part is a wrapper for its words alone; comments that follow words of an article may hold articles of their own."""
    held: dict[int, list] = {}  # tag number: names, tag number of the article around, its words, its articles, words read
    total: dict[int, int] = {-1: 0}  # words of the page and of each article, without those of parts left out by their tag
    read = 0
    for n, kind, value, closing, before, stack in _walk(toks, lambda n: True):
        if kind == "text":
            words = len(value.split())
            if words and not any(s.tag in NOT_TEXT or s.tag == "header" and s.bad for s in stack):
                total[-1] += words
                for s in stack:
                    if s.tag in ARTICLE:
                        total[s.at] += words
                        read += words
                    if s.at in held:
                        held[s.at][2] += words
        elif stack is not before and not closing and stack and stack[-1].at == n:
            top = stack[-1]
            if top.tag in ARTICLE:
                total[n] = 0
                for s in stack:
                    if s.at in held:
                        held[s.at][3] += 1
            elif top.names:
                around = next((s.at for s in reversed(stack) if s.tag in ARTICLE), -1)
                held[n] = [top.names, around, 0, 0, read]
    marked = any(w for a, w in total.items() if a >= 0)
    out = set()
    for n, (names, around, words, articles, read) in held.items():
        sure = any(SURELY.match(x) for x in names)
        comments = any(x.startswith(("comment", "replies", "disqus")) for x in names)
        most = around >= 0 or not marked
        if articles and not (comments and read) or most and words and (words == total[around] if sure else 2 * words > total[around]):
            out.add(n)
    return out


def features(page: str):
    """(feature, words, raw text or tag, is content by its own markup, inside an article) of every token.
    Words is 0 for tags."""
    toks = list(tokens(page))
    wrappers = _wrappers(toks)
    for _, kind, value, closing, before, stack in _walk(toks, lambda n: n not in wrappers):
        inside, left_out = any(s.tag in ARTICLE for s in before), any(s.bad for s in before)
        place = _place(before)
        if kind == "text":
            words = len(value.split())
            if words:
                yield "w " + place, words, value, not left_out, inside
            elif value:
                yield "", 0, value, True, inside
            continue
        if value in MATH:
            yield "", 0, " " if value in MATH_PARTS else "", True, inside
            continue
        if stack is not before and not closing:
            inside, left_out = inside or value in ARTICLE, any(s.bad for s in stack)
        own = not left_out and value not in NOT_TEXT
        yield f"t {value} {place}", 0, ("/" if closing else "") + value, own, inside and value not in ARTICLE


def _place(stack) -> str:
    """The nearest section-like ancestor; what an article keeps counts as the article."""
    top = next((s for s in reversed(stack) if s.at >= 0), None)
    if top is None:
        return ""
    if not top.bad and any(s.tag in ARTICLE for s in stack):
        return "article"
    return ".".join([top.tag.replace("main", "article"), *top.names])


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


def weight_of(feature: str, weights: dict[int, float], default: float) -> float:
    """Of the feature in its place, else half of what it weighs in any place, else the default."""
    w = weights.get(slot(feature))
    if w is None:
        w = weights.get(slot(feature.rpartition(" ")[0]))
        w = default if w is None else w / 2
    return w


def unmarked_weight_of(feature: str, weights: dict[int, float], default: float) -> float:
    """In a page that marks no article. Where marked pages have such words and tags says nothing about it: words weigh the
    default, tags half of what they weigh in any place, but no less than the default; those of paragraphs and headings
    are 0 at least, so that a title in a box of its own stays."""
    kind, _, name = feature.partition(" ")
    if kind == "w":
        return default
    name = name.partition(" ")[0]
    w = weights.get(slot(f"{kind} {name}"))
    default = 0.0 if name in TEXT else default
    return default if w is None else max(default, w / 2)


def marked_span(toks) -> tuple[int, int] | None:
    """From the first to the last word of its own text that a page marks as article; None if it marks none."""
    at = [i for i, (_, words, _, own, inside) in enumerate(toks) if words and own and inside]
    return (at[0], at[-1]) if at else None


def main_text(page: str, weights: dict[int, float]) -> str:
    """The article of a page. Parts that are left out weigh nothing, but for those around a marked article."""
    toks = list(features(page))
    span = marked_span(toks)
    first, last = span or (0, len(toks))
    weigh = weight_of if span else unmarked_weight_of
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    known: dict[str, float] = {}
    for i, (feature, words, _, own, _) in enumerate(toks):
        if not feature:
            continue
        w = known.get(feature)
        if w is None:
            w = known[feature] = weigh(feature, weights, WORD if words else TAG)
        if not own:
            w = 0.0 if first <= i <= last else min(w, TAG)
        total += w * (words or 1)
        if total > best:
            best, span = total, (start, i + 1)
        elif total <= 0:
            total, start = 0.0, i + 1
    blocks, now = [], []
    for feature, words, value, own, _ in toks[span[0]:span[1]]:
        if not feature or words:
            if own:
                now.append(html.unescape(value))
        elif value.lstrip("/") in INLINE:
            if value in ("br", "/br", "wbr", "img"):
                now.append(" " if value != "wbr" else "")
        else:
            blocks.append(now)
            now = []
    blocks.append(now)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def _counts(html_col: str):
    def run(batches):
        counts = defaultdict(lambda: [0, 0])
        for batch in batches:
            for page in batch.column(batch.schema.get_field_index(html_col)):
                page = page.as_py() or ""
                toks = [t for t in features(page) if t[0]]
                if marked_span(toks) is None:
                    continue  # no article marked: not a labelled page
                for feature, words, _, _, inside in toks:
                    counts[slot(feature)][inside] += words or 1
                    counts[slot(feature.rpartition(" ")[0])][inside] += words or 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()),
                                              pa.array([c[1] for c in counts.values()], pa.int64()),
                                              pa.array([c[0] for c in counts.values()], pa.int64())],
                                             names=["slot", "inside", "outside"])
    return run


def fit(pages: DataFrame, html_col: str = "html") -> dict[int, float]:
    """Weight per feature slot from all pages that mark their article; FEATURES entries at most."""
    counted = (pages.select(html_col).mapInArrow(_counts(html_col), "slot int, inside long, outside long")
               .groupBy("slot").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect())
    return {r["slot"]: max(-CLIP, min(CLIP, math.log((r["inside"] + 0.5) / (r["outside"] + 0.5)))) for r in counted}


def extract(pages: DataFrame, weights: dict[int, float], html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text."""
    pages = pages.drop(text_col)
    schema = T.StructType(pages.schema.fields + [T.StructField(text_col, T.StringType())])
    arrow = to_arrow_schema(schema)
    held = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "", held.value) for x in batch.column(batch.schema.get_field_index(html_col))]
            cols = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
    return pages.mapInArrow(run, schema)
