"""Links, headings and paragraphs of a page in Column expressions, from one native cut of its markup.

``cut_markup`` splits a page into its tags (comments, and script-like elements with their content, are one tag each) and
the texts between them: two arrays, tag ``i`` stands between texts ``i`` and ``i + 1``. An element whose content
matters is an interval of tags: from its start to the first later tag that ends it, by its own end, by the end of
something around it, or by a start that it cannot hold. The text of an element is what lies in its interval. Nothing
is shuffled and nothing leaves the JVM; a page is a row throughout.

Character references follow the HTML rules, which differ inside attributes: there a name without its semicolon is left
alone before ``=``, a letter or a digit, so ``?a=1&section=2`` keeps its ``&section``.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: markup grammar and element classes of HTML ---------------------------------------------
_SP = r"\t\n\f\r "
_ATTR = rf"[^{_SP}/>][^{_SP}/>=]*+(?:[{_SP}]*+=[{_SP}]*+(?:\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z)|[^{_SP}>\"'][^{_SP}>]*+|(?=>)))?+"
_REST = rf"(?:[{_SP}/]++|{_ATTR})*+(?:>|\z)"
_RAW = "script|style|noscript|xmp|iframe|noembed|noframes|title|textarea"
MARKUP = (r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))"
          rf"|(?i:<({_RAW})(?=[{_SP}/>]){_REST}[\s\S]*?(?=</\1[{_SP}/>]|\z))"
          rf"|(?i:<plaintext(?=[{_SP}/>])[\s\S]*+)"
          rf"|</?+[a-zA-Z][^{_SP}/>]*+{_REST}"
          r"|<[!?/][^>]*+(?:>|\z)")
HEADINGS = ("h1", "h2", "h3", "h4")
#: A start tag of these ends an open paragraph.
ENDS_P = ("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
          "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt listing plaintext xmp").split()
#: Their end tag closes what is open inside them.
BLOCKS = ("address article aside blockquote body button center details dialog dir div dl fieldset figcaption figure footer form "
          "header hgroup html listing main menu nav ol pre search section summary ul applet marquee object table li dd dt").split()
CELLS = "td th tr tbody thead tfoot caption".split()
WHITE = ("\t\n\v\f\r \x85\xa0                　")
#: What the numbers 128 to 159 stand for in a character reference.
C1 = {0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
      0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
      0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178}
# ------------------------------------------------------------------------------------------------------------

_NUMBER = r"#[xX][0-9a-fA-F]++;?+|#[0-9]++;?+"
_REF = {"text": rf"&(?:{_NUMBER}|[a-zA-Z][a-zA-Z0-9]*+;?+)", "attribute": rf"&(?:{_NUMBER}|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))"}


def _names(ended: bool) -> Column:
    """The standard's names with their semicolon, or those that may go without, as one constant map."""
    own = {k: v for k, v in html5.items() if k.endswith(";") == ended}
    return F.from_json(F.lit(json.dumps(own)), "map<string,string>")


def _character(number: Column) -> Column:
    table = F.create_map(*[F.lit(x).cast("long") for kv in C1.items() for x in kv])
    n = F.coalesce(table[number], number)
    bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("�")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _reference(ref: Column, where: str) -> Column:
    """What one reference stands for."""
    digits = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
    number = F.when(F.length(digits) > 7, F.lit(0x110000).cast("long")).when(
        ref.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(F.concat(F.lit("0"), digits).cast("long"))
    name = F.substring(ref, 2, 64)
    open_names = _names(False)
    if where == "attribute":
        loose = open_names[name]
    else:  # in text the longest name that the letters begin with counts
        longest = max(len(k) for k in html5 if not k.endswith(";"))
        loose = F.coalesce(*(F.when(F.length(name) >= k, F.concat(open_names[F.left(name, F.lit(k))], F.substring(ref, 2 + k, 1 << 30)))
                             for k in range(longest, 1, -1)))
    usual = F.when(ref == "&amp;", "&").when(ref == "&lt;", "<").when(ref == "&gt;", ">").when(ref == "&quot;", '"').when(ref == "&#39;", "'")
    return F.coalesce(usual, F.when(ref.startswith("&#"), _character(number)), _names(True)[name], loose, ref)


def decoded(text: Column, where: str = "text") -> Column:
    """``text`` with its character references replaced."""
    pattern = _REF[where]
    refs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    meant = F.transform(refs, lambda r: _reference(r, where))
    gaps = F.split(text, pattern, -1)
    return F.when(text.contains("&"), F.array_join(F.flatten(F.transform(F.arrays_zip(
        gaps.alias("gap"), F.concat(meant, F.array(F.lit(""))).alias("meant")), lambda p: F.array(p["gap"], p["meant"]))), "")).otherwise(text)


def cut_markup(df: DataFrame, body_col: str, tags: str = "_tags", texts: str | None = "_texts") -> DataFrame:
    """``df`` with the tags of a page and, if named, the texts between them."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    out = df.withColumn(tags, F.regexp_extract_all(body, F.lit(MARKUP), F.lit(0)))
    return out if texts is None else out.withColumn(texts, F.split(body, MARKUP, -1))


def start_attributes(tags: Column, element: str, name: str) -> Column:
    """The attribute of that name of every start tag of ``element`` that has it, in order; empty without a value. Of
    two attributes of one name the first counts."""
    own_tags = F.filter(tags, lambda t: t.rlike(rf"^<(?i:{element})(?:[{_SP}/>]|$)"))
    of_name = lambda a: a.rlike(rf"^(?i:{name})[{_SP}]*+(?:=|$)")
    # one step per array: what a lambda function names twice is worked out twice
    own = F.transform(own_tags, lambda t: F.get(F.filter(F.regexp_extract_all(
        F.regexp_replace(t, rf"^<[^{_SP}/>]*+", ""), F.lit(_ATTR), F.lit(0)), of_name), F.lit(0)))
    value = rf"^[^=]*+(?:=[{_SP}]*+(?:\"([^\"]*+)|'([^']*+)|([\s\S]*+)))?+"
    raw = F.transform(F.filter(own, lambda a: a.isNotNull()), lambda a: F.concat(*(F.regexp_extract(a, value, g) for g in (1, 2, 3))))
    return F.transform(raw, lambda v: decoded(v, "attribute"))


def _pattern(starts, ends) -> str:
    return rf"^(?i:<(?:{'|'.join(starts)})|</(?:{'|'.join(ends)}))(?:[{_SP}/>]|$)"


_H = [f"h{i}" for i in range(1, 7)]
#: Per kind of element: its start tags, and the tags that end it.
INTERVALS = {"headers": (HEADINGS, _pattern([*_H, *CELLS], [*_H, *BLOCKS, *CELLS])),
             "paragraphs": (("p",), _pattern([*ENDS_P, *CELLS], ["p", *_H, *BLOCKS, *CELLS]))}


def with_element_texts(df: DataFrame, kind: str, out: str, tags: str = "_tags", texts: str = "_texts") -> DataFrame:
    """``df`` with the trimmed texts of all elements of a kind that have any, in order."""
    starts, ends = INTERVALS[kind]
    marks = f"_{kind}_ends"
    # a tag's place where it ends an element of the kind, else NULL
    df = df.withColumn(marks, F.filter(F.transform(tags, lambda t, i: F.when(t.rlike(ends), i)), lambda i: i.isNotNull()))
    is_start = rf"^<(?i:{'|'.join(starts)})(?:[{_SP}/>]|$)"
    opened = F.filter(F.transform(tags, lambda t, i: F.when(t.rlike(is_start), i)), lambda i: i.isNotNull())
    # every start is an end as well, so the next end is the one behind its own place
    spans = F.transform(opened, lambda i: F.struct(i.alias("start"), F.coalesce(
        F.get(F.col(marks), F.array_position(marks, i).cast("int")), F.size(tags)).alias("stop")))
    pieces = lambda s: F.transform(F.slice(texts, s["start"] + 2, s["stop"] - s["start"]), lambda t: decoded(t))
    found = F.transform(spans, lambda s: F.btrim(F.array_join(pieces(s), ""), F.lit(WHITE)))
    return df.withColumn(out, F.filter(found, lambda t: t != "")).drop(marks)
