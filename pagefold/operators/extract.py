"""Page extraction (all requested outputs in one narrow pass).

Links, headers and paragraphs are Column expressions over the page's tags
(``operators.tokens``); where nothing else is asked for, no page leaves the JVM. Markdown,
html, raw_html and registered types need the page's tree: for these each page is parsed once
in ``mapInArrow``. Links are resolved with native expressions (``functions.urls``).

Extract types are lower-cased and de-duplicated; an empty list means ``links``;
``all`` means every type except ``raw_html``. New types can be registered with
``register_extractor`` (the ``images`` type is the worked example).
"""

from __future__ import annotations

from typing import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagefold.functions.urls import resolve_urls
from pagefold.operators import htmltree as H
from pagefold.operators import tokens as K

# ---- fixed values -------------------------------------------------------------------------
BUILTIN_TYPES = ("links", "headers", "paragraphs", "markdown", "html", "raw_html")
LIST_TYPES = ("links", "headers", "paragraphs")
TEXT_TYPES = ("markdown", "html", "raw_html")
MAX_STORED_HTML = 512 * 1024          # bytes kept of html / raw_html
SPLIT_BYTES = 16 * 1024 * 1024        # a table under this size per core is dealt out before the parse
PIECE_BYTES = 1024 * 1024             # bodies that a task holds parsed at a time; a longer one is alone
MAX_BODY_BYTES = 5 * 1024 * 1024      # a fetcher's usual cap, for ``max_body_bytes``
# --------------------------------------------------------------------------------------------


class PageView:
    """What an extractor sees: the parsed document plus lazily found landmarks."""

    def __init__(self, doc: H.Node):
        self.doc = doc
        self._elements = None

    @property
    def elements(self) -> list:
        if self._elements is None:
            self._elements = list(H.iter_elements(self.doc))
        return self._elements

    def find(self, *tags: str) -> Iterable[H.Node]:
        want = set(tags)
        return (e for e in self.elements if e.tag in want)

    def first(self, pred) -> H.Node | None:
        for e in self.elements:
            if pred(e):
                return e
        return None

    def body(self) -> H.Node:
        return self.first(lambda e: e.tag == "body")

    def main_content(self) -> H.Node:
        return (self.first(lambda e: e.tag == "article") or self.first(lambda e: e.tag == "main")
                or self.first(lambda e: e.attr("role") == "main") or self.body())


def _links(v: PageView) -> list[str]:
    return [h for h in (e.attr("href") for e in v.find("a")) if h is not None]


def _texts(v: PageView, *tags) -> list[str]:
    out = []
    for e in v.find(*tags):
        t = H.go_trim(H.text_of(e))
        if t:
            out.append(t)
    return out


def _images(v: PageView) -> list[str]:
    return [s for s in (e.attr("src") for e in v.find("img")) if s is not None]


# name -> (function(PageView) -> list[str], resolve_as_url)
_REGISTRY: dict[str, tuple[Callable[[PageView], list[str]], bool]] = {
    "links": (_links, True),
    "headers": (lambda v: _texts(v, "h1", "h2", "h3", "h4"), False),
    "paragraphs": (lambda v: _texts(v, "p"), False),
}


def register_extractor(name: str, fn: Callable[[PageView], list[str]], resolve_as_url: bool = False):
    """Add an extract type: ``fn`` returns a list of strings per page; when
    ``resolve_as_url`` the strings are resolved against the page URL like links."""
    _REGISTRY[name.lower()] = (fn, resolve_as_url)


def register_images():
    """The worked extension example: ``images`` = every ``img[src]``, resolved."""
    register_extractor("images", _images, resolve_as_url=True)


#: Types that are Column expressions, unless another function has been registered under their name.
_NATIVE = {t: _REGISTRY[t] for t in LIST_TYPES}


def extract_set(types: Iterable[str] | None) -> list[str]:
    """Lower-case and de-duplicate; empty means links; ``all`` expands to every type
    except raw_html (raw_html stays only if named explicitly)."""
    seen: list[str] = []
    for t in types or []:
        t = t.lower()
        if t not in seen:
            seen.append(t)
    if not seen:
        return ["links"]
    if "all" in seen:
        custom = [t for t in _REGISTRY if t not in BUILTIN_TYPES]
        expanded = ["links", "headers", "paragraphs", "markdown", "html"] + custom
        return expanded + [t for t in seen if t == "raw_html"]
    return [t for t in seen if t in _REGISTRY or t in TEXT_TYPES]


def truncate_utf8(s: str, cap: int = MAX_STORED_HTML) -> tuple[str, bool]:
    """Cut to ``cap`` bytes; a character split by the cut becomes one U+FFFD per
    leftover byte (what a JSON encoder does with the invalid tail)."""
    b = s.encode("utf-8")
    if len(b) <= cap:
        return s, False
    cut = b[:cap]
    for k in range(cap, max(cap - 4, 0) - 1, -1):
        try:
            return cut[:k].decode("utf-8") + "�" * (cap - k), True
        except UnicodeDecodeError:
            continue
    return cut.decode("utf-8", errors="replace"), True


def extract_one(body: str | bytes | None, types: list[str], max_html: int = MAX_STORED_HTML,
                max_body_bytes: int | None = None) -> dict:
    """All requested outputs of one page (pure Python; used by the Arrow pass and tests). With
    ``max_body_bytes`` a longer body is cut there and ``truncated`` is set; by default it is read whole."""
    raw = body if isinstance(body, (bytes, bytearray)) else (body or "").encode("utf-8", "surrogatepass")
    cut = max_body_bytes is not None and len(raw) > max_body_bytes
    if cut or not isinstance(body, str):
        body = bytes(raw[:max_body_bytes]).decode("utf-8", errors="replace")
    doc = H.parse(body)
    v = PageView(doc)
    out: dict = {"truncated": cut, "cut_types": []}
    for t in types:
        if t in _REGISTRY:
            out[t] = _REGISTRY[t][0](v)
    if "markdown" in types or "html" in types:
        main = v.main_content()
        if "markdown" in types:
            out["markdown"] = H.markdown(main)
        if "html" in types:
            out["html"], tr = truncate_utf8(H.render(main, skip_noise=True), max_html)
            out["truncated"] = out["truncated"] or tr
            out["cut_types"] += ["html"] * tr
    if "raw_html" in types:
        out["raw_html"], tr = truncate_utf8(H.render(v.body() or doc), max_html)
        out["truncated"] = out["truncated"] or tr
        out["cut_types"] += ["raw_html"] * tr
    return out


def _spread(df: DataFrame) -> DataFrame:
    """The parse is CPU-bound Python, so a table that makes few scan splits is dealt out to all cores. The planner's
    own size estimate decides, no job is run for it; a table of many splits is read as it lies."""
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(sc.defaultParallelism) if size < sc.defaultParallelism * SPLIT_BYTES else df


def asked_types(types: Column, t: str) -> Column:
    """Whether a row's own list of types asks for ``t`` (``extract_set`` as a Column)."""
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    asked = F.array_contains(low, t) if t == "raw_html" else F.array_contains(low, t) | F.array_contains(low, "all")
    return asked | (F.size(low) == 0) if t == "links" else asked


def _with_native(src: DataFrame, types: list[str], body_col: str, types_col: str | None) -> DataFrame:
    """``src`` with the types that are Column expressions."""
    if not types:
        return src
    src = K.cut_markup(src, body_col, texts="_texts" if {"headers", "paragraphs"} & set(types) else None)
    for t in types:
        if t == "links":
            src = src.withColumn(t, K.start_attributes(F.col("_tags"), "a", "href"))
        else:
            src = K.with_element_texts(src, t, t)
        if types_col:
            src = src.withColumn(t, F.when(asked_types(F.col(types_col), t), F.col(t)))
    return src.drop("_tags", "_texts")


def _output_fields(types: list[str]) -> list[T.StructField]:
    fields = []
    for t in types:
        if t in TEXT_TYPES:
            fields.append(T.StructField(t, T.StringType()))
        else:
            fields.append(T.StructField(t, T.ArrayType(T.StringType())))
    return fields + [T.StructField("truncated", T.BooleanType()), T.StructField("cut_types", T.ArrayType(T.StringType()))]


def extract_pages(df: DataFrame, types: Iterable[str] | None = None, *, url_col: str = "url",
                  body_col: str = "html", keep: Iterable[str] = ("page_id",),
                  max_html: int = MAX_STORED_HTML, resolve: bool = True,
                  types_col: str | None = None, max_body_bytes: int | None = None, cut_types: bool = False) -> DataFrame:
    """Run the extraction pass over a page table.

    Output columns: ``keep`` + url + one column per type + truncated. With
    ``types_col`` each row names its own extract list (lower-cased, de-duplicated,
    empty -> links, ``all`` expanded); ``types`` is then the set of output columns
    and a type a row did not ask for is NULL for that row. ``cut_types`` adds the list of types that
    were cut at ``max_html``, for callers that share one parse among several requests.
    List types that are URLs (links, images) are resolved against ``url`` by native
    expressions; unparsable hrefs are dropped, order and duplicates kept.
    """
    if types_col is None:
        types = extract_set(types)
    else:
        custom = tuple(t for t in _REGISTRY if t not in BUILTIN_TYPES)
        types = list(dict.fromkeys(types or (BUILTIN_TYPES + custom)))
    keep = [k for k in keep if k not in (url_col, types_col)]
    cols = [*keep, url_col, body_col] + ([types_col] if types_col else [])
    src = _spread(df.select(*cols))
    text = isinstance(src.schema[body_col].dataType, T.StringType) and max_body_bytes is None
    native = [t for t in types if text and _REGISTRY.get(t) is not None and _REGISTRY[t] == _NATIVE.get(t)]
    parsed = [t for t in types if t not in native]
    src = _with_native(src, native, body_col, types_col)
    order = [*keep, url_col, *types, "truncated"] + ["cut_types"] * cut_types
    if not parsed:
        out = src.withColumns({"truncated": F.lit(False), "cut_types": F.array().cast("array<string>")}).select(*order)
    else:
        out = _parse_pages(src, parsed, body_col, types_col, max_html, max_body_bytes).select(*order)
    if resolve:
        for t in types:
            if t in _REGISTRY and _REGISTRY[t][1]:
                out = out.withColumn(t, resolve_urls(F.col(url_col), F.col(t)))
    return out


def _pieces(batch: pa.RecordBatch, body_col: str):
    """Slices of a batch with about ``PIECE_BYTES`` of bodies. A batch of Spark's holds thousands of pages; their trees
    and outputs together are many times their size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(body_col))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE_BYTES, "right")))
        yield batch.slice(i, j - i)
        i = j


def _parse_pages(src: DataFrame, types: list[str], body_col: str, types_col: str | None, max_html: int,
                 max_body_bytes: int | None) -> DataFrame:
    """The types that need the page's tree, beside the other columns of ``src``."""
    in_fields = [f for f in src.schema.fields if f.name not in (body_col, types_col)]
    schema = T.StructType(in_fields + _output_fields(types))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        for batch in (piece for whole in batches for piece in _pieces(whole, body_col)):
            cols = dict(zip(batch.schema.names, batch.columns))
            bodies = cols[body_col].to_pylist()
            asked = [types] * len(bodies) if types_col is None else [
                [t for t in extract_set(own) if t in types] for own in cols[types_col].to_pylist()]
            results = [extract_one(b, t, max_html, max_body_bytes) for b, t in zip(bodies, asked)]
            made = [cols[f.name] for f in in_fields] + [pa.array([r.get(t) for r in results]) for t in types]
            made += [pa.array([r["truncated"] for r in results]), pa.array([r["cut_types"] for r in results], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)
    return src.mapInArrow(run, schema)


def extract_shared(requests: DataFrame, bodies: DataFrame, *, key: str, url_col: str, types_col: str) -> DataFrame:
    """``requests`` with the outputs that each asks for of the page ``key``, and ``truncated``.

    Late: a page's body is first touched when it is known who wants it. The wanted pages are one row per ``key`` with
    the types that any request asks for; that table meets ``bodies`` (key, body) in one equi-join, where the runtime filter
    of the optimiser keeps unwanted bodies from being shuffled; every wanted page is cut up and parsed once, and what
    it gave is joined back to the requests, which keep their own types. Links are resolved per request, against its URL."""
    types = [*BUILTIN_TYPES, *(t for t in _REGISTRY if t not in BUILTIN_TYPES)]
    wanted = requests.groupBy(key).agg(F.array_compact(F.array(*(
        F.when(F.max(asked_types(F.col(types_col), t)), F.lit(t)) for t in types))).alias("_wanted"))
    pages = extract_pages(bodies.select(key, "body").join(wanted, key), types, url_col=key, body_col="body", keep=(),
                          types_col="_wanted", resolve=False, cut_types=True)
    met = requests.join(pages, key)
    out = met.withColumns({t: F.when(asked_types(F.col(types_col), t), F.col(t)) for t in types})
    for t in types:
        if t in _REGISTRY and _REGISTRY[t][1]:
            out = out.withColumn(t, resolve_urls(F.col(url_col), F.col(t)))
    mine = F.exists("cut_types", lambda c: F.when(c == "html", asked_types(F.col(types_col), "html")).otherwise(asked_types(F.col(types_col), "raw_html")))
    return out.withColumn("truncated", mine).select(*requests.columns, *types, "truncated")
