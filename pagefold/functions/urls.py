"""URL parsing, resolution and printing as native Column expressions.

``parse_url``/``try_parse_url`` are not used: they raise or return NULL on hosts
with ``_`` and keep the scheme's case. A URL is split by one regex into its
RFC 3986 parts, with the reference's rules on top:

* the scheme is a letter followed by ``[A-Za-z0-9+.-]`` and is lower-cased;
* a scheme followed by a non-``/`` rest is *opaque* (``mailto:x``);
* the query starts at the first ``?`` and is printed verbatim;
* the path and fragment are printed as-is when every character may appear
  unescaped, else percent-decoded and re-encoded byte by byte;
* dot segments are removed only by resolution, never by printing.

Evaluation is staged: each stage maps a struct to a struct inside ``transform``
so every intermediate field is computed once per value (a plain nested Column
would copy shared sub-expressions and grow exponentially). The same stages run
over a scalar (wrapped in a one-element array) or over a whole array of hrefs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: URL grammar and character classes of the reference's URL printer --
URL_RE = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//(?:([^/?#]*)@)?([^/?#@]*))?"
          r"([^?#]*)(\?)?([^#]*)(#)?(.*)$")
PATH_VALID = r"^[A-Za-z0-9\-_.~!$&'()*+,;=:@\[\]/%]*$"
PATH_SAFE_CHAR = r"^[A-Za-z0-9\-_.~$&+,/:;=@]$"
FRAG_VALID = r"^[A-Za-z0-9\-_.~$&+,/:;=?@!()*'\[\]%]*$"
FRAG_SAFE_CHAR = r"^[A-Za-z0-9\-_.~$&+,/:;=?@!()*]$"
HOST_VALID = r"^(?:[A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>\"%]|[^\x00-\x7f])*$"
CTL_RE = r"[\x00-\x1f\x7f]"
BAD_PCT_RE = r"%(?![0-9A-Fa-f]{2})"
# -------------------------------------------------------------------------------------

def _e():
    return F.lit("")


_MEMO: dict = {}


def _memo(fn):
    """Cache built expressions by function and input text. Building one URL
    expression takes thousands of driver-to-JVM calls; the result is an immutable,
    unresolved Column, so the same (function, inputs) can be reused freely."""
    import functools

    @functools.wraps(fn)
    def wrapper(*args, **kw):
        key = (fn.__name__, tuple(str(a) for a in args), tuple(sorted(kw.items())))
        hit = _MEMO.get(key)
        if hit is None:
            hit = _MEMO[key] = fn(*args, **kw)
        return hit
    return wrapper


def chain(first: Column, *stages) -> Column:
    """Apply struct->struct stages to a scalar, materialising each stage."""
    arr = F.array(first)
    for st in stages:
        arr = F.transform(arr, st)
    return F.element_at(arr, 1)


def chain_array(arr: Column, *stages) -> Column:
    for st in stages:
        arr = F.transform(arr, st)
    return arr


# ---- character encoding ---------------------------------------------------------------
def pct_encode_chars(c: Column, safe_char_re: str) -> Column:
    """Percent-encode (upper-case hex, per UTF-8 byte) every code point not matching
    ``safe_char_re``."""
    def enc(ch):
        return F.when(ch.rlike(safe_char_re), ch).otherwise(
            F.replace(F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")))
    return F.array_join(F.transform(F.split(c, ""), enc), "")


def _pct_decode(c: Column) -> Column:
    # url_decode turns '+' into a space; protect it first.
    return F.when(c.contains("%"), F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def escaped_path(path: Column) -> Column:
    """The printer's path: kept when every char is allowed, else decoded and re-encoded."""
    return F.when(path.rlike(PATH_VALID), path).otherwise(pct_encode_chars(_pct_decode(path), PATH_SAFE_CHAR))


def escaped_fragment(frag: Column) -> Column:
    return F.when(frag.rlike(FRAG_VALID), frag).otherwise(pct_encode_chars(_pct_decode(frag), FRAG_SAFE_CHAR))


def escaped_host(host: Column) -> Column:
    return F.when(host.rlike(r"^[\x00-\x7f]*$"), host).otherwise(pct_encode_chars(host, r"^[\x00-\x7f]$"))


# ---- stage A: parse ----------------------------------------------------------------------
def parse_fields(s: Column) -> list[Column]:
    """Fields of a parsed URL, each a flat function of the input string ``s``."""
    g = lambda i: F.regexp_extract(s, URL_RE, i)
    scheme, slashes, userinfo, host, path = g(1), g(2), g(3), g(4), g(5)
    has_auth = slashes != ""
    # Without a scheme, "///x" is a path, not an empty authority.
    triple = (scheme == "") & s.startswith("///")
    opaque = (scheme != "") & ~has_auth & ~path.startswith("/")
    ok = ~s.rlike(CTL_RE) & ~s.startswith(":") & \
        ((scheme != "") | has_auth | path.startswith("/") | ~F.substring_index(path, "/", 1).contains(":")) & \
        ~path.rlike(BAD_PCT_RE) & ~g(9).rlike(BAD_PCT_RE) & host.rlike(HOST_VALID) & \
        (host.startswith("[") | host.rlike(r"^[^:]*(:[0-9]*)?$"))
    return [
        F.lower(scheme).alias("scheme"),
        opaque.alias("opaque"),
        (has_auth & ~triple).alias("has_auth"),
        F.when(s.rlike(r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*@"), userinfo).alias("userinfo"),
        F.when(triple, _e()).otherwise(host).alias("host"),
        F.when(triple, F.regexp_extract(s, r"(?s)^([^?#]*)", 1)).otherwise(path).alias("path"),
        (g(6) != "").alias("has_q"),
        g(7).alias("query"),
        g(9).alias("frag"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    ]


def parse_struct(s: Column) -> Column:
    return F.struct(*parse_fields(s))


def hostname_of(host: Column) -> Column:
    """Host without port; IPv6 brackets removed."""
    return F.when(host.startswith("["), F.regexp_extract(host, r"^\[([^\]]*)\]", 1)) \
        .otherwise(F.regexp_replace(host, r":[0-9]*$", ""))


# ---- dot segments ---------------------------------------------------------------------------
def remove_dot_segments(full: Column) -> Column:
    """Dot-segment removal as the reference does it: result starts with '/'; one
    leading '/' is dropped when two would be written. ``full`` must be cheap (a field)."""
    fast = F.when(full.startswith("/"), full).otherwise(F.concat(F.lit("/"), full))
    segs = F.split(full, "/", -1)
    stack = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(
            s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        ).otherwise(F.concat(acc, F.array(s))))
    last = F.element_at(segs, -1)
    slow = F.concat(F.lit("/"), F.array_join(stack, "/"),
                    F.when(last.isin(".", ".."), F.lit("/")).otherwise(_e()))
    slow = chain(slow, lambda x: F.when(F.substr(x, F.lit(2), F.lit(1)) == "/", F.substr(x, F.lit(2)))
                 .otherwise(x))
    return F.when(full == "", _e()).when(~full.rlike(r"(^|/)\.\.?(/|$)"), fast).otherwise(slow)


# ---- printing -------------------------------------------------------------------------------
def _print(x: Column, path_field: str = "epath", keep_fragment: bool = True) -> Column:
    """Print a struct with scheme, opaque_text, has_auth, userinfo, host, <path_field>
    (already escaped), has_q, query, frag."""
    p = x[path_field]
    auth = F.when(x["has_auth"] & ((x["host"] != "") | (p != "") | x["userinfo"].isNotNull()),
                  F.concat(F.lit("//"),
                           F.when(x["userinfo"].isNotNull(), F.concat(x["userinfo"], F.lit("@"))).otherwise(_e()),
                           escaped_host(x["host"]))).otherwise(_e())
    body = F.when(x["opaque_text"].isNotNull(), x["opaque_text"]).otherwise(F.concat(auth, p))
    out = F.concat(F.when(x["scheme"] != "", F.concat(x["scheme"], F.lit(":"))).otherwise(_e()), body,
                   F.when(x["has_q"], F.concat(F.lit("?"), x["query"])).otherwise(_e()))
    if keep_fragment:
        out = F.concat(out, F.when(x["frag"] != "", F.concat(F.lit("#"), escaped_fragment(x["frag"])))
                       .otherwise(_e()))
    return out


def _with_epath(x: Column) -> Column:
    return F.struct(x["scheme"], F.when(x["opaque"], x["path"]).alias("opaque_text"), x["has_auth"],
                    x["userinfo"], x["host"], escaped_path(x["path"]).alias("epath"), x["has_q"],
                    x["query"], x["frag"], x["ok"])


def _print_stage(keep_fragment: bool, with_host: bool = False):
    if with_host:
        return lambda x: F.when(x["ok"], F.struct(_print(x, "epath", keep_fragment).alias("url"),
                                                  F.lower(hostname_of(x["host"])).alias("host")))
    return lambda x: F.when(x["ok"], _print(x, "epath", keep_fragment))


@_memo
def print_url(url: Column, keep_fragment: bool = True) -> Column:
    """Parse and print (``String()`` of ``Parse``); NULL when it does not parse."""
    return chain(url, parse_struct, _with_epath, _print_stage(keep_fragment))


@_memo
def normalize_url(url: Column) -> Column:
    """De-duplication key: parse and print without the fragment. Scheme is lower-cased
    by parsing; host case, port, trailing slash and query are kept."""
    return print_url(url, keep_fragment=False)


# ---- resolution -----------------------------------------------------------------------------
def _resolve_stages(keep_fragment: bool, with_host: bool = False):
    def s_parse(x):
        return F.struct(parse_struct(x["base"]).alias("b"), parse_struct(x["ref"]).alias("r"))

    def s_escape(x):
        return F.struct(x["b"].alias("b"), x["r"].alias("r"),
                        escaped_path(x["b"]["path"]).alias("bp"), escaped_path(x["r"]["path"]).alias("rp"))

    def s_merge(x):
        b, r, bp, rp = x["b"], x["r"], x["bp"], x["rp"]
        r_abs = r["scheme"] != ""
        r_net = ~r_abs & r["has_auth"] & ((r["host"] != "") | r["userinfo"].isNotNull())
        own = r_abs | r_net
        inherit_q = ~own & (r["path"] == "") & ~r["has_q"]
        last_slash = F.length(bp) - F.instr(F.reverse(bp), "/") + 1
        dir_part = F.when(F.instr(bp, "/") > 0, F.substr(bp, F.lit(1), last_slash)).otherwise(_e())
        merged = F.when(own, rp).when(rp == "", bp).when(rp.startswith("/"), rp).otherwise(F.concat(dir_part, rp))
        return F.struct(
            F.when(r_abs, r["scheme"]).otherwise(b["scheme"]).alias("scheme"),
            F.when(r_abs & r["opaque"], r["path"]).when(~own & (r["path"] == "") & b["opaque"], b["path"])
            .alias("opaque_text"),
            F.when(own, r["has_auth"]).otherwise(b["has_auth"]).alias("has_auth"),
            F.when(own, r["userinfo"]).otherwise(b["userinfo"]).alias("userinfo"),
            F.when(own, r["host"]).otherwise(b["host"]).alias("host"),
            merged.alias("full"),
            F.when(inherit_q, b["has_q"]).otherwise(r["has_q"]).alias("has_q"),
            F.when(inherit_q, b["query"]).otherwise(r["query"]).alias("query"),
            F.when(inherit_q & (r["frag"] == ""), b["frag"]).otherwise(r["frag"]).alias("frag"),
            (b["ok"] & r["ok"]).alias("ok"))

    def s_dots(x):
        return F.struct(x["scheme"], x["opaque_text"], x["has_auth"], x["userinfo"], x["host"],
                        F.when(x["opaque_text"].isNotNull(), _e()).otherwise(remove_dot_segments(x["full"]))
                        .alias("epath"), x["has_q"], x["query"], x["frag"], x["ok"])

    return [s_parse, s_escape, s_merge, s_dots, _print_stage(keep_fragment, with_host)]


@_memo
def resolve_url(base: Column, ref: Column, keep_fragment: bool = True) -> Column:
    """RFC 3986 resolution of ``ref`` against ``base``, printed; NULL when either
    string does not parse."""
    return chain(F.struct(base.alias("base"), ref.alias("ref")), *_resolve_stages(keep_fragment))


@_memo
def resolve_urls(base: Column, refs: Column, keep_fragment: bool = True, with_host: bool = False) -> Column:
    """Resolve every element of the array ``refs``; unparsable ones are dropped,
    order and duplicates kept. ``keep_fragment=False`` gives the normalised form in
    the same pass; ``with_host`` returns structs (url, host) with the lower-cased
    hostname of each result, so no second parse is needed downstream."""
    arr = F.transform(refs, lambda h: F.struct(base.alias("base"), h.alias("ref")))
    out = chain_array(arr, *_resolve_stages(keep_fragment, with_host))
    return F.filter(out, lambda u: u.isNotNull())


# ---- host helpers and predicates -------------------------------------------------------------
@_memo
def hostname(url: Column) -> Column:
    """``Hostname()``: host without port; NULL when the URL does not parse."""
    return chain(url, parse_struct, lambda p: F.when(p["ok"], hostname_of(p["host"])))


@_memo
def url_host(url: Column) -> Column:
    """``Host`` (with port); NULL when the URL does not parse."""
    return chain(url, parse_struct, lambda p: F.when(p["ok"], p["host"]))


@_memo
def extract_hostname(url: Column) -> Column:
    """Worker-side host key: hostname, or 'unknown' when the URL does not parse."""
    return F.coalesce(hostname(url), F.lit("unknown"))


@_memo
def is_valid_api_url(url: Column) -> Column:
    """API check: parses, scheme http/https (any case), non-empty host[:port]."""
    return F.coalesce(chain(url, parse_struct,
                            lambda p: p["ok"] & p["scheme"].isin("http", "https") & (p["host"] != "")),
                      F.lit(False))


def has_http_prefix(url: Column) -> Column:
    """Scrape-time check: case-sensitive ``http://`` or ``https://`` prefix."""
    return F.coalesce(url.startswith("http://") | url.startswith("https://"), F.lit(False))


@_memo
def same_host(a: Column, b: Column) -> Column:
    """Hostname equality, case-insensitive; port and scheme are ignored."""
    return F.lower(hostname(a)) == F.lower(hostname(b))


@_memo
def href_parses(href: Column) -> Column:
    return chain(href, parse_struct, lambda p: p["ok"])
