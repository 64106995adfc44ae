"""Shared DuckDB SQL fragments for the oracles.

The oracle formulation of page extraction works on the driver's page shape (every
page: head with style/script, nav, one article, footer, comments): drop script,
style and comments, then take tags by regex. Entity decoding covers the entities
present in the driver data; ``&amp;`` is decoded last.
"""

# fixed values: the entities in the driver pages, in decoding order
ENTITIES = (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def dec(expr: str) -> str:
    out = expr
    for ent, ch in ENTITIES:
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


def trim_ws(expr: str) -> str:
    return f"trim({expr}, ' ' || chr(10) || chr(9) || chr(13))"


CLEAN_PAGES = r"""
SELECT page_id, url,
       regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'),
                      '<!--.*?-->', '', 'gs') AS h
FROM pages
"""

PATH_VALID = r"[A-Za-z0-9._~!$&''()*+,;=:@/%\[\]-]*"
PATH_SAFE_CHAR = r"[A-Za-z0-9._~$&+,/:;=@-]"


def escaped_path(expr: str) -> str:
    return (f"CASE WHEN regexp_full_match({expr}, '{PATH_VALID}') THEN {expr} ELSE "
            f"array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN "
            f"regexp_full_match(c, '{PATH_SAFE_CHAR}') THEN c ELSE url_encode(c) END), '') END")


def origin(url: str) -> str:
    """scheme (lower-cased) + '://' + host of an absolute http(s) URL."""
    return (f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || "
            f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)")


def hostname(url: str) -> str:
    return f"regexp_replace(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':[0-9]*$', '')"


# Root-relative hrefs (the only kind in the driver pages) resolved against the page URL.
RAW_HREFS = f"""
WITH b AS ({CLEAN_PAGES}),
l AS (SELECT page_id, url, regexp_extract_all(h, '<a [^>]*href="([^"]*)"', 1) AS l FROM b),
r AS (SELECT page_id, url, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM l)
SELECT page_id, url, CAST(pos AS BIGINT) AS pos, {dec('raw')} AS href FROM r
"""

RESOLVED_LINKS = f"""
SELECT page_id, url, pos, {origin('url')} || {escaped_path('href')} AS link
FROM ({RAW_HREFS}) x
"""
