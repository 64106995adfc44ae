"""Small HTML5-style tree builder, serialiser and markdown walker.

Runs inside the Arrow batches of the page-extraction pass (one parse per page).
It covers the parts of HTML5 tree construction that change extracted text or
outer HTML on real pages: implied html/head/body, void and raw-text elements,
implied ``</p>`` / ``</li>`` / heading ends, end tags without a matching start,
and reconstruction of formatting elements (``<b>`` left open across ``<p>``).
Table and form insertion modes are not modelled. Everything is iterative so a
deeply nested junk page cannot hit Python's recursion limit.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

from pagefold.operators import tokens

# ---- fixed values (HTML element classes and output formats) -------------------------
VOID = frozenset(("area base basefont bgsound br col embed frame hr img input keygen link "
                  "meta param source track wbr").split())
RAW_TEXT = ("script", "style", "noscript", "xmp", "iframe", "noembed", "noframes", "plaintext")
ESCAPABLE_RAW_TEXT = ("title", "textarea")
# an opening tag ends these open parts of the nearest table
TABLE_ENDS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "caption": ("caption",),
              **dict.fromkeys(("tbody", "thead", "tfoot"), ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"))}
CELLS = ("td", "th", "caption")
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes script style template title noscript".split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset "
                      "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav "
                      "ol p pre section summary table ul li dd dt listing plaintext xmp").split())
BLOCK_END = frozenset(("address article aside blockquote button center details dialog dir div dl "
                       "fieldset figcaption figure footer form header hgroup listing main menu nav ol "
                       "pre section summary ul applet marquee object table").split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE_STOP = frozenset("html table td th caption marquee object applet template".split())
BUTTON_SCOPE_STOP = SCOPE_STOP | {"button"}
LIST_SCOPE_STOP = SCOPE_STOP | {"ol", "ul"}
SPECIAL = frozenset(("address applet area article aside base basefont bgsound blockquote body br "
                     "button caption center col colgroup dd details dir div dl dt embed fieldset "
                     "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
                     "hgroup hr html iframe img input keygen li link listing main marquee menu meta "
                     "nav noembed noframes noscript object ol p param plaintext pre script section "
                     "select source style summary table tbody td template textarea tfoot th thead "
                     "title tr track ul wbr xmp").split())
NOISE = frozenset(("script", "style", "nav", "footer", "noscript"))
# White space as the reference's runtime defines it (trim and field splitting).
WS = ("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
      "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
HTML_ESCAPES = {"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\r": "&#13;"}
# ---------------------------------------------------------------------------------------

_ESC_TABLE = str.maketrans(HTML_ESCAPES)
_ATTRIBUTE = re.compile(tokens._ATTR.replace(r"\z", r"\Z"))
_ATTRIBUTE_REF = re.compile(tokens._REF["attribute"])
_TAG_NAME = re.compile(r"<[^\t\n\f\r />]*")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "data", "open")

    def __init__(self, tag, attrs=None, data=None):
        self.tag = tag
        self.attrs = attrs or []
        self.children = []
        self.parent = None
        self.data = data
        self.open = False

    def attr(self, name):
        for k, v in self.attrs:
            if k == name:
                return v
        return None

    def append(self, child):
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)


def _attribute_value(raw: str) -> str:
    """References by the rule for attributes, which the standard parser does not know in all its versions."""
    def meant(m):
        ref = m[0]
        if ref[1] == "#":
            return unescape(ref)
        return html5.get(ref[1:], ref)
    return _ATTRIBUTE_REF.sub(meant, raw)


def _attributes(start_tag: str):
    """(name, value) of a start tag as it stands in the page; of two with one name the first."""
    out = {}
    for m in _ATTRIBUTE.finditer(start_tag, _TAG_NAME.match(start_tag).end()):
        name, given, value = m[0].partition("=") if "=" in m[0][1:] else (m[0], "", "")
        if given and not name:  # a name may begin with the sign
            name, given, value = "=" + value.partition("=")[0], *value.partition("=")[1:]
        value = value.lstrip("\t\n\f\r ")
        if value[:1] in ("'", '"'):
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(name.rstrip("\t\n\f\r ").lower(), _attribute_value(value))
    return list(out.items())


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = RAW_TEXT + ESCAPABLE_RAW_TEXT

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.doc = Node("#document")
        self.html = self.head = self.body = None
        self.stack: list[Node] = []
        self.active: list = []          # active formatting elements, None = marker
        self.after_body = False

    # -- structure helpers ---------------------------------------------------------------
    def _ensure_html(self):
        if self.html is None:
            self.html = Node("html")
            self.doc.append(self.html)
            self.html.open = True
            self.stack = [self.html]

    def _ensure_head(self):
        self._ensure_html()
        if self.head is None:
            self.head = Node("head")
            self.html.append(self.head)

    def _ensure_body(self):
        if self.body is None:
            self._ensure_head()
            for n in self.stack[1:]:
                n.open = False
            self.body = Node("body")
            self.html.append(self.body)
            self.body.open = True
            self.stack = [self.html, self.body]

    @property
    def current(self):
        return self.stack[-1]

    def _push(self, node):
        self.current.append(node)
        node.open = True
        self.stack.append(node)

    def _pop(self):
        n = self.stack.pop()
        n.open = False
        return n

    def _pop_until(self, node):
        while self.stack:
            if self._pop() is node:
                return

    def _in_scope(self, tags, stops):
        for n in reversed(self.stack):
            if n.tag in tags:
                return n
            if n.tag in stops:
                return None
        return None

    def _close_p(self):
        p = self._in_scope(("p",), BUTTON_SCOPE_STOP)
        if p is not None:
            self._pop_until(p)
        return p

    def _reconstruct(self):
        act = self.active
        if not act or act[-1] is None or act[-1].open:
            return
        i = len(act) - 1
        while i > 0 and act[i - 1] is not None and not act[i - 1].open:
            i -= 1
        for j in range(i, len(act)):
            old = act[j]
            clone = Node(old.tag, list(old.attrs))
            self._push(clone)
            act[j] = clone

    def _push_formatting(self, node):
        same = [e for e in self._after_marker() if e.tag == node.tag and e.attrs == node.attrs]
        if len(same) >= 3:   # keep at most three identical entries
            self.active.remove(same[0])
        self.active.append(node)

    def _after_marker(self):
        out = []
        for e in reversed(self.active):
            if e is None:
                break
            out.append(e)
        return out[::-1]

    def _text_target(self):
        if self.body is None:
            return None
        return self.current

    # -- tokenizer callbacks -------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        attrs = _attributes(self.get_starttag_text())
        if tag == "html":
            self._ensure_html()
            for k, v in attrs:
                if self.html.attr(k) is None:
                    self.html.attrs.append((k, v))
            return
        if self.body is None:
            if tag == "head":
                self._ensure_head()
                return
            if tag in HEAD_TAGS:
                self._ensure_head()
                node = Node(tag, attrs)
                self.head.append(node)
                if tag not in VOID:
                    node.open = True
                    self.stack.append(node)
                return
            self._ensure_body()
            if tag == "body":
                self.body.attrs = attrs
                return
        elif tag in ("body", "head"):
            if tag == "body":
                for k, v in attrs:
                    if self.body.attr(k) is None:
                        self.body.attrs.append((k, v))
            return
        self._start_in_body(tag, attrs)

    def _close_table_parts(self, ends):
        """End the outermost open part among ``ends`` inside the nearest table, with the formatting of its cells."""
        last = None
        for n in reversed(self.stack):
            if n.tag == "table":
                break
            if n.tag in ends:
                last = n
        if last is not None:
            self._end_cells_above(last)
            self._pop_until(last)

    def _end_cells_above(self, node):
        for n in self.stack[self.stack.index(node):]:
            if n.tag in CELLS:
                while self.active and self.active.pop() is not None:
                    pass

    def _start_in_body(self, tag, attrs):
        if tag in TABLE_ENDS:
            self._close_table_parts(TABLE_ENDS[tag])
        if tag in CLOSES_P:
            if tag == "li":
                self._close_list_item(("li",))
            elif tag in ("dd", "dt"):
                self._close_list_item(("dd", "dt"))
            self._close_p()
            if tag in HEADINGS and self.current.tag in HEADINGS:
                self._pop()
            node = Node(tag, attrs)
            if tag == "hr":
                self.current.append(node)
            else:
                self._push(node)
            return
        if tag == "a":
            for e in reversed(self._after_marker()):
                if e.tag == "a":
                    if e.open:
                        self._pop_until(e)
                    self.active.remove(e)
                    break
        self._reconstruct()
        node = Node(tag, attrs)
        if tag in VOID:
            self.current.append(node)
            return
        self._push(node)
        if tag in FORMATTING:
            self._push_formatting(node)
        elif tag in ("td", "th", "caption", "marquee", "object", "applet", "template"):
            self.active.append(None)

    def _close_list_item(self, tags):
        for n in reversed(self.stack):
            if n.tag in tags:
                self._pop_until(n)
                return
            if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in RAW_TEXT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.body is None:
            if tag in ("head", "html", "body", "br", "p"):
                if tag in ("br", "p"):
                    self._ensure_body()
                    self._end_in_body(tag)
                return
            for n in reversed(self.stack):
                if n.tag == tag:
                    self._pop_until(n)
                    return
            return
        self._end_in_body(tag)

    def _end_in_body(self, tag):
        if tag in ("body", "html"):
            self.after_body = True
            return
        if tag == "p":
            if self._in_scope(("p",), BUTTON_SCOPE_STOP) is None:
                self._reconstruct()
                self._push(Node("p"))
            self._close_p()
            return
        if tag == "br":
            self._reconstruct()
            self.current.append(Node("br"))
            return
        if tag == "li":
            n = self._in_scope(("li",), LIST_SCOPE_STOP)
            if n is not None:
                self._pop_until(n)
            return
        if tag in ("dd", "dt"):
            n = self._in_scope((tag,), SCOPE_STOP)
            if n is not None:
                self._pop_until(n)
            return
        if tag in HEADINGS:
            n = self._in_scope(HEADINGS, SCOPE_STOP)
            if n is not None:
                self._pop_until(n)
            return
        if tag in FORMATTING:
            entry = None
            for e in reversed(self._after_marker()):
                if e.tag == tag:
                    entry = e
                    break
            if entry is not None:
                if entry.open:
                    self._pop_until(entry)
                self.active.remove(entry)
                return
        if tag in BLOCK_END or tag in ("td", "th", "caption", "template"):
            stops = SCOPE_STOP - {tag} - (set(CELLS) if tag == "table" else set())
            n = self._in_scope((tag,), stops)
            if n is not None and tag == "table":
                self._end_cells_above(n)
            if n is not None:
                self._pop_until(n)
                if tag in ("td", "th", "caption", "marquee", "object", "applet", "template"):
                    while self.active:
                        if self.active.pop() is None:
                            break
            return
        for n in reversed(self.stack):
            if n.tag == tag:
                self._pop_until(n)
                return
            if n.tag in SPECIAL:
                return

    def handle_data(self, data):
        if not data:
            return
        cur = self.stack[-1] if self.stack else None
        in_raw = cur is not None and cur.tag in RAW_TEXT + ESCAPABLE_RAW_TEXT and cur.open
        if in_raw and cur.tag in ESCAPABLE_RAW_TEXT:
            data = unescape(data)
        if self.body is None and not in_raw:
            if not data.strip(WS):
                return
            self._ensure_body()
        if not in_raw:
            self._reconstruct()
        target = self.stack[-1]
        kids = target.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)

    def handle_comment(self, data):
        node = Node("#comment", data=data)
        if self.html is None:
            self.doc.append(node)
        elif self.after_body:
            self.html.append(node)
        else:
            self.stack[-1].append(node)

    def handle_decl(self, decl):
        if self.html is None:
            self.doc.append(Node("#doctype", data=decl[8:].strip() if decl.lower().startswith("doctype") else decl))

    def unknown_decl(self, data):
        pass

    def parse_marked_section(self, i, report=1):
        """``<![...`` in a page is a comment up to the next ``>``, whatever it says."""
        end = self.rawdata.find(">", i + 3)
        if end < 0:
            return -1
        self.handle_comment(self.rawdata[i + 2:end])
        return end + 1

    def handle_pi(self, data):
        pass


def parse(html_text: str) -> Node:
    b = _Builder()
    b.feed(html_text or "")
    b.close()
    b._ensure_body()
    return b.doc


# ---- queries over the tree ---------------------------------------------------------------
def iter_elements(root: Node):
    """Pre-order walk of element descendants (document order), root excluded."""
    stack = list(reversed(root.children))
    while stack:
        n = stack.pop()
        if isinstance(n, Node) and n.tag[0] != "#":
            yield n
            if n.children:
                stack.extend(reversed(n.children))


def text_of(node: Node) -> str:
    parts = []
    stack = list(reversed(node.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag[0] != "#" and n.children:
            stack.extend(reversed(n.children))
    return "".join(parts)


def go_trim(s: str) -> str:
    return s.strip(WS)


def collapse_ws(s: str) -> str:
    return " ".join(s.split()) if s.isascii() else " ".join(_split_go(s))


def _split_go(s: str):
    out, cur = [], []
    for ch in s:
        if ch in WS:
            if cur:
                out.append("".join(cur))
                cur = []
        else:
            cur.append(ch)
    if cur:
        out.append("".join(cur))
    return out


def render(node: Node, skip_noise: bool = False) -> str:
    """Outer HTML of ``node``; ``skip_noise`` drops script/style/nav/footer/noscript
    descendants (the node itself is always kept)."""
    out = []
    stack = [(node, False)]
    while stack:
        n, closing = stack.pop()
        if closing:
            out.append("</" + n.tag + ">")
            continue
        if isinstance(n, str):
            out.append(n.translate(_ESC_TABLE))
            continue
        if isinstance(n, _Raw):
            out.append(n.s)
            continue
        tag = n.tag
        if tag == "#comment":
            out.append("<!--" + (n.data or "") + "-->")
            continue
        if tag == "#doctype":
            out.append("<!DOCTYPE " + (n.data or "html") + ">")
            continue
        if tag == "#document":
            stack.extend((c, False) for c in reversed(n.children))
            continue
        out.append("<" + tag)
        for k, v in n.attrs:
            out.append(" " + k + '="' + v.translate(_ESC_TABLE) + '"')
        if tag in VOID:
            out.append("/>")
            continue
        out.append(">")
        if tag in ("pre", "listing", "textarea") and n.children and isinstance(n.children[0], str) \
                and n.children[0].startswith("\n"):
            out.append("\n")
        stack.append((n, True))
        if tag in RAW_TEXT and tag != "plaintext":
            for c in reversed(n.children):
                if isinstance(c, str):
                    stack.append((_Raw(c), False))
                else:
                    stack.append((c, False))
            continue
        for c in reversed(n.children):
            if skip_noise and isinstance(c, Node) and c.tag in NOISE:
                continue
            stack.append((c, False))
    return "".join(out)


class _Raw:
    __slots__ = ("s",)

    def __init__(self, s):
        self.s = s


def markdown(root: Node) -> str:
    """Markdown of the children of ``root`` with the fixed node rules."""
    out = []
    # frames: ("n", node, in_pre) | ("s", text)
    stack = [("n", c, False) for c in reversed(root.children)]
    while stack:
        kind, n, *rest = stack.pop()
        if kind == "s":
            out.append(n)
            continue
        in_pre = rest[0]
        if isinstance(n, str):
            if in_pre:
                out.append(n)
            else:
                t = collapse_ws(n)
                if t:
                    out.append(t)
            continue
        tag = n.tag
        if tag[0] == "#" or tag in NOISE:
            continue
        if tag in HEADINGS:
            out.append("\n\n" + "#" * int(tag[1]) + " " + go_trim(text_of(n)) + "\n\n")
        elif tag == "p":
            stack.append(("s", "\n\n"))
            stack.extend(("n", c, False) for c in reversed(n.children))
            out.append("\n\n")
        elif tag == "br":
            out.append("\n")
        elif tag == "a":
            href = n.attr("href") or ""
            t = go_trim(text_of(n))
            if href and t:
                out.append("[" + t + "](" + href + ")")
            elif t:
                out.append(t)
        elif tag in ("ul", "ol"):
            bullet = "1. " if tag == "ol" else "- "
            parts = ["\n"]
            for c in n.children:
                if isinstance(c, Node) and c.tag == "li":
                    parts.append(bullet + go_trim(text_of(c)) + "\n")
            parts.append("\n")
            out.append("".join(parts))
        elif tag == "pre":
            stack.append(("s", "\n```\n\n"))
            stack.extend(("n", c, True) for c in reversed(n.children))
            out.append("\n\n```\n")
        elif tag == "code":
            if in_pre:
                stack.extend(("n", c, True) for c in reversed(n.children))
            else:
                out.append("`" + go_trim(text_of(n)) + "`")
        elif tag == "blockquote":
            out.append("\n\n> " + go_trim(text_of(n)) + "\n\n")
        else:
            stack.extend(("n", c, in_pre) for c in reversed(n.children))
    return go_trim("".join(out))
