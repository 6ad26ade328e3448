"""Main text of web pages by wrappers inferred per host.

A page's tags and texts are a token stream, balanced first: end tags that HTML
lets an author leave out are put in, stray ones dropped.  A wrapper is a
regular expression over such streams without unions: a sequence of tokens in
which a token may be optional (``?``), a stretch may repeat (``+``), and a
text is either fixed or a slot.  A single page is its own wrapper.  Two
wrappers are aligned level by level; a mismatch of texts becomes a slot, a
token that only one has becomes optional, and a token that recurs spans a
repeated group of optional members.  So every token occurs once in a wrapper
and a page is read by it without search.

Wrappers are merged inside the map tasks first, then in rounds over groups of
about ``FAN_IN``: a host of any size never meets in one task.

The wrapper then says where the host keeps its articles: in ``article`` or
``main`` elements or elements named so, if these hold enough of the text in
slots; otherwise in the deepest container that holds most of it, together with
the headline before it.  There, fixed texts that three different pages share
and lists of links are left out.  Navigation, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are known by
element, role, class or id and never count.

Defined results: null and empty pages give an empty text; a page without a
host in its URL (null included) is read by its own wrapper; repeated rows
give repeated results; equal pages count once as evidence; nesting past
``DEEPEST`` levels is flattened, its text stays; other columns are ignored; an
empty table gives an empty result.  Hosts whose pages lie in other files are
merged in another order, so optional members may differ, texts in marked
containers do not.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.session import cut_lineage

FAN_IN = 16
DEEPEST = 100
HELD = 200_000  # wrapper nodes a map task keeps before it passes them on
EVIDENCE = 3    # different pages that must share a fixed text
SCHEMA = "page_id long, url string, text string, n_chars long"

# HTML elements by how they take part in the stream.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
            "search section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas select "
          "button audio video".split())
ENDLESS = {"script", "style", "title", "textarea"}  # without an end tag these reach to the end of the page
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
          "option": {"option"}, "optgroup": {"option", "optgroup"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
SCOPES = {"table", "td", "th", "caption"}
IN_TABLE = {"caption", "tbody", "thead", "tfoot", "tr", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Names of parts that are no article.
PARTS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
         "menubar", "toolbar"}
SOFT_WORDS = set(
    "nav navbar navigation menu menus header masthead topbar footer sidebar sidebars aside widget widgets rail "
    "banner modal overlay form search toolbar".split())
HARD_WORDS = set(
    "breadcrumb breadcrumbs pagination pager skip copyright related recommended share sharing social "
    "notice notices cookie cookies consent gdpr alert popup notification disclaimer paywall "
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion "
    "anzeige werbung publicidad publicite anuncio newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond discussion kommentar kommentare commentaire "
    "commentaires comentario comentarios".split())
COMMENTS = {"comment", "comments", "reply", "replies"}
LAYOUT = {"with", "has", "no", "without"}
NAMED = {"article", "content", "main", "post", "entry", "story"}
OWNERS, INNER = {"article", "post", "entry", "story", "main", "page", "blog", "news"}, {"body", "content", "text", "main"}
LEVELS = ("article", "main", "named")
GENERIC = {"div", "section", "ul", "ol", "table", "td", "center"}
DESCEND = {"html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "form"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>"""
                  r"""|</?[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile("[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@lru_cache(4096)
def _end_of(name: str):
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)


@lru_cache(8192)
def _judge(name: str, attributes: str) -> tuple[str, int, str]:
    """Key of an element, whether it is no part of an article (2; 1 unless an article lies inside), its level as one."""
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    label, role = f"{a.get('class', '')} {a.get('id', '')}", a.get("role", "").lower()
    # Words are split at case changes too: articleBody is article body.
    words = set(_NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", label).lower()))
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style", "")))
    key = name + "".join(sorted(f".{w}" for w in words)) + (f"[{role}]" if role else "") + ("!" if hidden else "")
    mark = 2 if name in PARTS - {"form"} or role in ROLES - {"form"} or hidden else 0
    if not mark and not words & LAYOUT:
        mark = 2 if words & HARD_WORDS else 1 if name == "form" or role == "form" or words & SOFT_WORDS else 0
    if name == "main" or (name == "article" and not set(_NAME.findall("".join(label.lower().split()[:1]))) & COMMENTS):
        mark = 2 if hidden else 0
    level = ""
    if name == "article" or role == "article" or a.get("itemprop", "").lower() == "articlebody":
        level = "article"
    elif name == "main" or role == "main":
        level = "main"
    elif not mark and (words and words <= NAMED or words & OWNERS and words & INNER - words & OWNERS):
        level = "named"
    return key, mark, level


class Node:
    """An element, a text, or a repeated group, of a page or of a wrapper."""

    __slots__ = ("chars", "fixed", "key", "kids", "level", "links", "many", "mark", "n", "name", "optional", "text")

    def __init__(self, key: str, name: str, mark: int = 0, level: str = ""):
        self.key, self.name, self.mark, self.level = key, name, mark, level
        self.kids: list[Node] = []
        self.n, self.optional, self.many = 1, False, False
        self.chars = self.links = 0
        self.fixed, self.text = 0, ""


def _text(pieces: list[tuple[str, bool]], raw: bool = False) -> Node | None:
    text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
    if not text:
        return None
    node = Node("#", "#")
    node.text, node.chars = text, len(text)
    linked = "".join(p for p, link in pieces if link)
    node.links = min(len(text), len(" ".join(html.unescape(linked).split()))) if linked else 0
    node.fixed = zlib.crc32(text.encode("utf-8", "replace")) + 1
    return node


def parse(page: str) -> Node:
    """The balanced token stream of a page: blocks and their texts.

    Inline elements leave no token; a link is remembered for its text, and an
    inline element that is no part of the article takes its text away.
    """
    root = Node("html", "html")
    stack: list[tuple[str, Node]] = [("html", root)]
    opened: dict[str, int] = {}
    run: list[tuple[str, bool]] = []
    link = 0                # stack height at which the open link began
    skip: list = ["", 0, 0]  # inline element left out: name, nesting, stack height
    at, end = 0, len(page)

    def say(text: str):
        if not skip[2]:
            run.append((text, link > 0))

    def flush():
        if run:
            node = _text(run)
            if node is not None:
                stack[-1][1].kids.append(node)
            run.clear()

    def close(name: str, stop: set[str]):
        """Pop up to the nearest open ``name``, unless one of ``stop`` lies before it."""
        nonlocal link
        if not opened.get(name):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                flush()
                for gone, _ in stack[i:]:
                    opened[gone] -= 1
                del stack[i:]
                link = link if link <= i else 0
                if skip[2] > i:
                    skip[:] = ["", 0, 0]
                return
            if stack[i][0] in stop:
                return

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                close(name, set() if name == "table" else {"table"} if name in IN_TABLE else SCOPES)
            elif name == "a":
                link = 0
            elif name == "br":
                say(" ")
            if name == skip[0]:
                skip[1] -= 1
                if not skip[1]:
                    skip[:] = ["", 0, 0]
        elif name in RAW:
            done = _end_of(name).search(page, at)
            at = done.end() if done else end if name in ENDLESS else at
            say(" ")
        elif name in ("hr", "br"):
            flush() if name == "hr" else say(" ")
        elif name in BLOCK and name not in ("html", "body"):
            for other in CLOSES.get(name, ()):
                close(other, HOLDS[name])
            close("p", BLOCK - {"p"})
            flush()
            node = stack[-1][1]
            if len(stack) <= DEEPEST:
                key, mark, level = _judge(name, m[3])
                node = Node(key, name, 2 if skip[2] else mark, level)
                stack[-1][1].kids.append(node)
            stack.append((name, node))
            opened[name] = opened.get(name, 0) + 1
        elif name not in VOID and name not in ("html", "head", "body") and not m[3].endswith("/"):
            if name == "a":
                link = len(stack)
            if skip[2]:
                skip[1] += name == skip[0]
            elif _judge(name, m[3])[1]:
                skip[:] = [name, 1, len(stack)]
    flush()
    _settle(root)
    return root


def _settle(node: Node) -> bool:
    """Whether the article lies inside; a part known by its name only is then none."""
    inside = False
    for kid in node.kids:
        inside |= _settle(kid)
    if inside and node.mark == 1:
        node.mark = 0
    return inside or (node.level in ("article", "main") and not node.mark)


# --- wrappers -------------------------------------------------------------------------------------------------


def _core(node: Node) -> set[str]:
    names = {k.name for kid in node.kids for k in (kid.kids if kid.name == "()" else (kid,)) if 3 * k.n >= node.n}
    if node.links * 2 > node.chars:
        names.add("@")
    return names


def alike(a: Node, b: Node) -> bool:
    """Whether two elements or texts are the same token; plain containers must also hold alike."""
    if a.key != b.key:
        return False
    if a.key.rstrip("~") not in GENERIC:
        return True
    x, y = _core(a), _core(b)
    return x == y or 2 * len(x & y) > len(x | y)


def _members(node: Node) -> list[Node]:
    return node.kids if node.name == "()" else [node]


def _same(a: Node, b: Node) -> bool:
    if a.name != "()" and b.name != "()":
        return alike(a, b)
    return any(alike(x, y) for x in _members(a) for y in _members(b) if x.key == y.key)


def merge(a: Node, b: Node) -> Node:
    """One wrapper for what two wrappers accept (``a`` is changed)."""
    if a.name == "()" or b.name == "()":
        return _group(_members(a) + _members(b), a.optional and b.optional)
    a.optional |= b.optional
    a.many |= b.many
    a.chars, a.links = a.chars + b.chars, a.links + b.links
    if a.name == "#":
        a.fixed = a.fixed if a.fixed == b.fixed else 0
    elif a.kids or b.kids:
        a.kids = fold(_align(a.kids, b.kids))
    a.n += b.n
    return a


def _group(items: list[Node], optional: bool) -> Node:
    """A repeated group of optional members, in the order in which they first come."""
    group = Node("()", "()")
    group.optional, group.many = optional, True
    known: dict[str, list[Node]] = {}
    for item in items:
        near = known.setdefault(item.key, [])
        place = next((k for k in near if alike(k, item)), None)
        if place is not None:
            merge(place, item)
        else:
            near.append(item)
            group.kids.append(item)
            item.optional = True
    return group


def _align(a: list[Node], b: list[Node]) -> list[Node]:
    """Both sequences as one: longest common subsequence merged, the rest optional."""
    if len(a) == len(b) and all(_same(x, y) for x, y in zip(a, b, strict=True)):
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    equal = [[_same(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if equal[i][j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and equal[i][j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return out


def fold(items: list[Node], most: int = 48) -> list[Node]:
    """Runs of one token become ``token+``; tokens that recur span a repeated group."""
    kinds: list[Node] = []
    by_key: dict[str, list[int]] = {}
    runs: list[tuple[set[int], list[Node]]] = []
    for item in items:
        own = set()
        for member in _members(item):
            near = by_key.setdefault(member.key, [])
            for k in near:
                if alike(kinds[k], member):
                    break
            else:
                k = len(kinds)
                kinds.append(member)
                near.append(k)
            own.add(k)
        if runs and item.name != "()" and runs[-1][0] == own and runs[-1][1][0].name != "()":
            runs[-1][1].append(item)
        else:
            runs.append((own, [item]))
    spans: dict[int, list[int]] = {}
    for i, (own, _) in enumerate(runs):
        for k in own:
            spans.setdefault(k, [i, i])[1] = i
    if len(runs) > most:
        stretches = [[0, len(runs) - 1]]
    else:
        stretches = []
        for lo, hi in sorted(s for s in spans.values() if s[1] > s[0]):
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], hi)
            else:
                stretches.append([lo, hi])
    out: list[Node] = []
    i = 0
    for lo, hi in [*stretches, [len(runs), len(runs)]]:
        for _, run in runs[i:lo]:
            first = run[0]
            for other in run[1:]:
                merge(first, other)
            if len(run) > 1:
                first.many, first.n = True, max(1, first.n // len(run))
            out.append(first)
        if lo < len(runs):
            out.append(_group([m for _, run in runs[lo:hi + 1] for item in run for m in _members(item)], False))
        i = hi + 1
    return out


def own_wrapper(node: Node) -> Node:
    """The wrapper of a single page."""
    copy = Node(node.key, node.name, node.mark, node.level)
    copy.chars, copy.links, copy.fixed = node.chars, node.links, node.fixed
    if not node.mark:
        kids = [own_wrapper(k) for k in node.kids]
        if node.name != "#":
            copy.chars, copy.links = sum(k.chars for k in kids), sum(k.links for k in kids)
        copy.kids = fold(kids)
    return copy


def count(node: Node) -> int:
    return 1 + sum(count(k) for k in node.kids)


def dump(node: Node) -> list:
    return [node.key, node.name, node.mark, node.level, node.n, int(node.optional) + 2 * int(node.many), node.chars,
            node.links, node.fixed, [dump(k) for k in node.kids]]


def load(x: list) -> Node:
    node = Node(x[0], x[1], x[2], x[3])
    node.n, node.optional, node.many, node.chars, node.links, node.fixed = x[4], bool(x[5] & 1), bool(x[5] & 2), *x[6:9]
    node.kids = [load(k) for k in x[9]]
    return node


def expression(node: Node) -> str:
    """The wrapper as a regular expression over tokens."""
    if node.name == "#":
        body = "TEXT" if not node.fixed else "'fixed'"
    elif node.name == "()":
        body = "(" + " ".join(map(expression, node.kids)) + ")"
    else:
        body = f"<{node.key}>" + "".join(map(expression, node.kids)) + f"</{node.name}>"
    return body + ("+" if node.many else "") + ("?" if node.optional else "")


# --- extraction -----------------------------------------------------------------------------------------------


class Reader:
    """What a wrapper says about a host's pages."""

    def __init__(self, wrapper: Node, evidence: int):
        self.wrapper, self.fixed = wrapper, evidence >= EVIDENCE
        total = max(1, self._prose(wrapper))
        self.level = next((lv for lv in LEVELS if 4 * self._held(wrapper, lv) >= total), "")
        self.box = wrapper
        while True:
            kids = [k for k in self.box.kids if not k.mark and not k.many and k.name in DESCEND]
            top = max(kids, key=self._prose, default=None)
            if top is None or 10 * self._prose(top) < 6 * self._prose(self.box) or not self._prose(top):
                break
            self.box = top
        slots, fixed = self._texts(self.box)
        self.fixed = self.fixed and fixed < slots

    def _prose(self, node: Node) -> int:
        if node.mark:
            return 0
        if node.name == "#":
            return node.chars - node.links if not (self.fixed and node.fixed) else 0
        return sum(map(self._prose, node.kids))

    def _held(self, node: Node, level: str) -> int:
        if node.mark:
            return 0
        return self._prose(node) if node.level == level else sum(self._held(k, level) for k in node.kids)

    def _texts(self, node: Node) -> tuple[int, int]:
        if node.mark:
            return 0, 0
        if node.name == "#":
            return (0, node.chars) if node.fixed else (node.chars, 0)
        pairs = [self._texts(k) for k in node.kids]
        return sum(p[0] for p in pairs), sum(p[1] for p in pairs)

    def read(self, page: Node) -> list[str]:
        """The blocks of the main text."""
        for level in LEVELS[LEVELS.index(self.level):] if self.level else ():
            blocks: list[str] = []
            self._levels(page, level, blocks)
            if blocks:
                return blocks
        blocks = []
        self._boxed(page, self.wrapper, False, blocks)
        if not blocks:
            self._all(page, blocks)
        return blocks

    def _levels(self, node: Node, level: str, out: list[str]) -> None:
        if node.mark:
            return
        if node.level == level:
            self._all(node, out)
            return
        for kid in node.kids:
            self._levels(kid, level, out)

    def _all(self, node: Node, out: list[str]) -> None:
        for kid in node.kids:
            if kid.name == "#":
                out.append(kid.text)
            elif not kid.mark:
                self._all(kid, out)
            elif kid.name in ("header", "hgroup") or ".header" in kid.key:  # inside an article it holds the headings
                self._headings(kid, out)

    def _headings(self, node: Node, out: list[str]) -> None:
        for kid in node.kids:
            if kid.name in HEADINGS:
                self._all(kid, out)
            elif kid.name != "#" and not kid.mark:
                self._headings(kid, out)

    def _boxed(self, node: Node, known: Node | None, inside: bool, out: list[str]) -> None:
        inside = inside or known is self.box
        places: dict[str, list[Node]] = {}
        for k in known.kids if known is not None else ():
            for m in _members(k):
                places.setdefault(m.key, []).append(m)
        for kid in node.kids:
            if kid.mark:
                continue
            near = places.get(kid.key, ())
            place = next((p for p in near if alike(p, kid)), near[0] if near else None)
            if kid.name == "#":
                if inside and not (self.fixed and place is not None and place.fixed):
                    out.append(kid.text)
            elif inside:
                links = place is not None and place.name in GENERIC and place.links * 10 > place.chars * 7
                if not links:
                    self._boxed(kid, place, True, out)
            elif kid.name == "h1" and not out and not self._only_fixed(place):
                self._all(kid, out)
            else:
                self._boxed(kid, place, False, out)

    def _only_fixed(self, place: Node | None) -> bool:
        return self.fixed and place is not None and not self._texts(place)[0]


@lru_cache(64)
def _reader(wrapper: str) -> Reader:
    x = json.loads(wrapper)
    return Reader(load(x["w"]), len(x["pages"]))


def extract(page: str, wrapper: str | None = None) -> str:
    """Main text of one page, read by its host's wrapper or its own."""
    tree = measured(parse(page))
    reader = _reader(wrapper) if wrapper else Reader(own_wrapper(tree), 1)
    return "\n".join(reader.read(tree))


def measured(node: Node) -> Node:
    """Fill in the text sizes of the elements.

    Of plain containers that stand in exactly two places among their siblings
    (a line above and one below the article), the second ones get a key of
    their own: two places are no repetition.
    """
    runs: list[tuple[int, list[Node]]] = []
    kinds: list[Node] = []
    for kid in node.kids:
        if kid.name != "#":
            measured(kid)
        if not kid.mark:
            node.chars, node.links = node.chars + kid.chars, node.links + kid.links
        kind = -1
        if kid.key in GENERIC:
            kind = next((i for i, k in enumerate(kinds) if alike(k, kid)), len(kinds))
            if kind == len(kinds):
                kinds.append(kid)
        if runs and runs[-1][0] == kind >= 0:
            runs[-1][1].append(kid)
        else:
            runs.append((kind, [kid]))
    for kind in range(len(kinds)):
        own = [run for k, run in runs if k == kind]
        if len(own) == 2:
            for kid in own[1]:
                kid.key += "~"
    return node


def _state(page: str) -> dict:
    return {"w": own_wrapper(measured(parse(page))), "pages": {zlib.crc32(page.encode("utf-8", "replace"))}}


def _join(a: dict, b: dict) -> dict:
    """Merge two hosts' states; pages that add nothing new are not aligned again."""
    if len(b["pages"]) == 1 and b["pages"] <= a["pages"]:
        return a
    return {"w": merge(a["w"], b["w"]), "pages": set(sorted(a["pages"] | b["pages"])[:EVIDENCE])}


def _write(state: dict) -> str:
    return json.dumps({"w": dump(state["w"]), "pages": sorted(state["pages"])}, separators=(",", ":"))


def _read(text: str) -> dict:
    x = json.loads(text)
    return {"w": load(x["w"]), "pages": set(x["pages"])}


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from rows of ``host, html``."""
    def local(batches):
        held: dict[str, dict] = {}
        nodes = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                               pa.array([_write(s) for s in held.values()], pa.string())],
                                              names=["host", "wrapper"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                state = _state(page)
                if host in held:
                    held[host] = _join(held[host], state)
                    nodes += 1
                else:
                    held[host] = state
                    nodes += count(state["w"])
                if nodes > HELD:
                    yield out()
                    held, nodes = {}, 0
        if held:
            yield out()

    def together(key, table):
        texts = sorted(table.column("wrapper").to_pylist())
        state = _read(texts[0])
        for text in texts[1:]:
            state = _join(state, _read(text))
        return pa.table({"host": [key[0].as_py()], "wrapper": [_write(state)]})

    found = cut_lineage(pages.where("host is not null and html is not null").select("host", "html")
                        .mapInArrow(local, "host string, wrapper string"), "wrappers")
    while True:
        most = found.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return found
        part = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN_IN)))
        found = cut_lineage(found.withColumn("part", part).groupBy("host", "part")
                            .applyInArrow(together, "host string, wrapper string"), "wrappers")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: ``page_id, url, text, n_chars``."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                      F.col(html_col).alias("html"), F.when(host != "", host).alias("host"))
    joined = pages.join(infer_wrappers(pages), "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches):
        for batch in batches:
            texts = [extract(page, wrapper) if page else ""
                     for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, SCHEMA)
