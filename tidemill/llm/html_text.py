"""Main text of web pages by composite text density.

For every node of the page: characters C, tags T, link characters LC and link tags LT of its subtree give the link-adjusted
characters per tag, C/T * log(C/LC * T/LT) to the base ln(C*LC/(C-LC) + LC_body*C/C_body + e). The node whose children's
densities have the largest sum is the article; the least density on its path to the body is the threshold, and any other
subtree that reaches it gives its own node of largest sum. What lies between chosen siblings, and prose next to them, is
chosen too, unless most of it is links. If the chosen node lies in an article or main element, that element is taken whole.

Elements that are boilerplate by their kind (fixed lists below) count as empty. Elements that a role, a class, an id or a form
only marks as boilerplate count as empty unless the text outvotes the mark: see _dropped().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("nav aside footer button select option iframe object svg canvas dialog menu head template".split())
FOREIGN = ("svg", "math")
PROSE = set("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr br".split())
HEAD = set("title meta link script style base noscript template".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = set("ad ads adv advert adverts advertisement advertising banner cookie cookies consent gdpr notice notices notification popup modal overlay promo promotion sponsor sponsored sidebar sidebars side menu menus nav navbar navigation navigate breadcrumb breadcrumbs footer foot header masthead topbar comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar widget widgets skip hidden".split())
#: What may follow a mark in a name ("comment-list"), and what turns a name into its opposite ("no-sidebar", "comment-free").
PARTS = set("list box block area section container wrapper wrap inner outer left right top bottom bar item items link links button buttons icon icons post posts article articles story stories slot unit panel zone form thread count title group row col column columns cell card cards feed message msg policy terms primary secondary site page global mobile desktop sticky fixed main content body text region holder frame head tags tag cloud big small large id".split())
NEGATIONS = set("has have no not non with without free off".split())
#: Before "header" these name the article's own one, as any does that lies in an article.
OWN = set("entry post article story content page title".split())
P_ENDS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag that ends an open one of these, unless an element of the third entry lies between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|xmp|noembed|noframes)\b[^<>]*+>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^<>]*+>", re.I | re.S)
_attribute = re.compile(r"""(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marked(kind: str, attributes: str, inside: bool) -> bool:
    """Whether an element looks like boilerplate by its role, its names or as a form. inside: it lies in an article, whose own header
    is no mark, by kind or by name; nor are names such as entry-header. A name is a mark if its last word is one, or its first with nothing
    but parts of pages after it."""
    if kind in ("html", "body"):
        return False
    found = _attribute.findall(attributes)
    names = [[w.lower() for w in _word.findall(part)] for name, value in found if name.lower() in ("class", "id") for part in value.strip("\"'").split()]
    own = inside or any(w[-1:] == ["header"] and not OWN.isdisjoint(w) for w in names)
    if kind == "form" or kind == "header" and not own:
        return True
    for name, value in found:
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and kind not in ("article", "main"):
            for part in value.split():
                words = [w.lower() for w in _word.findall(part)]
                if words and words[-1] == "header" and own:
                    continue
                if words and NEGATIONS.isdisjoint(words) and (words[-1] in MARKS or words[0] in MARKS and all(w in PARTS or w in MARKS or w.isdigit() for w in words[1:])):
                    return True
    return False


def _dropped(kinds: list[str], parent: list[int], marks: list[bool], pieces: list[tuple[int, str | None]]) -> list[bool]:
    """Which nodes count as empty. A marked subtree does, unless it holds more than half of the page's text outside links and either
    a heading of the first rank, an article or a main element, or ten times the text that is left outside all marked subtrees."""
    n = len(kinds)
    own, heads = [0] * n, [k in ("h1", "article", "main") for k in kinds]
    for i, s in pieces:
        if s and kinds[i] != "a" and not s.isspace():
            own[i] += len(s)
    whole, open_text = own[:], own[:]  # of the subtree; of its part that lies in no marked subtree below
    for i in range(n - 1, 0, -1):  # children come after their parents
        whole[parent[i]] += whole[i]
        heads[parent[i]] |= heads[i]
        if not marks[i]:
            open_text[parent[i]] += open_text[i]
    left, out = open_text[0], [False] * n
    for i in range(1, n):
        if out[parent[i]] and kinds[i] not in ("article", "main"):
            out[i] = True
        elif marks[i]:  # those that hold more than half of the text lie in each other
            out[i] = not (2 * whole[i] > whole[0] and (heads[i] or whole[i] > 10 * left))
            left += 0 if out[i] else open_text[i]
    return out


def main_text(html: str | None) -> str:
    """The page's main text; empty for null, for empty pages and for pages without text."""
    if not html:
        return ""
    kinds, parent, dropped, marks = ["body"], [-1], [False], [False]  # node 0 holds whatever stands outside the body as well
    pieces: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
    stack, at = [0], 0
    places: dict[str, list[int]] = {}  # of each kind of element the depths at which one is open
    solid = [0]  # depths of open elements that are not inline

    def close(depth: int) -> None:
        if solid[-1] >= depth:
            pieces.append((stack[depth - 1], None))
        for n in reversed(stack[depth:]):
            places[kinds[n]].pop()
        while solid[-1] >= depth:
            solid.pop()
        del stack[depth:]

    def deepest(of: set[str]) -> int:
        return max((places[k][-1] for k in of if places.get(k)), default=0)

    def text(lo: int, hi: int) -> None:
        if lo < hi and not dropped[stack[-1]]:
            s = html[lo:hi]
            pieces.append((stack[-1], unescape(s) if "&" in s else s))

    for m in _token.finditer(html):
        text(at, m.start())
        at = m.end()
        kind = m[3]
        if not kind:
            continue
        kind = kind.lower()
        if m[2]:
            depth = places[kind][-1] if places.get(kind) else 0
            if depth and (kind not in INLINE or depth > solid[-1]):  # an inline end tag does not close blocks
                close(depth)
            continue
        if places.get("head") and kind not in HEAD:  # its end tag may be left out
            close(places["head"][-1])
        if kind in ("html", "body"):
            continue
        if kind in P_ENDS:
            if kinds[stack[solid[-1]]] == "p":
                close(solid[-1])
        elif kind in ENDS:
            ended, bounds = ENDS[kind]
            while (depth := deepest(ended)) > deepest(bounds):
                close(depth)
                if kind != "tr":
                    break
        top = stack[-1]
        if kind not in INLINE:
            pieces.append((top, None))
        if kind in VOID:
            continue
        node = len(kinds)
        kinds.append(kind)
        parent.append(top)
        dropped.append(dropped[top] and kind not in ("article", "main") or kind in DROPPED)
        marks.append(not dropped[node] and marked(kind, m[4] or "", bool(places.get("article"))))
        foreign = kind in FOREIGN or any(places.get(x) for x in FOREIGN)  # only there a slash closes an element that is no inline one
        if not (m[4] or "").rstrip().endswith("/") or kind not in INLINE and not foreign:
            places.setdefault(kind, []).append(len(stack))
            if kind not in INLINE:
                solid.append(len(stack))
            stack.append(node)
    text(at, len(html))
    gone = _dropped(kinds, parent, marks, pieces)
    pieces = [(i, None if s is None or gone[i] else s) for i, s in pieces]
    chosen = _choose(kinds, parent, pieces)
    blocks, open_block = [], []
    for n, s in pieces:
        if s is None:
            if open_block:
                blocks.append("".join(open_block))
                open_block = []
        elif chosen[n]:
            open_block.append(s)
    blocks.append("".join(open_block))
    return " ".join(w for b in blocks for w in b.split())


def _choose(kinds: list[str], parent: list[int], pieces: list[tuple[int, str | None]]) -> list[bool]:
    """Which nodes' own text belongs to the article."""
    n = len(kinds)
    chars, tags, link_chars, link_tags, sums = [0] * n, [1] * n, [0] * n, [0] * n, [0.0] * n
    leaves: list[tuple[int, int]] = []
    for i, s in pieces:
        if s and (k := len(s) if not s.isspace() else 0):
            chars[i] += k
            leaves.append((i, k))
    for i in range(n - 1, 0, -1):  # children come after their parents
        if kinds[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        p = parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    if not chars[0]:
        return [False] * n
    body = link_chars[0] / chars[0]

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        return c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / log(c * lc / max(c - lc, 1) + body * c + e)

    dense = [density(*x) for x in zip(chars, tags, link_chars, link_tags, strict=True)]
    for i in range(1, n):
        sums[parent[i]] += dense[i]
    for i, k in leaves:
        linked = kinds[i] == "a"
        sums[i] += density(k, 1, k * linked, int(linked))
    best = [i for i in range(n)]  # the node of largest sum in each subtree; of equals the outermost
    for i in range(n - 1, 0, -1):
        if sums[best[i]] > sums[best[parent[i]]] or best[parent[i]] != parent[i] and sums[best[i]] == sums[best[parent[i]]]:
            best[parent[i]] = best[i]
    threshold, i = dense[best[0]], best[0]
    while i > 0:
        i = parent[i]
        threshold = min(threshold, dense[i])
    chosen = [False] * n

    def lift(i: int) -> int:
        whole, j = i, i
        while j > 0:
            if kinds[j] in ("article", "main"):
                whole = j
            j = parent[j]
        return whole

    chosen[lift(best[0])] = True
    for i in range(1, n):  # parents first: a chosen node brings its whole subtree
        if chosen[parent[i]]:
            chosen[i] = True
        elif not chosen[i] and dense[i] >= threshold and chars[i]:
            chosen[best[i]] = True
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(parent[i], []).append(i)
    for own in children.values():  # what lies between chosen children, and blocks of prose next to them, belong to the article
        at = [k for k, i in enumerate(own) if chosen[i]]
        if at:
            lo, hi = at[0], at[-1]
            while lo and kinds[own[lo - 1]] in PROSE:
                lo -= 1
            while hi + 1 < len(own) and kinds[own[hi + 1]] in PROSE:
                hi += 1
            for i in own[lo : hi + 1]:
                chosen[i] |= 2 * link_chars[i] <= chars[i]
    for i in range(1, n):
        chosen[i] |= chosen[parent[i]]
    return chosen


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text string and n_chars long (code points) of every row. Null and empty pages have an empty text."""
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
