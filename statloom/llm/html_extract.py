"""HTML main text by wrappers inferred per host.

A page is read into a balanced token tree.  Its wrapper is a union-free regular
expression: neighbouring runs of alike elements (or of alike sequences of two or
three) fold into repeated groups, and texts are constants.  The wrappers of a
host's pages are aligned one after the other: what only one side has becomes
optional, texts that differ become slots, runs become repeated groups.  Pages of a host
whose ``<article>``/``<main>`` elements stand under other tags are of another
template and get a wrapper of their own.

The finished wrapper decides what is article: a text that is the same wherever
its place in the wrapper occurs (a run: the same sequence of texts), on at least
``CONSTANT_SHARE`` of the template's pages and on ``FEW`` different pages
(``MOST`` if constants outweigh the slots), is part of the template and dropped.
Slots, and runs that differ between pages, stay.  An article or main element is
the region if it holds more than half of the slot text, otherwise the region is
the whole page.  Lists of tags and names (``DROP``, ``MARKS``, ``HEADER``) mark
menus, adverts, comments and the like that differ from page to page; these lists
are heuristic.  A tag, a role or a whole class name of a box (``BOX``) marks; a
word within a class, or an id, is a hint, which counts if the wrapper says that
the element is mostly links (or constant, as above).  Names of headings, of
inline elements and ids of sections and paragraphs are not read.  Of a form only
the controls go.

Scale: every task folds its own pages into one wrapper per host and template,
wrappers meet in ``SPREAD`` partial groups and then in one; only wrappers (not
pages) are shuffled, so a host with a third of all pages is no hot group.  The
rules of a host (a short path and digests of constants) are joined to the pages
by Spark.

Cases: null html is the empty page with empty text; a null url (or one without
``://``) belongs to the host ""; very long pages are read whole; unclosed and
stray tags are tolerated; repeated rows give repeated results, and copies of a
page count as one page; a template with nothing but constants (one page, or only
copies) drops none of them; a page without its template's region falls back to
its whole body without the boilerplate; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import materialize

#: Partial groups that a host's wrappers pass through.
SPREAD = 16
#: Different pages on which a text must be the same to be a constant, and where constants outweigh the slots.
FEW, MOST = 3, 8
#: Share of the template's pages that must have a constant.
CONSTANT_SHARE = 0.5
#: Elements nested deeper are read as if they stood side by side at this depth.
DEPTH = 120

#: Element kinds.
RAW = "script|style|noscript"
#: Elements left out up to their own end tag; without one, only the tag is.
EMBED = frozenset("template iframe svg math object canvas".split())
DROP = frozenset("nav footer aside head title button select optgroup option datalist textarea input label legend dialog menu".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
                  "blockquote pre figure figcaption hr address header footer nav aside form details summary center "
                  "hgroup caption fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a class of just one of the MARKS marks, and those whose id counts as a hint.
BOX = frozenset("div section ul ol dl table".split())
KNOWN = BOX - {"section"}
#: Elements whose names say nothing about what they hold: headings, and the page or the article itself.
MUTE = frozenset("html body main article h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words in a class, id or role that mark something other than the article.
MARKS = frozenset("ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar "
                  "navigation menu menubar sidebar sidebars cookie cookies consent gdpr notice notices alert popup modal "
                  "overlay comment comments disqus reply replies respond breadcrumb breadcrumbs footer masthead share "
                  "sharing social related recommended newsletter subscribe subscription signup login widget pagination "
                  "pager toolbar skip contentinfo complementary search dialog".split())
#: A name that starts so tells of a state: has-sidebar, no-comments.
STATES = frozenset("has with without no show hide".split())
#: Those that mark the page's own header, unless inside the article.
HEADER = frozenset(("header", "topbar", "siteheader"))
#: A start tag on the left ends an open element on the right.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html article section main div td th".split())

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*?>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|([^<]+|<)", re.S | re.I)
EMBEDDED = re.compile(rf"</?(?:{'|'.join(sorted(EMBED))})\b", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Node:
    __slots__ = ("tag", "sig", "out", "kids", "head", "hint")

    def __init__(self, tag, sig, out, head=False, hint=False):
        self.tag, self.sig, self.out, self.head, self.hint, self.kids = tag, sig, out, head, hint, []


_SIGS: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def _sig(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Signature of a start tag, whether it is boilerplate, whether it is a header, whether its name only hints at either."""
    got = _SIGS.get((tag, attributes))
    if got is None:
        whole, hints, names = set(), set(), []
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            for name in value.split():
                words = re.split(r"[_-]+", name)
                if words[0] not in STATES and (kind != "id" or tag in KNOWN):
                    hints.update(words)
                    if kind == "role" or kind == "class" and tag in BOX:
                        whole.add(name)
            names += [f"{'#' if kind == 'id' else '.'}{re.sub(r'[0-9]+', '0', v)}" for v in sorted(value.split())]
        if tag in MUTE or tag not in BLOCK:
            whole = hints = set()
        got = (tag + "".join(names), tag in DROP or bool(whole & MARKS), tag == "header" or bool(whole & HEADER),
               bool(hints & (MARKS | HEADER)))
        if len(attributes) < 200 and len(_SIGS) < 50_000:
            _SIGS[tag, attributes] = got
    return got


def _tokens(html: str):
    """Matches of TOKEN outside embedded elements."""
    if not EMBEDDED.search(html):
        yield from TOKEN.finditer(html)
        return
    ends: dict[int, int] = {}  # offset of an embedded element's start tag: offset behind its end tag
    opened: dict[str, list[int]] = {}
    for m in TOKEN.finditer(html):
        tag = (m[3] or "").lower()
        if tag in EMBED:
            if not m[2]:
                if not (m[4] or "").endswith("/"):
                    opened.setdefault(tag, []).append(m.start())
            elif opened.get(tag):
                ends[opened[tag].pop()] = m.end()
    behind = 0
    for m in TOKEN.finditer(html):
        if m.start() >= behind:
            if (m[3] or "").lower() not in EMBED:
                yield m
            else:
                behind = ends.get(m.start(), behind)


def parse(html: str) -> Node:
    """The page as a tree; raw-text and embedded elements and comments are left out, open elements are closed where needed."""
    root = Node("#root", "#root", False)
    stack = [root]
    flat: dict[str, int] = {}  # open elements beyond DEPTH, whose content stays in the last one within
    for m in _tokens(html):
        if m[5]:
            stack[-1].kids.append(m[5])
        elif m[3]:
            tag = m[3].lower()
            if m[2] and flat.get(tag):
                flat[tag] -= 1
                continue
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag not in BLOCK and stack[k].tag in BLOCK:
                        break  # a stray inline end does not close blocks
                continue
            if tag in BLOCK and tag not in ("html", "body"):
                for k in range(len(stack) - 1, 0, -1):  # a block start ends an open paragraph
                    if stack[k].tag == "p":
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK:
                        break
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        del stack[k:]
                        break
                    if stack[k].tag in SCOPE:
                        break
            node = Node(tag, *_sig(tag, m[4] or ""))
            stack[-1].kids.append(node)
            if tag not in VOID and not (m[4] or "").endswith("/"):
                if len(stack) < DEPTH:
                    stack.append(node)
                else:
                    flat[tag] = flat.get(tag, 0) + 1
    return root


# --- wrappers: [sig, many, optional, pages, chars, link chars, text or None, children,
#                digest of the texts that every page has here or None, digests of up to MOST pages, block numbers] ---

SIG, MANY, OPT, PAGES, CHARS, LINKS, TEXT, KIDS, SAME, SEEN, IDS = range(11)


def _digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _leaf(text: str, linked: int, page: int, ids: list):
    return ["#text", 0, 0, 1, len(text), linked, text, [], _digest(text), [page], ids]


def wrapper_of(node: Node, page: int = 0, blocks: list[str] | None = None) -> list:
    """One page's wrapper: block elements and texts; inline elements belong to the text around them.

    ``page`` is a digest of the page; the texts are appended to ``blocks`` and their numbers noted.
    """
    kids, text, linked = [], [], 0

    def flush():
        nonlocal text, linked
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            ids = []
            if blocks is not None:
                ids.append(len(blocks))
                blocks.append(joined)
            kids.append(_leaf(joined, min(linked, len(joined)), page, ids))
        text, linked = [], 0

    def inline(n: Node, in_link: bool):
        nonlocal linked
        for k in n.kids:
            if isinstance(k, str):
                text.append(k)
                linked += len(k) * in_link
            elif k.tag in BLOCK:
                flush()
                kids.append(wrapper_of(k, page, blocks))
            elif k.out:
                continue
            elif k.tag in ("br", "td", "th", "img"):
                text.append(" ")
                inline(k, in_link)
                text.append(" ")
            else:
                inline(k, in_link or k.tag == "a")

    inline(node, node.tag == "a")
    flush()
    kids = fold(kids)
    mark = "!" if node.out else "?" if node.head else "~" if node.hint else ""
    return [mark + node.sig, 0, 0, 1, sum(k[CHARS] for k in kids), sum(k[LINKS] for k in kids), None, kids, None, [], []]


def fold(kids: list) -> list:
    """Runs of alike neighbours, then of alike sequences of two or three, become repeated groups."""
    out: list = []
    for k in kids:
        if out and out[-1][SIG] == k[SIG]:
            merge(out[-1], k, one_page=True)
            out[-1][MANY] = 1
        else:
            out.append(k)
    for size in (2, 3):
        sigs, held, i = [k[SIG] for k in out], [], 0
        while i < len(out):
            if i + 2 * size > len(out) or sigs[i:i + size] != sigs[i + size:i + 2 * size]:
                held.append(out[i])
                i += 1
                continue
            group = ["(" + " ".join(sigs[i:i + size]) + ")", 1, 0, 1, 0, 0, None, out[i:i + size], None, [], []]
            j = i + size
            while sigs[j:j + size] == sigs[i:i + size]:
                for a, b in zip(group[KIDS], out[j:j + size]):
                    merge(a, b, one_page=True)
                j += size
            group[CHARS], group[LINKS] = (sum(k[f] for k in group[KIDS]) for f in (CHARS, LINKS))
            held.append(group)
            i = j
        out = held
    return out


def merge(a: list, b: list, one_page: bool = False) -> list:
    """Align wrapper ``b`` with ``a``, in place: mismatches become slots, optional and repeated groups.

    ``one_page``: both are neighbours on one page, so their texts follow each other.
    """
    a[MANY] |= b[MANY]
    a[OPT] |= b[OPT]
    for f in (CHARS, LINKS):
        a[f] += b[f]
    if a[TEXT] != b[TEXT]:
        a[TEXT] = None
    if one_page:
        a[SAME] = a[SAME] and b[SAME] and _digest(a[SAME] + b[SAME])
        a[IDS] += b[IDS]
    else:
        a[PAGES] += b[PAGES]
        if a[SAME] != b[SAME]:
            a[SAME] = None
        a[SEEN] = sorted({*a[SEEN], *b[SEEN]})[:MOST] if a[SAME] else []
    x, y = a[KIDS], b[KIDS]
    if [k[SIG] for k in x] == [k[SIG] for k in y]:
        for p, q in zip(x, y):
            merge(p, q, one_page)
        return a
    common = _common([k[SIG] for k in x], [k[SIG] for k in y])
    out, i, j = [], 0, 0
    for p, q in [*common, (len(x), len(y))]:
        for k in [*x[i:p], *y[j:q]]:
            k[OPT] = 1
            out.append(k)
        if p < len(x) and q < len(y):
            out.append(merge(x[p], y[q], one_page))
        i, j = p + 1, q + 1
    kept: list = []
    for k in out:  # options from both sides may have become alike neighbours
        if kept and kept[-1][SIG] == k[SIG]:
            merge(kept[-1], k, one_page)
            kept[-1][MANY] = 1
        else:
            kept.append(k)
    a[KIDS] = kept
    return a


def _common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Row i of the table of lengths is one integer: bit m - 1 - j is 0 where the length for
    (x[i:], y[j:]) exceeds that for (x[i:], y[j + 1:]).  About a square root of the
    rows is kept and the others are made again block by block, so two lists of 20,000 unlike
    entries take a few megabytes.
    """
    n, m = len(x), len(y)
    full, places = (1 << m) - 1, {}
    for j, s in enumerate(y):
        places.setdefault(s, []).append(m - 1 - j)
    masks = {s: sum(1 << p for p in places[s]) for s in {*x} & places.keys()}

    def above(i, row):
        """Row i from row i + 1."""
        u = row & masks.get(x[i], 0)
        return ((row + u) | (row - u)) & full

    step = math.isqrt(n) + 1
    row, saved = full, {n: full}
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            saved[i] = row
    out, i, j, block = [], 0, 0, {}
    while i < n and j < m:
        if i + 1 not in block or i not in block:
            top = min(n, (i // step + 1) * step)
            block = {top: saved[top]}
            for k in range(top - 1, i - 1, -1):
                block[k] = above(k, block[k + 1])
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        rest = (1 << (m - j)) - 1
        # leaving y[j] out loses nothing, leaving x[i] out would
        if block[i] >> (m - 1 - j) & 1 and (block[i] & rest).bit_count() < (block[i + 1] & rest).bit_count():
            j += 1
        else:
            i += 1
    return out


def expression(w: list) -> str:
    """The wrapper as a readable regular expression; ``#`` is a text slot."""
    mult = {(0, 0): "", (1, 0): "+", (0, 1): "?", (1, 1): "*"}[w[MANY], w[OPT]]
    if w[SIG] == "#text":
        return ("#" if w[TEXT] is None else json.dumps(w[TEXT], ensure_ascii=False)) + mult
    inside = " ".join(map(expression, w[KIDS]))
    if w[SIG].startswith("("):
        return f"({inside}){mult}"
    name = w[SIG].lstrip("!?~")
    return f"(<{name}> {inside} </>){mult}" if mult else f"<{name}> {inside} </>"


def _tag(sig: str) -> str:
    return re.split(r"[.#]", sig.lstrip("!?~"))[0]


def _is_named(sig: str) -> bool:
    """An article or main element, or a div with the class or role main."""
    tag = _tag(sig)
    return tag in ("article", "main") or tag == "div" and "main" in re.findall(r"\.([^.#]+)", sig)


def _named(w: list, path: list[str] | None = None):
    """Paths and wrappers of the outermost elements whose tag or class says that they hold the article."""
    path = path or []
    for c in w[KIDS]:
        sig = c[SIG]
        if sig.startswith(("!", "?")):
            continue
        if sig.startswith("("):
            yield from _named(c, path)
            continue
        if _is_named(sig):
            yield [*path, sig], c
        else:
            yield from _named(c, [*path, sig])


def template(w: list) -> str:
    """Pages of a host are of one template if their article or main elements stand under the same tags."""
    return " ".join(sorted({"/".join(map(_tag, path)) for path, _ in _named(w)}))


def _key(path: list[str], same: str) -> str:
    return _digest("\n".join([*path, same]))


def rule(w: list) -> dict:
    """What a template's wrapper says: ``region``, the path to the article ("named": every article or main element
    of the page; []: the whole page), and ``drops``, the keys of the constants and of
    the menus and the like in it whose names hint at it and that are mostly links."""

    def constant(k, least):
        return k[SAME] and len(k[SEEN]) >= least and k[PAGES] >= CONSTANT_SHARE * w[PAGES]

    def linked(k):
        return k[SIG].startswith("~") and 2 * k[LINKS] >= k[CHARS] > 0

    def slots(k, least, inside):  # text of the subtree outside boilerplate, links and constants
        if k[SIG].startswith("!") or k[SIG].startswith("?") and not inside or linked(k):
            return 0
        if k[SIG] == "#text":
            return 0 if constant(k, least) else k[CHARS] - k[LINKS]
        inside = inside or _tag(k[SIG]) in ("article", "main")
        return sum(slots(c, least, inside) for c in k[KIDS])

    never = MOST + 1
    whole, least = slots(w, FEW, False), FEW
    if 2 * whole < slots(w, never, False):
        whole, least = slots(w, MOST, False), MOST
    if not whole:
        whole, least = slots(w, never, False), never
    named: dict[tuple, int] = {}
    for path, k in _named(w):
        named[tuple(path)] = named.get(tuple(path), 0) + slots(k, least, True)
    best = max(named, key=named.get, default=())
    if best and 2 * named[best] > whole:
        region = list(best)
    else:  # elements of several class names may hold the article of one page each
        region = "named" if 2 * sum(named.values()) > whole else []
    drops = set()

    def collect(k, path):
        for c in k[KIDS]:
            if c[SIG] == "#text":
                if constant(c, least):
                    drops.add(_key(path, c[SAME]))
            elif linked(c):
                drops.add(_key(path, c[SIG]))
            elif not c[SIG].startswith("!"):
                collect(c, path if c[SIG].startswith("(") else [*path, c[SIG]])

    for path, k in _within(w, region):
        collect(k, path)
    return {"region": region, "drops": sorted(drops)}


def _within(w: list, region: list[str] | str) -> list:
    """Paths and wrappers that the region stands for; the whole page if it is not there."""
    found = [(path, k) for path, k in _named(w) if region == "named" or path == region] if region else []
    return found or [([], w)]


def text_of(html: str, rules: dict) -> str:
    """Texts of the blocks that the rule of the page's template keeps."""
    blocks: list[str] = []
    w = wrapper_of(parse(html), blocks=blocks)
    of = rules.get(template(w)) or {"region": [], "drops": []}
    drops, ids = frozenset(of["drops"]), []

    def walk(k, path, inside):
        for c in k[KIDS]:
            sig = c[SIG]
            if sig == "#text":
                if not (drops and c[SAME] and _key(path, c[SAME]) in drops):
                    ids.extend(c[IDS])
            elif not (sig.startswith("!") or sig.startswith("?") and not inside
                      or sig.startswith("~") and drops and _key(path, sig) in drops):
                walk(c, path if sig.startswith("(") else [*path, sig],
                     inside or _tag(sig) in ("article", "main"))

    for path, k in _within(w, of["region"]):
        walk(k, path, bool(path))
    return "\n\n".join(blocks[i] for i in sorted(ids))


@lru_cache(256)
def _rules(text: str) -> dict:
    return {k: json.loads(v) for k, v in json.loads(text).items()}


def _host():
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, template, wrapper (JSON), expression, rule (JSON), pages: one row per host and template."""
    texts = pages.select(F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    texts = texts.select(_host().alias("host"), "html")

    def run(batches):
        own: dict[tuple[str, str], list] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = wrapper_of(parse(html), zlib.crc32(html.encode("utf-8", "surrogatepass")))
                    key = host, template(w)
                    own[key] = merge(own[key], w) if key in own else w
                if len(own) > 2_000:
                    yield out(own)
                    own = {}
        yield out(own)

    def out(own):
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()),
             pa.array([json.dumps(w) for w in own.values()], pa.string())], names=["host", "template", "wrapper"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in sorted(pdf["wrapper"]):
            w = json.loads(text)
            total = w if total is None else merge(total, w)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": [pdf["template"].iloc[0]],
                             "wrapper": [json.dumps(total)]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        got = join(pdf)
        w = json.loads(got["wrapper"].iloc[0])
        return got.assign(expression=expression(w), rule=json.dumps(rule(w)), pages=w[PAGES])

    parts = texts.mapInArrow(run, "host string, template string, wrapper string")
    some = parts.groupBy("host", "template", F.pmod(F.xxhash64("wrapper"), F.lit(SPREAD))).applyInPandas(
        join, "host string, template string, wrapper string")
    return some.groupBy("host", "template").applyInPandas(
        finish, "host string, template string, wrapper string, expression string, rule string, pages long")


def rules_of(wrappers: DataFrame) -> DataFrame:
    """host, rules: the rules of the host's templates as one JSON object."""
    return wrappers.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("template", "rule")))).alias("rules"))


def extract(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # Spark broadcasts the rules where their size, known by now, is small
    rows = rows.withColumn("host", _host()).join(rules, "host", "left")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [text_of(h, _rules(r or "{}"))
                         for h, r in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()),
                                                  pa.array(list(map(len, texts)), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "rules").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")


def main_text(pages: DataFrame, **columns: str) -> DataFrame:
    known = {k: v for k, v in columns.items() if k in ("url_col", "html_col")}
    return extract(pages, materialize(rules_of(induce(pages, **known))), **columns)
