"""Main text of web pages, by site style trees.

A page is read into a tree of elements. The trees of one host's pages are merged: nodes are the same if their chains
of tags and classes are; they are known by hashes of (parent, tag and classes). Each merged node has two measures, both from 0 to 1
over the pages that have it: of presentation, the entropy of the sequences of children that it is shown with, and of
content, the entropy of its texts. A node that many pages have and that looks and reads the same on nearly all is of
low importance, and its text is cut from each page, within an element marked as the article too; so are rare nodes in
a branch that holds nothing of importance. Nodes that many pages have with differing texts stay, outside such elements
too. The mark decides only for nodes that too few pages have to be judged.

Entropies can't tell what differs from page to page and is no article all the same: link lists, readers' comments,
footers with a changing line. So what the page itself says comes first: elements that are menus, footers, forms and the like
by tag or role, are hidden, or have a class that is one of NOISE_NAMES as a whole (an id counts as a class, but not a
heading's; a section's, mostly the slug of its heading, only if it is one of SECTION_NAMES). Nodes that only a class or id marks
are in the tree like all others.

Pages count once for each host that has them, however often they are repeated: those are the same whose nodes, children
and texts are, whatever their scripts, comments and adverts hold. Only hashes of contents leave the mappers, once for
each distinct page of a slice; counts of (host, node, content) are summed before the shuffle; a host's list of judged nodes is small,
and joined to its pages (Spark broadcasts it where its size is known to allow it, and splits a hot host else).

Defined results: a null or empty page has an empty text; a page without a host is judged by itself; of the nodes
that can't be judged only those in `article` or `main` elements count, if these hold half of the page's text or more
(a smaller one is a teaser or a card); repeated pages give the same text each; malformed markup is read as browsers do in the main
points (implied and missing end tags), in time that grows with the page alone; a tag that never ends is text, with all after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import _words as W
from pathloom.llm._shared import map_batches, materialize, table

#: A merged node is judged from so many pages on, and is low under this importance.
MIN_PAGES, LOW = 5, 0.3

#: A tag up to where it ends. Quotes count after an equals sign only. Nothing matches in two ways, so nothing is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>?)""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: References to characters by numbers that none has.
_NO_CHARACTER = re.compile(r"&#0*+[1-9][0-9]{7,}+;?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br-block caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these ends an open element of those.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Where the search for an element to end by implication stops.
FENCES = frozenset("ul ol dl table article section div main body aside nav form blockquote td th".split())
NOISE_TAGS = frozenset("nav aside footer form script style noscript template iframe button select textarea input label menu dialog head svg canvas object embed title".split())
#: Whole names of classes and ids.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle ad-banner ad-slot banner banners breadcrumb breadcrumbs comment comments comment-list commentlist comment-section cookie cookies cookie-banner cookie-notice consent disqus disqus_thread footer site-footer page-footer gdpr header site-header page-header login masthead menu menus main-menu modal nav navbar nav-bar navigation newsletter notice notices alert pager pagination popup promo promoted promotion related related-posts related-articles reply replies respond share sharing share-buttons sidebar side-bar signup sign-up skip skip-link social social-links social-share sponsor sponsored subscribe subscription toolbar topbar top-bar widget widgets".split()
)
SECTION_NAMES = frozenset("breadcrumb breadcrumbs comment-list commentlist comments disqus disqus_thread masthead menu nav navbar pager pagination respond sidebar toolbar topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ARTICLE = frozenset(["article", "main"])


class _Element:
    """An open element. noise: by tag, role or being hidden, here or above; marked: by class or id, here or above."""

    __slots__ = ("children", "main", "marked", "node", "noise", "owner", "parent", "tag", "under")

    def __init__(self, tag: str, node: int, parent: _Element | None, noise: bool, marked: bool, main: bool, under: bool) -> None:
        self.tag, self.node, self.parent, self.noise, self.marked, self.main, self.under = tag, node, parent, noise, marked, main, under
        self.children: list[str] = []
        #: What a text in here belongs to.
        self.owner = self if parent is None or tag in BLOCK or (noise, marked) != (parent.noise, parent.marked) else parent.owner


def hash_of(*texts: str) -> int:
    return int.from_bytes(blake2b("\x00".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _open(tag: str, attributes: str, parent: _Element, branches: frozenset[int] | set[int]) -> _Element:
    name, noise, marked = tag, tag in NOISE_TAGS or tag == "header" and not parent.main, False
    if attributes.strip():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        classes = sorted(found.get("class", "").lower().split())
        if classes:
            name += "." + ".".join(classes)
        noise = noise or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in NOISE_ROLES or bool(_HIDDEN.search(found.get("style", "").lower()))
        own = found.get("id", "").strip().lower()
        by_id = tag not in HEADINGS and own in (SECTION_NAMES if tag == "section" else NOISE_NAMES)
        marked = tag not in ARTICLE and tag not in ("html", "body") and (by_id or not NOISE_NAMES.isdisjoint(classes))
    parent.children.append(name)
    node = hash_of(str(parent.node), name)
    return _Element(tag, node, parent, noise or parent.noise, marked or parent.marked, parent.main or tag in ARTICLE, parent.under or node in branches)


def plain(text: str) -> str:
    """text with its character references decoded."""
    return unescape(_NO_CHARACTER.sub("�", text)) if "&" in text else text


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, what, attributes) of texts (kind "text") and of opened ("open") and closed ("close") elements, in one pass."""
    at = begin = 0
    size = len(html)
    while (i := html.find("<", at)) >= 0:
        after, kind, tag, attributes = i + 1, "", "", ""
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            after = size if end < 0 else end + 3
        elif html.startswith(("!", "?"), i + 1):
            end = html.find(">", i)
            if end < 0:
                break
            after = end + 1
        elif m := _TAG.match(html, i):
            if not m[4]:
                break
            kind, tag, attributes, after = "close" if m[1] else "open", m[2].lower(), m[3], m.end()
        else:
            at = after
            continue
        if i > begin:
            yield "text", html[begin:i], ""
        if kind == "open" and tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?![a-zA-Z0-9-])", re.I).search(html, after)
            end = html.find(">", end.end()) if end else -1
            after = size if end < 0 else end + 1
        elif kind:
            yield kind, tag, attributes
        at = begin = after
    if begin < size:
        yield "text", html[begin:], ""


def blocks(html: str, elements: list[_Element] | None = None, branches: frozenset[int] | set[int] = frozenset()) -> list[tuple[_Element, str]]:
    """(element, text) of each block, in page order. elements gets all that were opened; branches: nodes, for the elements' `under`."""
    root = _Element("", 0, None, False, False, False, False)
    stack, out, text = [root], [], []
    open_at: dict[str, list[int]] = {}
    fences: list[int] = []

    def flush() -> None:
        nonlocal text
        if text:
            if whole := " ".join("".join(text).split()):
                out.append((stack[-1].owner, whole))
            text = []

    def apart(e: _Element) -> bool:
        up = e.parent
        return e.tag in BLOCK or (e.noise, e.marked, e.main) != (up.noise, up.marked, up.main)

    def push(e: _Element) -> None:
        if apart(e):
            flush()
        open_at.setdefault(e.tag, []).append(len(stack))
        if e.tag in FENCES:
            fences.append(len(stack))
        stack.append(e)

    def pop() -> None:
        gone = stack[-1]
        if apart(gone):
            flush()
        stack.pop()
        open_at[gone.tag].pop()
        if gone.tag in FENCES:
            fences.pop()
        if elements is not None:
            elements.append(gone)

    for kind, tag, attributes in tokens(html):
        if kind == "text":
            text.append(plain(tag))
        elif kind == "close":
            if open_at.get(tag):
                depth = open_at[tag][-1]
                while len(stack) > depth:
                    pop()
            elif tag == "p":
                flush()
        elif tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br":
                text.append(" ")
        else:
            if tag in BLOCK and open_at.get("p") and (not fences or fences[-1] < open_at["p"][-1]):
                depth = open_at["p"][-1]
                while len(stack) > depth:
                    pop()
            if ended := ENDS.get(tag):
                # The innermost element to end, unless there is a fence in it.
                depth = max((open_at[t][-1] for t in ended if open_at.get(t)), default=0)
                if depth and not (fences and fences[-1] > depth):
                    while len(stack) > depth:
                        pop()
            push(_open(tag, attributes, stack[-1], branches))
    flush()
    while len(stack) > 1:
        pop()
    return out


#: States of a judged node: without text of its own, of low importance, of high importance, and this though marked by class or id.
WAY, IS_LOW, IS_HIGH, IS_MARKED = range(4)


class Judged:
    """A host's judged nodes: low and high ones, and branches: low ones that lead to no high one."""

    def __init__(self, nodes: Iterable[tuple[int, int, int]] = ()) -> None:
        """nodes: (node, parent, state)."""
        up, state = {n: parent for n, parent, _ in nodes}, {n: s for n, _, s in nodes}
        self.low = {n for n, s in state.items() if s == IS_LOW}
        self.high = {n for n, s in state.items() if s >= IS_HIGH}
        leads: set[int] = set()
        for n, s in state.items():
            while s == IS_HIGH and (n := up.get(n)) is not None and n not in leads:
                leads.add(n)
        self.branches = frozenset(self.low - leads)


def main_text(html: str | None, judged: Judged | None = None) -> str:
    """Blocks of importance, one a line."""
    judged = judged or Judged()
    found = []
    for e, text in blocks(html or "", None, judged.branches):
        if e.noise or e.marked:
            continue
        if e.node in judged.high or e.node not in judged.low and not e.under:
            found.append((e, text))
    marked = sum(len(t) for e, t in found if e.main)
    trusted = 2 * marked >= sum(len(t) for _, t in found)
    return "\n".join(t for e, t in found if e.main or not marked or not trusted or e.node in judged.high)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def contents(html: str) -> tuple[int, list[tuple[int, int, bool, int, int]]]:
    """A hash of the page, and (node, parent, whether marked, kind, what) of its nodes; kind 0: hash of children, 1: of texts.

    What is noise by its tag isn't looked into, and what is marked by class or id isn't in the page's hash.
    """
    elements: list[_Element] = []
    texts: dict[int, list[str]] = {}
    known: dict[int, tuple[int, bool]] = {}
    for e, text in blocks(html, elements):
        if not e.noise:
            texts.setdefault(e.node, []).append(text)
            known[e.node] = e.parent.node if e.parent else 0, e.marked
    shown: dict[int, list[str]] = {}
    for e in elements:
        if not e.noise and e.tag not in ("html", "body"):
            shown.setdefault(e.node, []).append(" ".join(e.children))
            known[e.node] = e.parent.node, e.marked
    seen = sorted((node, *known[node], kind, hash_of(*what)) for kind, each in ((0, shown), (1, texts)) for node, what in each.items())
    return hash_of(repr([x for x in seen if not x[2]])), seen


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, seen), once for each distinct page of a slice, of equal ones the least; page: the page's hash."""
    names = ("node", "parent", "marked", "kind", "what")
    kind_of_seen = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()), strict=True))))
    for batch in batches:
        for part in W.slices(batch, "html"):
            found: dict[tuple, list[tuple]] = {}
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                page, seen = contents(html or "")
                if seen:
                    found[host, page] = min(seen, found.get((host, page), seen))
            if found:
                host, page = zip(*found, strict=True)
                seen = [[dict(zip(names, x, strict=True)) for x in each] for each in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(seen, kind_of_seen)], names=["host", "page", "seen"])


def judged_nodes(pages: DataFrame) -> DataFrame:
    """host, and nodes: (node, parent, state) of those that enough pages have. pages has host and html."""
    seen = pages.where("host <> ''").select("host", "html").transform(map_batches, _seen, "host string, page long, seen array<struct<node: long, parent: long, marked: boolean, kind: int, what: long>>")
    seen = seen.groupBy("host", "page").agg(F.min("seen").alias("seen")).select("host", F.inline("seen"))
    seen = seen.groupBy("host", "node", "parent", "marked", "kind", "what").agg(F.count("*").alias("c"))
    both = seen.groupBy("host", "node", "parent", "marked", "kind").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
    # Entropy of counts c that sum to m, as a share of its maximum log m.
    entropy = (F.log("m") - F.col("clogc") / F.col("m")) / F.log("m")
    judged = both.where(F.col("m") >= MIN_PAGES).withColumn("entropy", entropy)
    merged = judged.groupBy("host", "node", "parent", "marked").agg(F.max("entropy").alias("importance"), F.max("kind").alias("has_text"))
    state = F.when(F.col("has_text") == 0, WAY).when(F.col("importance") < LOW, IS_LOW).when(F.col("marked"), IS_MARKED).otherwise(IS_HIGH)
    return merged.groupBy("host").agg(F.collect_list(F.struct("node", "parent", state.alias("state"))).alias("nodes"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "html"):
            known: dict[str, Judged] = {}
            texts = []
            for host, html, nodes in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), part.column("nodes"), strict=True):
                if host not in known:
                    known[host] = Judged([tuple(x.values()) for x in nodes.as_py() or ()])
                texts.append(main_text(html, known[host]))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each page."""
    known = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    judged = materialize(judged_nodes(known), "judged-nodes")
    return known.join(judged, "host", "left").select("page_id", "url", "html", "host", "nodes").transform(map_batches, _extract, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
