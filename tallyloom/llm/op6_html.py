"""Main text of web pages: site templates are subtrees that recur across many pages of a host."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import as_id, in_small_batches
from tallyloom.llm.shingles import GROUP, in_groups
from tallyloom.shared import cut

#: Distinct pages of a host in which a subtree has to recur to be part of the site's template, whatever the host's size.
LEAST_PAGES = 3

#: An attribute's value, and a tag's name and attributes. A quote opens a value only behind an equals sign, as in the HTML
#: standard; where it is never closed, the tag ends at the next sign of greater. A tag that the page's end cuts off is no
#: text. Nothing is tried twice (possessive repetition), so time is in proportion to the page.
_VALUE = r"""\"[^\"]*+\"|'[^']*+'|[^\s>"'][^\s>]*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|"
    rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|(?:=|[^\s/>=])[^\s/>=]*+(?:\s*+=\s*+(?:{_VALUE}))?+)*+)(?:>|\Z)",
    re.S | re.I,
)
#: Elements left out with all that is in them, unless they close themselves; without an end tag the first four reach to the end of the page.
_TO_END = frozenset("script style iframe textarea".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in (*_TO_END, "noscript", "template", "svg", "object")}
_ATTRIBUTE = re.compile(rf"([^\s/>=]++)(?:\s*+=\s*+({_VALUE}))?+")
_PART = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody tfoot thead title tr ul".split()
)
_CELL = frozenset(("td", "th", "br"))
#: An opening tag of the left closes an open one of the right.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
_NOT_CONTENT = frozenset("head nav footer aside form button select dialog menu search fieldset label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names and ids of what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription paywall sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager share sharing social related recommended recommendations comment comments respond replies disqus footer "
    "masthead topbar widget widgets toolbar login signup search skip".split()
)
#: Names among these of what may hold articles that aren't the page's own.
_LISTS = frozenset("related recommended recommendations comment comments respond replies disqus".split())
#: Before a name: the class of a wrapper that tells what is or isn't beside the article.
_BESIDE = frozenset("no not non with without has".split())
#: Beside a name: what only tells what kind of element has it.
_KIND = frozenset(
    "area articles bar block body bottom box button buttons container content field fixed form group inner item items left link links list "
    "main module outer panel posts right row section slot sticky stories text thread title top unit wrap wrapper".split()
)
#: What carries an article's own words: never taken for a template inside the article.
_CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr table figcaption figure b i em strong a span ul ol dl article main".split())


@dataclass
class _Node:
    tag: str
    drop: bool
    inside: bool
    holds_main: bool = False
    text: bool = False
    hash: object = field(default_factory=xxhash.xxh64)
    blocks_from: int = 0
    name: int = 0


_NAMED = ("first", "past", "name", "within", "holds")
_NAMED_TYPE = pa.struct([(n, pa.bool_() if n in ("within", "holds") else pa.int32()) for n in _NAMED])
#: What a class or id says: nothing, perhaps none of the article, surely none, or a list of others' articles.
_NONE, _PERHAPS, _SURELY, _LIST = range(4)


def _named(value: str, inside: bool) -> int:
    """What the names in a class or id say; a name beside a word that isn't a kind of element isn't sure."""
    found = _NONE
    for token in value.split():
        parts = [x for x in _PART.split(token) if x]
        hits = [x for k, x in enumerate(parts) if (x in _NAMES or (x == "header" and not inside)) and not (k and parts[k - 1] in _BESIDE)]
        if hits:
            sure = all(x in hits or x in _KIND for x in parts)
            found = max(found, _PERHAPS if not sure else _SURELY if _LISTS.isdisjoint(hits) else _LIST)
    return found


def _dropped(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """Whether an element is none of the article by its tag, role or style, and what its class and id say."""
    if tag in _NOT_CONTENT or (tag == "header" and not inside):
        return True, _NONE
    found = _NONE
    if not attributes.strip(" /"):
        return False, found
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            found = max(found, _named(value, inside))
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, found
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True, found
    return False, found


def covered(ranges: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges [a, z)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for a, z in ranges:
        edge[a] += 1
        edge[z] -= 1
    return np.cumsum(edge[:n]) > 0


class Page:
    """One pass over a page: its blocks of text and the hashes of its subtrees.

    blocks: (text, inside article or main, dropped); subtrees: (hash, first block, block after the last) of those that
    could be part of a template: not those that hold an article, and of those inside an article only such as don't
    carry its words (see _CONTENT).
    """

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, bool]] = []
        self.subtrees: list[tuple[int, int, int]] = []
        self.named: list[tuple[int, int, int, bool, bool]] = []
        self.parts: list[str] = []
        self.stack = [_Node("", False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, and of all blocks
        at, unclosed = 0, set()
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
            elif tag not in _RAW:
                self._open(tag, m[3] or "")
            elif not m[3].endswith("/"):
                end = None if tag in unclosed else _RAW[tag].search(source, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
                    at = len(source) if tag in _TO_END else at
        if at < len(source):
            self._text(source[at:])
        self._flush()
        while len(self.stack) > 1:
            self._pop()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if not text.isspace():
            node = self.stack[-1]
            node.text = True
            node.hash.update(" ".join(text.split()).encode("utf-8", "replace"))

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            top = self.stack[-1]
            self.blocks.append((text, top.inside, top.drop))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in _CELL:
            self.parts.append(" ")
        if tag in _VOID:
            if tag in _BLOCK:
                self._flush()
            return
        last = lambda *tags: max((self.places[t][-1] for t in tags if self.places[t]), default=0)
        if tag in _BLOCK:
            self._flush()
            if (k := last("p")) and k >= last(*_CELL, "block"):  # an open paragraph ends here
                self._pop_to(k)
        if tag in _CLOSES and (k := last(*_CLOSES[tag])) > last(*_SCOPE.get(tag, ("table",))):
            if tag in _BLOCK:
                self._flush()
            self._pop_to(k)
        up = self.stack[-1]
        drop, name = _dropped(tag, attributes, up.inside)
        drop |= up.drop
        self.stack.append(_Node(tag, drop, up.inside or (tag in ("article", "main") and not drop), blocks_from=len(self.blocks), name=_NONE if drop else name))
        for t in (tag, "block") if tag in _BLOCK else (tag,):
            self.places[t].append(len(self.stack) - 1)
        self.stack[-1].hash.update(tag.encode("utf-8", "replace"))
        if attributes.endswith("/") and tag not in _BLOCK:
            self._pop()

    def _close(self, tag: str) -> None:
        if tag in _BLOCK or tag in _CELL:
            self._flush() if tag in _BLOCK else self.parts.append(" ")
        at = self.places[tag]
        if at and (tag in _BLOCK or not self.places["block"] or self.places["block"][-1] < at[-1]):  # a stray end tag doesn't end the block around it
            self._pop_to(at[-1])

    def _pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            self._pop()

    def _pop(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1]
        for t in (node.tag, "block") if node.tag in _BLOCK else (node.tag,):
            self.places[t].pop()
        digest = node.hash.intdigest()
        up.hash.update(digest.to_bytes(8, "little"))
        up.text |= node.text
        up.holds_main |= node.holds_main or node.tag in ("article", "main", "body")
        if node.name and len(self.blocks) > node.blocks_from:
            self.named.append((node.blocks_from, len(self.blocks), node.name, up.inside, node.holds_main or node.tag in ("article", "main")))
        if node.text and node.tag in _BLOCK and node.tag not in ("html", "body", "head") and not node.holds_main and not (node.inside and node.tag in _CONTENT):
            self.subtrees.append((digest - (1 << 63), node.blocks_from, len(self.blocks)))

    def kept(self) -> tuple[list[str], list[bool], list[tuple[int, int, int]], list[tuple[int, int, int, bool, bool]]]:
        """Blocks that aren't dropped by tag, role or style, whether they are in an article, and the subtrees and named elements that cover any of them."""
        at = list(accumulate((not drop for _, _, drop in self.blocks), initial=0))
        texts, insides = [t for t, _, drop in self.blocks if not drop], [inside for _, inside, drop in self.blocks if not drop]
        return texts, insides, [(d, at[a], at[z]) for d, a, z in self.subtrees if at[a] < at[z]], [(at[a], at[z], *more) for a, z, *more in self.named if at[a] < at[z]]

    def main_text(self, template: set[int]) -> str:
        """What is left without the template and what else is none of the article."""
        return main_of(*self.kept(), template)


def marked(size: np.ndarray, inside: np.ndarray, named: Iterable[tuple[int, int, int, bool, bool]]) -> np.ndarray:
    """Which blocks classes and ids mark, but not what holds the article. size is 0 for blocks that are gone.

    Inside an article an element whose name isn't sure stays, as does one that holds articles with half or more of the
    articles' text; where no article stays, one whose name isn't sure stays with half or more of the page's text. The
    articles of comments and the like count only where they are more than all other text.
    """
    n = len(size)
    inner = size * inside
    listed = covered([(a, z) for a, z, name, _, _ in named if name == _LIST], n)
    upto, inner_upto = (np.concatenate([[0], np.cumsum(x)]) for x in (size, inner))
    others, own, total = int(size[~listed].sum()), int(inner[~listed].sum()), int(inner.sum())
    loose, gone = [], []
    for a, z, name, within, holds in named:
        held = int(inner_upto[z] - inner_upto[a])
        if name == _LIST:
            stays = holds and 2 * held >= total and held > others
        elif name == _PERHAPS and within:
            stays = True
        else:
            stays = held > 0 and holds and 2 * held >= own
            if not stays and not holds and name == _PERHAPS and 2 * int(upto[z] - upto[a]) >= others:
                loose.append((a, z))
                continue
        if not stays:
            gone.append((a, z))
    return covered(gone + loose if inner[~covered(gone, n)].sum() else gone, n)


def main_of(texts: list[str], insides: list[bool], subtrees: Iterable[tuple[int, int, int]], named: Iterable[tuple[int, int, int, bool, bool]], template: set[int]) -> str:
    """The blocks outside the subtrees of the template, then without what names mark; only those of articles, if these are half or more of the text."""
    size, inside = np.array(list(map(len, texts)), dtype=np.int64), np.array(insides, dtype=bool)
    size[covered([(a, z) for digest, a, z in subtrees if digest in template], len(texts))] = 0
    if named := list(named):
        size[marked(size, inside, named)] = 0
    whole = 2 * int(size[inside].sum()) < int(size.sum())
    return "\n\n".join(t for t, n, x in zip(texts, size, inside, strict=True) if n and (x or whole))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars).

    1. Every page gives the distinct hashes of its subtrees, rows of (host, page, subtree), where page is a digest of
       its html, so copies of one page count once. Those found in LEAST_PAGES pages of a host or more, counted with
       partial aggregation, are its template.
    2. The rows meet the template by host and subtree (a join that AQE splits where skewed) and are gathered by page:
       each page has its own subtrees that are template, never more than it has subtrees.
    3. Pages meet these by host and page, as blocks of text without what tags and roles say is a menu, header, footer,
       sidebar, dialog or form. The template's subtrees are deleted first; of the rest classes and ids mark notices,
       adverts, sidebars and comments, but never what holds the article's words. Articles are the text where they are
       half or more of what is left, else all of that is.

    Nulls: a null html counts as empty; a null url stays null, and such pages count as one host without name; a null id
    stays null. Empty html: empty text. Very long html: one page at a time in memory, time in proportion. Ties and
    repeated rows: each row has its own result. Empty table: no rows. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = in_small_batches(pages).select(as_id(pages, id_col, "page_id"), pages[url_col].cast("string").alias("url"), host.alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))

    def digest_of(source: str) -> int:
        return xxhash.xxh64_intdigest(source.encode("utf-8", "replace")) - (1 << 63)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches):
            hosts, sources, digests = [], [], []
            for name, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {d for d, _, _ in Page(source).subtrees}
                hosts += [name] * len(found)
                sources += [digest_of(source)] * len(found)
                digests += found
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(sources, pa.int64()), pa.array(digests, pa.int64())], names=["host", "page", "subtree"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_groups(batches, "html"):
            sources = b.column("html").to_pylist()
            texts, insides, found, named = zip(*(Page(x).kept() for x in sources), strict=True) if sources else ((), (), (), ())
            columns = [pa.array([[s[k] for s in x] for x in found], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            columns.append(pa.array([[dict(zip(_NAMED, x, strict=True)) for x in page] for page in named], pa.list_(_NAMED_TYPE)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "url", "host")), pa.array(map(digest_of, sources), pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(insides, pa.list_(pa.bool_())), *columns], names=["page_id", "url", "host", "page", "texts", "insides", "subtrees", "first", "past", "named"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, GROUP) for whole in batches for at in range(0, whole.num_rows, GROUP)):
            c = [b.column(n).to_pylist() for n in ("texts", "insides", "subtrees", "first", "past", "named", "template")]
            out = [main_of(t, inside, zip(d, a, z, strict=True), (tuple(x.values()) for x in named), set(found or ())) for t, inside, d, a, z, named, found in zip(*c, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    seen = cut(base.select("host", "html").mapInArrow(subtrees, "host string, page long, subtree long").distinct(), "subtrees")
    template = seen.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_PAGES).select("host", "subtree")
    own = seen.join(template, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("template"))
    parsed = base.mapInArrow(blocks, "page_id long, url string, host string, page long, texts array<string>, insides array<boolean>, subtrees array<long>, first array<int>, past array<int>, named array<struct<first:int,past:int,name:int,within:boolean,holds:boolean>>")
    return parsed.join(own, ["host", "page"], "left").select("page_id", "url", "texts", "insides", "subtrees", "first", "past", "named", "template").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
