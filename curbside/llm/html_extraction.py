"""Main text of web pages by wrapper induction.

1. Every page is parsed into a tree. Siblings with one label (tag, class, id, role) fold into one slot, so a page of
   any length has a small skeleton: the slots in document order, each with its parent and what text it held.
2. Over all pages, Spark counts for each (host, skeleton, slot): pages, text length, smallest and largest text hash.
   A slot whose hashes agree on all pages is constant.
3. The skeletons of a host, one row each, are aligned by simple tree matching and merged into the host's wrapper:
   matched slots add their counts, unmatched ones are inserted. Slots under menus, headers, footers and the like, and
   slots that stay constant while the page around them varies, are template. The main region is the article or main
   element, or else the subtree that holds most of the varying text; its other slots are content.
4. Each skeleton is aligned with its host's wrapper once more, which says slot by slot what text its pages keep.

Text of one block is joined with single spaces, blocks in page order too; character references are decoded. Null
and empty html give an empty text. Pages without url form a host of their own; repeated rows give repeated results.
A truncated page is read as far as it goes.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, clean_ids, map_batches, partitions, query, table

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "li", "dd", "dt"}
BOILER_TAGS = frozenset("nav header footer aside form button select input textarea menu dialog fieldset label option".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promotions nav navbar navigation menu menubar topnav subnav "
    "header masthead footer foot bottombar topbar sidebar side aside rail widget widgets breadcrumb breadcrumbs pagination pager comment comments commentlist respond "
    "disqus reply replies discussion cookie cookies consent gdpr notice notices notification notifications alert alerts warning popup modal overlay lightbox newsletter "
    "subscribe subscription signup login register search searchbox share sharing social related recommended recommendations trending popular "
    "copyright legal disclaimer toolbar skip".split()
)
MAIN_TAGS, MAIN_WORDS = frozenset(["article", "main"]), frozenset("article articlebody post postbody entry content main maincontent story storybody".split())

# A quote opens a value only after "="; a value that is not closed goes to the end of the text.
_VALUE = r"""=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE})*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>"'][^\s>]*+)))?+""")
_NAMED = re.compile(r"class|id|role|itemprop|hidden", re.IGNORECASE)
MARKS = frozenset("class id role itemprop hidden".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Slot:
    label: str
    parent: int
    children: dict[str, int] = field(default_factory=dict)
    text: list[str] = field(default_factory=list)


class Page:
    """The folded tree and, in page order, (slot, block number, text)."""

    def __init__(self, markup: str | None):
        self.slots = [Slot("", -1)]
        self.pieces: list[tuple[int, int, str]] = []
        self._block = 0
        self._parse(markup or "")

    def _enter(self, parent: int, label: str) -> int:
        known = self.slots[parent].children
        if label not in known:
            known[label] = len(self.slots)
            self.slots.append(Slot(label, parent))
        return known[label]

    def _say(self, slot: int, raw: str) -> None:
        if raw:
            self.pieces.append((slot, self._block, html.unescape(raw)))

    def _parse(self, markup: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        at = 0
        while True:
            m = _TOKEN.search(markup, at)
            # a "<" that opens nothing is text
            self._say(stack[-1][1], markup[at : m.start() if m else len(markup)])
            if not m:
                return
            at = m.end()
            if m.group(2) is None:
                continue
            tag = m.group(2).lower()
            if m.group(1):
                if tag == "p" and all(t != "p" for t, _ in stack):
                    self._block += 1
                elif any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                if tag in BLOCK:
                    self._block += 1
                continue
            if tag in BLOCK:
                self._block += 1
            self._imply_end(stack, tag)
            slot = self._enter(stack[-1][1], _label(tag, m.group(3)))
            if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "path"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(markup, at)
                self._say(slot, markup[at : end.start() if end else len(markup)])
                at = markup.find(">", end.end()) + 1 if end else len(markup)
                at = at or len(markup)
                continue
            stack.append((tag, slot))

    @staticmethod
    def _imply_end(stack: list[tuple[str, int]], tag: str) -> None:
        def close(names: frozenset[str], until: frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    del stack[k:]
                    return
                if stack[k][0] in until:
                    return

        if tag in CLOSES_P:
            close(frozenset(["p"]), frozenset("article section div td th li main body button table blockquote form".split()))
        if tag == "li":
            close(frozenset(["li"]), frozenset(["ul", "ol", "menu"]))
        elif tag in ("dt", "dd"):
            close(frozenset(["dt", "dd"]), frozenset(["dl"]))
        elif tag in ("td", "th"):
            close(frozenset(["td", "th"]), frozenset(["tr", "table"]))
        elif tag == "tr":
            close(frozenset(["tr"]), frozenset(["table"]))
        elif tag == "option":
            close(frozenset(["option"]), frozenset(["select"]))

    def skeleton(self) -> str:
        """Labels and parents in order of first appearance; equal for pages of one layout."""
        return "\n".join(f"{s.parent}\t{s.label}" for s in self.slots)

    def slot_texts(self) -> list[str]:
        out: list[list[str]] = [[] for _ in self.slots]
        for slot, _, text in self.pieces:
            out[slot].append(text)
        return [" ".join("".join(x).split()) for x in out]


def kept_text(pieces: Iterable[tuple[int, int, str]], keep: Sequence[bool]) -> str:
    """The pieces of kept slots; a space between blocks, none inside one."""
    out: list[str] = []
    last = -1
    for slot, block, text in pieces:
        if keep[slot]:
            out += [" ", text] if block != last else [text]
            last = block
    return " ".join("".join(out).split())


def _label(tag: str, attributes: str) -> str:
    if not attributes or not _NAMED.search(attributes):
        return tag
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in MARKS:
            found.setdefault(name.lower(), " ".join(html.unescape(next((v for v in values if v), "")).split()))
    marks = [f"{k}={re.sub(r'[0-9]+', '0', v)}" for k, v in sorted(found.items())]
    return " ".join([tag, *marks])


def host_of(url: str | None) -> str:
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].split(":", 1)[0].lower()


# --- roles ------------------------------------------------------------------

def _words(label: str) -> tuple[str, set[str]]:
    tag, _, rest = label.partition(" ")
    values = " ".join(x.partition("=")[2] if "=" in x else x for x in rest.split(" "))
    return tag, set(_WORD.findall(_CAMEL.sub(" ", values).lower()))


def is_boilerplate(label: str, inside: bool = False) -> bool:
    """Menus, headers, footers, sidebars, notices, adverts, forms, comments and what is never shown, by their label.

    inside: within the main region, where a header element holds the headline.
    """
    tag, words = _words(label)
    if tag in SILENT or "hidden=" in label:
        return True
    if tag in ("article", "main", "body", "html"):
        return False
    if inside and tag == "header":
        words -= {"header", "head"}
        tag = "div"
    return tag in BOILER_TAGS or not BOILER_WORDS.isdisjoint(words) or not BOILER_ROLES.isdisjoint(words)


def _main_rank(label: str) -> int:
    tag, words = _words(label)
    if tag == "article" or "articlebody" in words:
        return 3
    if tag == "main":
        return 2
    return int(tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(words))


# --- wrappers ---------------------------------------------------------------

@dataclass
class Node:
    """A wrapper slot: counts over the pages that have it, and whether its text is content."""

    label: str
    pages: int = 0
    chars: int = 0
    low: int = 2**63 - 1
    high: int = -(2**63)
    children: list["Node"] = field(default_factory=list)
    keep: bool = False

    def absorb(self, other: "Node") -> None:
        self.pages += other.pages
        self.chars += other.chars
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)

    def varies(self) -> bool:
        """Whether its text differs between pages, or only one page has it."""
        return self.low != self.high or self.pages < 2


def in_order(root: Node) -> list[Node]:
    """All nodes of a tree, parents before children, children in order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.children)
    return out


Matches = dict[tuple[int, int], tuple[int, list[tuple[int, int]]]]


def match_table(a: Node, b: Node) -> Matches:
    """Simple tree matching of all pairs of nodes (by id) that can be matched below two roots of equal label: the size of
    the largest order-keeping match of the two trees, and the pairs of children in it. Leaves come first, so no depth
    is too much and every pair is looked at once."""
    order, stack = [], [(a, b)] if a.label == b.label else []
    while stack:
        p, q = stack.pop()
        order.append((p, q))
        stack += [(x, y) for x in p.children for y in q.children if x.label == y.label]
    table: Matches = {}
    for p, q in reversed(order):
        x, y = p.children, q.children
        own = [[table[id(c), id(d)][0] if c.label == d.label else 0 for d in y] for c in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + own[i - 1][j - 1])
        pairs, i, j = [], len(x), len(y)
        while i and j:
            if own[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + own[i - 1][j - 1]:
                pairs.append((i - 1, j - 1))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        table[id(p), id(q)] = best[len(x)][len(y)] + 1, pairs[::-1]
    return table


def match(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Size of the match of two trees and the pairs of children in it; (0, []) for roots of different label."""
    return match_table(a, b).get((id(a), id(b)), (0, []))


def merge(a: Node, b: Node) -> None:
    """Adds tree b to wrapper a: matched nodes absorb, others are inserted after the last match before them."""
    table = match_table(a, b)
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        p.absorb(q)
        by_q = {j: i for i, j in table.get((id(p), id(q)), (0, []))[1]}
        children, done = [], 0
        for j, child in enumerate(q.children):
            if j in by_q:
                children += p.children[done : by_q[j] + 1]
                done = by_q[j] + 1
                stack.append((children[-1], child))
            else:
                children.append(child)
        p.children = children + p.children[done:]


def tree(slots: list[tuple[str, int, int, int, int]]) -> list[Node]:
    """slots: (skeleton line, pages, chars, low, high), in order. The nodes in that order; the first is the root."""
    nodes: list[Node] = []
    for line, *stats in slots:
        parent, label = line.split("\t", 1)
        nodes.append(Node(label, *stats))
        if len(nodes) > 1:
            nodes[int(parent)].children.append(nodes[-1])
    return nodes


def mark_content(root: Node) -> Node:
    """Sets `keep` on the wrapper nodes whose text is content."""
    weight: dict[int, int] = {}
    for node in reversed(in_order(root)):
        own = node.chars if node.varies() else 0
        weight[id(node)] = 0 if is_boilerplate(node.label) else own + sum(weight[id(c)] for c in node.children)
    total = weight[id(root)]
    marked = [n for n in _visible(root) if _main_rank(n.label) and weight[id(n)] * 4 >= total]
    best = max((_main_rank(n.label) for n in marked), default=0)
    regions = [n for n in marked if _main_rank(n.label) == best]
    if not regions:
        node = root
        while True:
            inner = max(node.children, key=lambda c: weight[id(c)], default=None)
            if inner is None or 10 * weight[id(inner)] < 7 * weight[id(node)] or _words(inner.label)[0] not in BLOCK | {""}:
                break
            if _words(inner.label)[0] in ("p", "h1", "h2", "h3", "li", "ul", "ol", "table", "blockquote", "pre"):
                break
            node = inner
        regions = [node]
    for region in regions:
        varying = sum(n.chars / n.pages for n in _visible(region, True) if n.pages and n.varies())
        for block in _blocks(region):
            keep = any(n.varies() for n in block) or not _is_template(block, varying) or block[0] is region or _words(block[0].label)[0] in ("h1", "h2")
            for n in block:
                n.keep = keep
    return root


def _is_template(block: list[Node], varying: float) -> bool:
    """Whether a block that is the same on all its pages is template: what varies around it, counted once for each
    further page that agrees, must outweigh it. So near copies of one article, a few words apart, keep their text."""
    held = [n for n in block if n.chars]
    agree = min((n.pages for n in held), default=0) - 1
    return sum(n.chars / n.pages for n in held) < varying * agree


def _visible(node: Node, inside: bool = False) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        if not is_boilerplate(node.label, inside):
            yield node
            stack += reversed(node.children)


def _blocks(region: Node) -> list[list[Node]]:
    """The visible nodes of a region, each block element with the inline elements in it."""
    out: list[list[Node]] = []
    stack: list[tuple[Node, list[Node]]] = [(region, [])]
    while stack:
        node, block = stack.pop()
        if _words(node.label)[0] in BLOCK or node is region:
            block = []
            out.append(block)
        block.append(node)
        stack += [(c, block) for c in reversed(node.children) if not is_boilerplate(c.label, True)]
    return out


def induce(trees: list[Node]) -> Node:
    """One wrapper of all the trees, those of most pages first."""
    trees = sorted(trees, key=lambda t: (-t.pages, dump(t)))
    for t in trees[1:]:
        merge(trees[0], t)
    return trees[0]


def flags(wrapper: Node, nodes: list[Node]) -> list[bool]:
    """For each node of a page's tree, whether its text is content. A node without a partner follows its parent.

    A layout that has text but none where the wrapper has its main region is judged by itself.
    """

    table = match_table(wrapper, nodes[0])
    stack: list[tuple[Node | None, Node, bool]] = [(wrapper, nodes[0], False)]
    while stack:
        w, node, inside = stack.pop()
        node.keep = w.keep if w else inside and not is_boilerplate(node.label, True)
        partner = {j: w.children[i] for i, j in table.get((id(w), id(node)), (0, []))[1]} if w else {}
        stack += [(partner.get(j), child, node.keep) for j, child in enumerate(node.children)]
    if not any(n.keep and n.chars for n in nodes):
        for n in nodes:
            n.keep = False
        mark_content(nodes[0])
    return [n.keep for n in nodes]


def dump(node: Node) -> str:
    """The nodes in order, each with its parent's number; flat, so that depth does not matter."""
    nodes = in_order(node)
    number = {id(n): i for i, n in enumerate(nodes)}
    parent = {id(c): number[id(n)] for n in nodes for c in n.children}
    return json.dumps([[n.label, n.pages, n.chars, n.low, n.high, n.keep, parent.get(id(n), -1)] for n in nodes])


def load(text: str) -> Node:
    nodes: list[Node] = []
    for label, pages, chars, low, high, keep, parent in json.loads(text):
        nodes.append(Node(label, pages, chars, low, high, [], keep))
        if parent >= 0:
            nodes[parent].children.append(nodes[-1])
    return nodes[0]


# --- Spark ------------------------------------------------------------------

def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def slot_statistics(pages: DataFrame) -> DataFrame:
    """host, layout, slots: counts for each slot over all pages of that host and skeleton.

    Tasks sum up batch by batch before the shuffle, so a host with a third of all pages sends few rows.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple[str, str], np.ndarray] = {}
        for url, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            page = Page(markup)
            own = np.array([(1, len(t), h, h) for t in page.slot_texts() for h in (_hash(t),)], np.int64)
            key = host_of(url), page.skeleton()
            if key in sums:
                old = sums[key]
                own = np.column_stack([old[:, :2] + own[:, :2], np.minimum(old[:, 2], own[:, 2]), np.maximum(old[:, 3], own[:, 3])])
            sums[key] = own
        rows = [(host, line, _hash(skeleton), i, *map(int, r)) for (host, skeleton), a in sums.items() for i, (line, r) in enumerate(zip(skeleton.split("\n"), a))]
        names = ("host", "line", "layout", "slot", "pages", "chars", "low", "high")
        return pa.RecordBatch.from_pydict({n: pa.array(c, pa.string() if i < 2 else pa.int64()) for i, (n, c) in enumerate(zip(names, zip(*rows)))})

    parts = map_batches(clean_ids(pages, "url", "html"), count, "host string, line string, layout long, slot long, pages long, chars long, low long, high long")
    sums = [F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.min("low").alias("low"), F.max("high").alias("high")]
    by_slot = parts.groupBy("host", "layout", "slot", "line").agg(*sums)
    slots = F.array_sort(F.collect_list(F.struct("slot", "line", "pages", "chars", "low", "high")))  # as many as the layout has
    return by_slot.groupBy("host", "layout").agg(slots.alias("slots"))


def wrappers(statistics: DataFrame) -> DataFrame:
    """host, wrapper. Skeletons of a host merge in salted parts first, then the parts."""
    salt = F.pmod("layout", F.lit(partitions(statistics.sparkSession)))

    def part(pdf):
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [dump(induce([tree([tuple(s.values())[1:] for s in slots])[0] for slots in pdf["slots"]]))]})

    def whole(pdf):
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [dump(mark_content(induce([load(t) for t in pdf["tree"]])))]})

    parts = statistics.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(part, "host string, tree string")
    return parts.groupBy("host").applyInPandas(whole, "host string, wrapper string")


def layouts(statistics: DataFrame, found: DataFrame) -> DataFrame:
    """host, layout, keep: one flag for each slot of each layout."""
    rows = statistics.join(found, "host").select("host", "layout", "slots", "wrapper")

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [flags(load(w), tree([tuple(x.values())[1:] for x in slots])) for slots, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_pydict({"host": batch.column(0), "layout": batch.column(1), "keep": pa.array(keep, pa.list_(pa.bool_()))})

    return map_batches(rows, decide, "host string, layout long, keep array<boolean>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. The pages' texts meet their layouts in a join that Catalyst ships or splits by size."""
    pages = clean_ids(pages, "page_id", "url", "html")
    scratch = Scratch(pages.sparkSession, "wrappers")
    statistics = scratch.write(slot_statistics(pages), "statistics")
    kept = scratch.write(layouts(statistics, wrappers(statistics)), "layouts")
    page_id = dict(pages.dtypes)["page_id"]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Page(markup) for markup in batch.column(2).to_pylist()]
        column = lambda k, kind: pa.array([[x[k] for x in p.pieces] for p in found], pa.list_(kind))
        return pa.RecordBatch.from_pydict(
            {"page_id": batch.column(0), "url": batch.column(1), "host": pa.array([host_of(u) for u in batch.column(1).to_pylist()]),
             "layout": pa.array([_hash(p.skeleton()) for p in found], pa.int64()), "slot": column(0, pa.int32()), "block": column(1, pa.int32()), "piece": column(2, pa.string())}
        )

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [kept_text(zip(s, b, p), k or []) for s, b, p, k in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        return pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    parsed = map_batches(pages, read, f"page_id {page_id}, url string, host string, layout long, slot array<int>, block array<int>, piece array<string>")
    joined = parsed.join(kept, ["host", "layout"], "left").select("page_id", "url", "slot", "block", "piece", "keep")
    return map_batches(joined, write, f"page_id {page_id}, url string, text string, n_chars long")


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
