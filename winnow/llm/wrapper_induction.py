"""Main text of web pages by wrapper induction over the pages of one host.

A few exemplar pages stand for each host, and a few more for each page shape (the set of its containers with their classes) of
the host. A page's DOM tree is aligned with the exemplars of both by simple tree matching: two nodes
of one tag match, and their children are matched in order so that as many nodes as possible agree. Text that
is the same in both trees belongs to the template; text that differs or has no partner sits in a varying slot. The content is
the slot that holds most of the varying prose, widened to the article or main element around it, without the
lines that two exemplars and most of the host's or of the shape's hold as well. Elements whose
tag or class says menu, header, footer, notice, advert, form, script or comment are left out too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.session import broadcast_if_small, cut

from .words import texts_of

# Fixed values of HTML: elements without an end tag, elements that end an open paragraph, elements that start a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
OUT = frozenset("head title nav header footer aside form script style noscript template iframe object embed svg canvas math button select option textarea input label dialog menu".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header footer masthead sidebar side widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist respond replies disqus pagination pager copyright legal skip".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tr tbody thead tfoot div article section main body".split())
_WORDS = re.compile(r"[A-Za-z]+")
#: Elements further down are not told apart.
DEEPEST = 200


@dataclass
class Node:
    tag: str
    out: bool = False
    parent: Node | None = None
    #: Elements and text pieces in page order.
    children: list = field(default_factory=list)
    varying: bool = True
    #: Constant in two exemplars at least: text of the template.
    template: bool = False
    depth: int = 0
    _text: str | None = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def own_text(self) -> str:
        """White space made single spaces; to be asked for once the tree is complete."""
        if self._text is None:
            self._text = " ".join(" ".join(c for c in self.children if isinstance(c, str)).split())
        return self._text


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.at = self.root
        #: Open elements below DEEPEST; their text counts for the element there.
        self.below = 0

    def _close(self, tags: set[str], scopes: frozenset[str]):
        node = self.at
        while node is not self.root and node.tag not in scopes:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if self.at.depth >= DEEPEST:
            self.below += tag not in VOID
            return
        if tag in BLOCK:
            self._close({"p"}, SCOPES | {"li", "td", "th", "dd", "dt", "blockquote"} if tag != "p" else SCOPES | {"li", "td", "th"})
        if tag in SELF_CLOSING:
            self._close(SELF_CLOSING[tag], SCOPES - {"tr"} if tag == "tr" else SCOPES)
        values = {k: v or "" for k, v in attrs}
        names = {w.lower() for key in ("class", "id") for w in _WORDS.findall(values.get(key, ""))}
        hidden = "hidden" in values or "display:none" in values.get("style", "").replace(" ", "").lower() or values.get("aria-hidden") == "true"
        inside = self.at.tag in ("article", "main") or tag in ("article", "main", "body", "html")
        out = tag in OUT or values.get("role", "").lower() in OUT_ROLES or hidden or (bool(names & OUT_WORDS) and tag not in ("article", "main", "body", "html"))
        if tag == "header" and inside and not names & OUT_WORDS:
            out = False
        node = Node(tag, out or self.at.out, self.at, depth=self.at.depth + 1)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.below:
            self.below -= tag not in VOID
            return
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in ("article", "main", "body") and tag not in ("html", "body"):
                return
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.elements()))
    return out


#: Tables of child lists with more cells are split at the middle of one list, so that memory stays linear in the longer one.
CELLS = 1_000_000
#: What a matched node counts; equal text counts 1, so it only decides between matchings of as many nodes.
_NODE = 1 << 24


class _Matching:
    """Scores of pairs of subtrees. Subtrees of one form have one number, and text that only one tree holds does not tell them apart."""

    def __init__(self, a: Node, b: Node):
        orders = [_order(root) for root in (a, b)]
        mine, theirs = ({n.own_text() for n in order} for order in orders)
        both = mine & theirs - {""}
        numbers: dict[tuple, int] = {}
        self.number: dict[int, int] = {}
        for order in orders:
            for node in reversed(order):
                text = node.own_text()
                form = (node.tag, text if text in both else "", tuple(self.number[id(c)] for c in node.elements()))
                self.number[id(node)] = numbers.setdefault(form, len(numbers))
        self.forms = list(numbers)
        self.known: dict[tuple[int, int], int] = {}

    def score(self, x: int, y: int) -> int:
        if (x, y) not in self.known:
            (tag, text, left), (other, its, right) = self.forms[x], self.forms[y]
            self.known[x, y] = 0 if tag != other else _NODE + int(text == its != "") + (int(self.rows(left, right)[-1]) if left and right else 0)
        return self.known[x, y]

    def rows(self, left, right, keep: list | None = None) -> np.ndarray:
        """The last row of the table of best totals over heads of the lists; all rows go to ``keep``."""
        forms, place = np.unique(np.array(right, np.int64), return_inverse=True)
        row, lines = np.zeros(len(right) + 1, np.int64), {}
        for x in left:
            if x not in lines:
                lines[x] = np.array([self.score(x, y) for y in forms.tolist()], np.int64)[place]
            if keep is not None:
                keep.append(row)
            best = row.copy()
            np.maximum(row[1:], row[:-1] + lines[x], out=best[1:])
            row = np.maximum.accumulate(best)
        return row

    def paired(self, left: list[int], right: list[int]) -> list[tuple[int, int]]:
        """Positions of the children that a best matching pairs."""
        out, parts = [], [(0, len(left), 0, len(right))]
        while parts:
            i, k, j, m = parts.pop()
            # equal subtrees at either end always belong to a best matching
            while i < k and j < m and left[i] == right[j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            while i < k and j < m and left[k - 1] == right[m - 1]:
                k, m = k - 1, m - 1
                out.append((k, m))
            if i == k or j == m:
                continue
            if (k - i) * (m - j) > CELLS and k - i > 1:
                half = (i + k) // 2
                ahead, behind = self.rows(left[i:half], right[j:m]), self.rows(left[half:k][::-1], right[j:m][::-1])
                at = j + int(np.argmax(ahead + behind[::-1]))
                parts += [(i, half, j, at), (half, k, at, m)]
                continue
            table: list[np.ndarray] = []
            table.append(self.rows(left[i:k], right[j:m], table))
            x, y = k - i, m - j
            while x and y:
                if table[x][y] == table[x - 1][y]:
                    x -= 1
                elif table[x][y] == table[x][y - 1]:
                    y -= 1
                else:
                    x, y = x - 1, y - 1
                    out.append((i + x, j + y))
        return sorted(out)


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the number of matched nodes and the pairs."""
    if a.tag != b.tag:
        return 0, []
    matching = _Matching(a, b)
    found, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        found.append((x, y))
        left, right = x.elements(), y.elements()
        if left and right:
            pairs = matching.paired([matching.number[id(c)] for c in left], [matching.number[id(c)] for c in right])
            stack += [(left[i], right[j]) for i, j in reversed(pairs)]
    return len(found), found


def mark_template(page: Node, *groups: list[Node]) -> None:
    """Clear ``varying`` on nodes whose text is constant in most exemplars of a group; an exemplar that is a copy of the page says nothing."""
    nodes = [n for n in _order(page) if n.own_text()]
    chars = sum(len(n.own_text()) for n in nodes if not n.out) or 1
    for exemplars in groups:
        votes, asked = {}, 0
        for other in exemplars:
            same = [x for x, y in align(page, other)[1] if x.own_text() and x.own_text() == y.own_text()]
            if sum(len(x.own_text()) for x in same if not x.out) > 0.8 * chars:
                continue
            asked += 1
            for x in same:
                votes[id(x)] = votes.get(id(x), 0) + 1
        for n in nodes:
            if 2 * votes.get(id(n), 0) > asked:
                n.varying = False
                # two pages alone can't tell a template from a quotation
                n.template = n.template or votes[id(n)] > 1
    # a list or a table is one unit: an item that is the same everywhere stays where the others vary
    for unit in _order(page):
        if unit.tag in ("ul", "ol", "dl", "table"):
            held = [n for n in _order(unit) if n.own_text() and not n.out]
            if not all(n.template for n in held):
                for n in held:
                    n.template = False


def content_root(page: Node) -> Node | None:
    """The slot that holds most of the varying prose, widened to the article or main element around it."""
    weight: dict[int, int] = {}
    nodes = _order(page)
    for node in nodes:
        if not node.out and node.varying and node.tag != "a":
            chars, up = len(node.own_text()), node
            while up.tag not in BLOCK and up.parent:
                up = up.parent
            weight[id(up)] = weight.get(id(up), 0) + chars
    held = [n for n in nodes if weight.get(id(n))]
    if not held:
        return next((n for n in nodes if n.tag in ("article", "main") and not n.out), None)
    slots: dict[int, int] = {}
    for n in held:
        slot = n.parent or n
        slots[id(slot)] = slots.get(id(slot), 0) + weight[id(n)]
    best = max(held, key=lambda n: slots[id(n.parent or n)])
    best = best.parent or best
    outer, up = None, best
    while up is not None:
        if up.tag in ("article", "main"):
            outer = up
        up = up.parent
    if outer is not None:
        return outer
    # without such an element: as far up as all text below is varying or out
    while best.parent is not None and best.parent.tag not in ("html", "body") and all(n.out or n.varying or not n.own_text() for n in _order(best.parent)):
        best = best.parent
    return best


def blocks(root: Node) -> list[str]:
    """Text of the blocks below ``root`` in page order, white space made single spaces, without blocks of the template.

    A block is left out if all elements that its text comes from are constant; constant words inside a varying line stay.
    """
    out, current = [], []
    # a slot that is constant throughout is no template around something else
    every = all(n.template for n in _order(root) if n.own_text() and not (n.out and n is not root))

    def end():
        text = " ".join("".join(piece for piece, _ in current).split())
        if text and (every or any(fresh for piece, fresh in current if piece.strip())):
            out.append(text)
        current.clear()

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, tuple):
            current.append(item)
        elif not item.out or item is root:
            if item.tag in BLOCK:
                end()
                stack.append(None)
            elif item.tag == "br":
                current.append((" ", False))
            stack.extend((c, not item.template) if isinstance(c, str) else c for c in reversed(item.children))
    end()
    return out


def main_text(html: str, *groups: list[Node]) -> str:
    page = parse(html)
    mark_template(page, *groups)
    root = content_root(page)
    return "\n".join(blocks(root)) if root is not None else ""


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


#: Pages of a host with the same containers are a shape of their own from this number on.
SHAPE_PAGES = 8
#: Groups of more pages meet their exemplars in several parts.
HOT_PAGES = 2000
_CONTAINER = r"<(?:main|article|section|div|aside|table)(?=[\s>])[^>]*>"


def shape_of(html="html"):
    """The distinct containers of a page with the words of their classes, as one text."""
    tag = F.transform(F.regexp_extract_all(F.lower(F.col(html)), F.lit(_CONTAINER), F.lit(0)), lambda t: F.concat(F.regexp_extract(t, "[a-z]+", 0), F.lit("."), F.regexp_replace(F.regexp_extract(t, r"\sclass\s*=\s*[\"']?([^\"'>]*)", 1), "[^a-z]+", ".")))
    return F.array_join(F.sort_array(F.array_distinct(tag)), " ")


def exemplars_of(pages: DataFrame, count: int = 4) -> DataFrame:
    """``group, page_id`` of ``count`` pages for each group of ``pages (group, page_id)``, those with the smallest digests.

    The first choice is one page for each of 16 parts of a group, an aggregate that is combined before it is shuffled.
    """
    picks = pages.where("page_id is not null").select("group", "page_id", F.md5(F.col("page_id").cast("string")).alias("h"))
    part = F.substring("h", 1, 1)
    firsts = picks.groupBy("group", part.alias("part")).agg(F.min(F.struct("h", "page_id")).alias("x"))
    chosen = firsts.groupBy("group").agg(F.slice(F.sort_array(F.collect_list("x")), 1, count).alias("xs"))
    return chosen.select("group", F.explode("xs.page_id").alias("page_id"))


def extract(pages: DataFrame, count: int = 4, salts: int = 32) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages (page_id, url, html, ...)``.

    A null html is an empty page, a null url or one without a host makes a host of its own kind; a host with one page has no
    template and is read by its elements alone. Repeated rows are extracted each. Pages meet ``count`` exemplars of
    their host and as many of their shape; groups of many pages do so in ``salts`` parts, so that a host with a third of all pages is spread out.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"), F.xxhash64(host, F.lit("/"), F.coalesce(shape_of(), F.lit(""))).alias("shape"))
    narrow = cut(rows.select("page_id", "host", "shape", F.col("html").isNotNull().alias("read")))
    sizes = cut(narrow.groupBy("shape").agg(F.count("*").alias("n"), F.first("host").alias("host")))
    large = cut(sizes.where(F.col("n") >= SHAPE_PAGES).select("shape", "host", (F.col("n") > HOT_PAGES).alias("hot_shape")))
    hot = cut(sizes.groupBy("host").agg(F.sum("n").alias("n")).where(F.col("n") > HOT_PAGES).select("host", F.lit(True).alias("hot_host")))

    def grouped(df):
        """With ``group``, the shape or else the host, and whether it is ``hot``."""
        known = df.join(broadcast_if_small(large.drop("host")), "shape", "left").join(broadcast_if_small(hot), "host", "left")
        group = F.when(F.col("hot_shape").isNotNull(), F.col("shape")).otherwise(F.col("host"))
        return known.withColumn("group", group).withColumn("hot", F.coalesce("hot_shape", "hot_host", F.lit(False))).drop("hot_shape", "hot_host")

    few = narrow.where("read")
    shapes = few.join(broadcast_if_small(large.select("shape")), "shape").select(F.col("shape").alias("group"), "page_id")
    chosen = cut(exemplars_of(few.select(F.col("host").alias("group"), "page_id").union(shapes), count))
    # the exemplars of a shape's host come with those of the shape
    own = F.col("of") == F.col("group")
    hosts = chosen.join(sizes.select("host").distinct(), F.col("group") == F.col("host"), "left_semi").select(F.col("group").alias("of"), "page_id")
    asked = chosen.select("group", F.col("group").alias("of"), "page_id").union(hosts.join(large.select(F.col("shape").alias("group"), F.col("host").alias("of")), "of").select("group", "of", "page_id"))
    texts = rows.select("page_id", "html").join(broadcast_if_small(chosen.select("page_id").distinct()), "page_id", "left_semi")
    lists = asked.join(texts.where("html is not null"), "page_id").groupBy("group").agg(F.collect_list(F.struct("page_id", "html", own.alias("own"))).alias("exemplars"))
    hots = large.where("hot_shape").select(F.col("shape").alias("group")).union(hot.select(F.col("host").alias("group"))).withColumn("hot", F.lit(True))
    lists = lists.join(broadcast_if_small(hots), "group", "left")
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), F.lit(salts - 1)).otherwise(0)))).drop("hot")
    salted = grouped(rows).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).otherwise(0))
    joined = salted.join(lists, ["group", "salt"], "left").select("page_id", "url", "html", "group", "exemplars")

    def read(batches):
        trees: dict[int, list[tuple[int, bool, Node]]] = {}
        for batch in batches:
            texts = []
            for page_id, group, others, raw in zip(batch.column("page_id").to_pylist(), batch.column("group").to_pylist(), batch.column("exemplars"), texts_of(batch, "html"), strict=True):
                if group not in trees:
                    if len(trees) >= 64:
                        trees.clear()
                    trees[group] = [(o["page_id"], o["own"], parse(o["html"])) for o in others.as_py() or []]
                mine, hosts = ([tree for i, own, tree in trees[group] if i != page_id and own == kind] for kind in (True, False))
                texts.append(main_text((raw or b"").decode("utf-8", "replace"), mine, hosts))
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = joined.mapInArrow(read, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
