"""Main text of web pages by wrapper induction: DOM trees of a host's pages are aligned by simple tree matching.

A page's tree has its block elements; neighbours with one label (tag, class words, id) are folded into one node. The distinct
trees of a host are merged, a bounded number in a task, round by round, until one tree is left: the host's wrapper,
whose nodes are slots. A text that stands in one slot in nine tenths of the host's pages (eight pages at least; pages that are
the same count once) is template; what varies is content. Of content, blocks inside elements that are navigation,
headers and footers of the page, sidebars, notices, adverts, forms or comments by tag, role, class or id are left out.
What remains of a page's article (or main) elements is its text; a page without one keeps the part of its wrapper that holds
most of the host's varying text outside links, and its first-rank headings.

Template is taken away only where more of the page's content stays than goes: pages that are near copies of each other stay whole.
Character references are decoded, white space inside a block becomes one space; blocks are joined in page order by one
line feed. Null and empty html give an empty text. Pages are told apart by row: ids may be null or repeat. A
page without a host (null url) belongs to the host ''. Comments, scripts, styles and other elements without text of their own never count.
"""

from __future__ import annotations

import html
import json
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow_rows import drop_stored, map_rows, stored

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("audio button canvas datalist head iframe map math noembed noframes noscript object script select style svg template textarea title video xmp".split())
#: What a start tag ends, and the element beyond which it does not look.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ASIDE_TAGS = frozenset("nav footer aside form menu dialog search".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist "
    "disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "toolbar pagination pager copyright".split()
)
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)|[!?])")
_ATTRIBUTES = re.compile(r"""(?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|(?<=\s)(hidden)(?=[\s/>])""")
#: Elements deeper than this belong to the one above; nodes have no more kids than FAN, or else kids of one label are one.
DEPTH, FAN = 40, 64
#: Trees of a host that one task merges; wrapper nodes in a smaller share of as many pages are left out.
MERGED, RARE = 32, 0.05
#: Share of the pages with a slot, and number of pages, from which a text in it is template.
SHARE, PAGES = 0.9, 8
#: Wrappers are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


class Node:
    """An element, or a node of a page's tree or of a wrapper: kids in page order; n pages have it; to: the node it was folded into."""

    __slots__ = ("aside", "kids", "label", "n", "to", "up")

    def __init__(self, label: str, kids: list[Node] | None = None, n: int = 1, up: Node | None = None, aside: bool = False):
        self.label, self.kids, self.n, self.up, self.aside, self.to = label, kids or [], n, up, aside, None

    @property
    def tag(self) -> str:
        return re.match(r"[^.#]*", self.label)[0]

    def text(self) -> str:
        return json.dumps(self.rows(), ensure_ascii=False, separators=(",", ":"))

    def rows(self) -> list:
        return [self.label, self.n, [k.rows() for k in self.kids]]

    @classmethod
    def read(cls, text: str) -> Node:
        make = lambda r: cls(r[0], [make(k) for k in r[2]], r[1])
        return make(json.loads(text))

    def all(self) -> list[Node]:
        return [self, *(n for k in self.kids for n in k.all())]


def _element(tag: str, attributes: str, up: Node) -> Node:
    found = {(a or e).lower(): b or c or d for a, b, c, d, e in _ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    names = re.sub(r"\d+", "", " ".join(sorted(found.get("class", "").split())) + "#" + found.get("id", "")).strip("# ").lower()
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    main = tag in ("article", "main") or role in ("article", "main") or found.get("itemprop") == "articleBody"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    aside = hidden or tag in ASIDE_TAGS or role in ASIDE_ROLES or tag not in ("html", "body") and bool(words & ASIDE_WORDS)
    return Node(("main" if main and tag not in ("article", "main") else tag) + ("." + names if names else ""), up=up, aside=aside)


def parse(page: str) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The page's elements, and its blocks of text in page order: (element, text, characters in links)."""
    root = Node("#")
    stack, blocks, chunks = [("#", root)], [], []
    link = links = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(chunks).split())
        if text:
            blocks.append((stack[-1][1], text, min(links, len(text))))
        chunks.clear()
        links = 0

    while True:
        m = _TAG.search(page, at)
        chunk = page[at : m.start() if m else len(page)]
        if chunk:
            chunk = html.unescape(chunk) if "&" in chunk else chunk
            chunks.append(chunk)
            links += len(chunk.strip()) if link else 0
        if not m:
            break
        comment, closing, tag = m.groups()
        if tag is None:
            at = page.find("-->" if comment else ">", m.end()) + 1
            if not at:
                break
            at += 2 * bool(comment)
            continue
        end = _ATTRIBUTES.match(page, m.end())
        if not end:
            break
        at, tag = end.end(), tag.lower()
        if tag in SKIPPED and not closing:
            last = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not last:
                break
            at = last.end()
        elif tag == "a":
            link = not closing
        elif tag == "br":
            chunks.append(" ")
        elif tag in BLOCKS:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                continue
            if stack[-1][0] == "p":
                stack.pop()
            if tag in ENDS:
                ends, until = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in ends:
                        del stack[k:]
                        break
            if tag != "hr":
                up = stack[-1][1]
                if len(stack) <= DEPTH:
                    node = _element(tag, page[m.end() : at - 1] if at - m.end() > 1 else "", up)
                    up.kids.append(node)
                else:
                    node = up
                stack.append((tag, node))
    flush()
    return root, blocks


def kept_blocks(root: Node, blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """Blocks outside of asides. An element that holds the page's article is no aside by its class, an article that is marked as one is it beside others, and a header is one outside of articles."""
    holds, inside, articles = set(), {}, []

    def look(n: Node, within: bool) -> None:
        own = n.tag in ("article", "main")
        inside[n] = within = within or own
        for k in n.kids:
            look(k, within)
        if own:
            articles.append(n)
        if own or any(k in holds for k in n.kids):
            holds.add(n)

    look(root, False)
    others = any(not n.aside for n in articles)
    gone: dict[Node, bool] = {root: False}

    def out(n: Node) -> bool:
        if n not in gone:
            alone = n.aside and (others if n.tag in ("article", "main") else n not in holds) or n.tag == "header" and not inside[n] and n not in holds
            gone[n] = alone or out(n.up)
        return gone[n]

    return [b for b in blocks if not out(b[0])]


# ---- simple tree matching


def matching(a: Node, b: Node, known: dict) -> int:
    """The number of pairs of nodes in the largest matching of two trees that keeps ancestors and order; 0 where the roots differ."""
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    if (a, b) not in known:
        known[a, b] = 1 + table(a.kids, b.kids, known)[-1][-1]
    return known[a, b]


def table(left: list[Node], right: list[Node], known: dict) -> list[list[int]]:
    best = [[0] * (len(right) + 1)]
    for x in left:
        above, row = best[-1], [0]
        for k, y in enumerate(right):
            row.append(max(above[k + 1], row[k], above[k] + matching(x, y, known)))
        best.append(row)
    return best


def aligned(left: list[Node], right: list[Node], known: dict) -> list[tuple[Node | None, Node | None]]:
    """Both lists in one order, matched kids side by side."""
    best, i, j, out = table(left, right, known), len(left), len(right), []
    while i or j:
        if i and j and (m := matching(left[i - 1], right[j - 1], known)) and best[i][j] == best[i - 1][j - 1] + m:
            i, j = i - 1, j - 1
            out.append((left[i], right[j]))
        elif i and best[i][j] == best[i - 1][j]:
            i -= 1
            out.append((left[i], None))
        else:
            j -= 1
            out.append((None, right[j]))
    return out[::-1]


def merge(a: Node, b: Node, known: dict | None = None, pages: bool = True) -> Node:
    """a, with what b has besides; pages: the trees are of different pages, whose numbers add up."""
    known = {} if known is None else known
    b.to = a
    if pages:
        a.n += b.n
    if b.kids:
        a.kids = [merge(x, y, known, pages) if x and y else x or y for x, y in aligned(a.kids, b.kids, known)] if a.kids else b.kids
    return a


def slots(wrapper: Node, tree: Node) -> list[int]:
    """Of each node of tree (in order) the number of the wrapper's node that it matches, or -1."""
    number = {n: k for k, n in enumerate(wrapper.all())}
    known: dict = {}
    out: list[int] = []

    def place(w: Node | None, t: Node) -> None:
        out.append(number[w] if w else -1)
        met = {y: x for x, y in aligned(w.kids, t.kids, known) if x and y} if w and w.kids and t.kids else {}
        for k in t.kids:
            place(met.get(k), k)

    place(wrapper if wrapper.label == tree.label else None, tree)
    return out


def folded(n: Node) -> Node:
    """The page tree of an element: neighbours of one label are one node."""
    tree = Node(n.label)
    n.to = tree
    for k in n.kids:
        kid = folded(k)
        if tree.kids and tree.kids[-1].label == kid.label:
            merge(tree.kids[-1], kid, pages=False)
        else:
            tree.kids.append(kid)
    for label in (lambda x: x.label, lambda x: x.tag, lambda x: "*"):
        if len(tree.kids) > FAN:
            first: dict[str, Node] = {}
            for k in tree.kids:
                k.label = label(k)
                if k.label in first:
                    merge(first[k.label], k, pages=False)
                first.setdefault(k.label, k)
            tree.kids = list(first.values())
    return tree


def _target(n: Node) -> Node:
    while n.to is not None:
        n = n.to
    return n


def page_tree(page: str | None) -> tuple[Node, list[tuple[int, str, int, bool]]]:
    """The page's tree, and its blocks outside of asides: (number of the tree's node, text, characters in links, whether in an article or main element)."""
    root, blocks = parse(page or "")
    kept = kept_blocks(root, blocks)
    tree = folded(root)
    number = {n: k for k, n in enumerate(tree.all())}
    found = {}

    def within(n: Node) -> str:
        if n not in found:
            above = within(n.up) if n.up is not None else ""
            found[n] = above if above == "article" else n.tag if n.tag in ("article", "main") else above
        return found[n]

    where = [within(n) for n, _, _ in kept]
    best = "article" if "article" in where else "main"
    return tree, [(number[_target(n)], text, links, w in (best, "article")) for (n, text, links), w in zip(kept, where, strict=True)]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# ---- Spark


def with_host(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))


def page_marks(pages: DataFrame) -> DataFrame:
    """host, tree, page (hash of all of it), marks: of each node of the tree with blocks a mark of hash 0 with its characters, and one for each of its texts."""

    def run(columns: list[list]) -> list[list]:
        trees, hashes, marks = [], [], []
        for page in columns[0]:
            tree, blocks = page_tree(page)
            sums: dict[int, list[int]] = {}
            texts: dict[tuple[int, int], None] = {}
            for node, text, links, _ in blocks:
                own = sums.setdefault(node, [0, 0])
                own[0] += len(text)
                own[1] += links
                texts[node, _hash(text)] = None
            trees.append(tree.text())
            marks.append([{"node": n, "hash": 0, "chars": c, "links": k} for n, (c, k) in sums.items()] + [{"node": n, "hash": h, "chars": 0, "links": 0} for n, h in texts])
            hashes.append(_hash(f"{trees[-1]} {[(n, h) for n, h in texts]}"))
        return [trees, hashes, marks]

    return map_rows(pages.select("host", "html"), run, "tree string, page long, marks array<struct<node:int,hash:long,chars:long,links:long>>", keep=["host"])


def induce(trees: DataFrame) -> DataFrame:
    """host, wrapper of trees (host, tree): merged by groups of about MERGED, round by round, until each host has one."""

    def merged(rows):
        out = None
        for text in sorted(rows["tree"]):
            tree = Node.read(text)
            out = tree if out is None else merge(out, tree)
        if out.n >= MERGED:
            prune(out, RARE * out.n)
        rows = rows.iloc[:1].copy()
        rows["tree"] = out.text()
        return rows[["host", "tree"]]

    def prune(node: Node, least: float) -> None:
        node.kids = [k for k in node.kids if k.n >= least]
        for k in node.kids:
            prune(k, least)

    made = None
    while True:
        many = trees.groupBy("host").agg(F.count("*").alias("k"))
        if (many.agg(F.max("k")).first()[0] or 1) == 1:
            return trees.withColumnRenamed("tree", "wrapper")
        group = F.pmod(F.xxhash64("tree"), F.ceil(F.col("k") / MERGED))
        rows = trees.join(many, "host").withColumn("g", group)
        trees = stored(rows.groupBy("host", "g").applyInPandas(merged, "host string, tree string"), "wrapper-trees")
        if made is not None:
            drop_stored(made)
        made = trees


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, stats (of each slot its pages, characters and those in links), template (slot and hash of each constant text)."""
    marks = stored(page_marks(pages).groupBy("host", "page").agg(F.first("tree").alias("tree"), F.first("marks").alias("marks")), "wrapper-marks")  # rows of one page hash are equal
    counted = stored(marks.groupBy("host", "tree").agg(F.count("*").alias("n")), "wrapper-distinct")
    weighed = map_rows(counted, lambda c: [[_weighed(t, n) for t, n in zip(*c, strict=True)]], "tree string", keep=["host"])
    found = stored(induce(weighed), "wrapper-hosts")

    def place(columns: list[list]) -> list[list]:
        return [[slots(Node.read(w), Node.read(t)) for w, t in zip(*columns, strict=True)]]

    placed = map_rows(counted.join(found, "host").select("host", "tree", "wrapper"), place, "slots array<int>", keep=["host", "tree"], read=["wrapper", "tree"])
    one = marks.join(placed, ["host", "tree"]).select("host", F.explode(F.transform("marks", lambda m: F.struct(F.get("slots", m["node"]).alias("slot"), m["hash"].alias("hash"), m["chars"].alias("chars"), m["links"].alias("links")))).alias("m"))
    seen = one.select("host", "m.*").where("slot >= 0").groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    seen = stored(seen.where((F.col("hash") == 0) | (F.col("n") >= PAGES)), "wrapper-slots")
    sums = seen.where("hash = 0").select("host", "slot", F.col("n").alias("pages"), "chars", "links")
    constant = seen.where("hash <> 0").join(sums.select("host", "slot", "pages"), ["host", "slot"]).where(F.col("n") >= SHARE * F.col("pages"))
    stats = sums.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "links")).alias("stats"))
    template = constant.groupBy("host").agg(F.collect_list(F.struct("slot", "hash")).alias("template"))
    out = stored(found.join(stats, "host", "left").join(template, "host", "left"), "wrappers")
    for made in (marks, counted, found, seen):
        drop_stored(made)
    return out


def _weighed(text: str, n: int) -> str:
    tree = Node.read(text)
    for node in tree.all():
        node.n = n
    return tree.text()


def content_slots(wrapper: Node, stats: list[dict] | None) -> set[int]:
    """Slots of the smallest part of a wrapper that holds four fifths of its characters outside links, but for those that are mostly links; first-rank headings are content anywhere."""
    nodes = wrapper.all()
    number = {n: k for k, n in enumerate(nodes)}
    own = {s["slot"]: s for s in stats or []}
    mass: dict[Node, int] = {}

    def weigh(n: Node) -> int:
        s = own.get(number[n])
        mass[n] = (s["chars"] - s["links"] if s and 2 * s["links"] <= s["chars"] else 0) + sum(map(weigh, n.kids))
        return mass[n]

    part, total = wrapper, weigh(wrapper)
    while deeper := [k for k in part.kids if k.tag in ("html", "body", "div", "section", "center", "table", "tbody", "tr", "td", "main", "article") and 5 * mass[k] >= 4 * total > 0]:
        part = deeper[0]
    inside = {number[n] for n in part.all()} | {k for k, n in enumerate(nodes) if n.tag == "h1"}
    return {k for k in inside if k not in own or 2 * own[k]["links"] <= own[k]["chars"]}


class Rules:
    """A host's wrapper made ready for its pages."""

    def __init__(self, wrapper: str | None, stats: list[dict] | None, template: list[dict] | None):
        self.wrapper = Node.read(wrapper) if wrapper else Node("#")
        self.content = content_slots(self.wrapper, stats)
        self.template = {(t["slot"], t["hash"]) for t in template or []}
        self.places: dict[str, list[int]] = {}

    def text(self, page: str | None) -> str:
        tree, blocks = page_tree(page)
        key = tree.text()
        if key not in self.places:
            if len(self.places) > 200:
                self.places.clear()
            self.places[key] = slots(self.wrapper, tree)
        at = self.places[key]
        if any(main for _, _, _, main in blocks):
            kept = [(at[n], text) for n, text, _, main in blocks if main]
        else:
            kept = [(at[n], text) for n, text, links, _ in blocks if at[n] in self.content or at[n] < 0 and 2 * links <= len(text)]
        varying = [text for slot, text in kept if (slot, _hash(text)) not in self.template]
        if 2 * sum(map(len, varying)) < sum(len(text) for _, text in kept):
            varying = [text for _, text in kept]
        return "\n".join(varying)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    rows = with_host(pages, id_col, url_col, html_col)
    found = wrappers(rows)
    size = found.agg(F.sum(F.length("wrapper") + 200 + 24 * F.size(F.coalesce("template", F.array())) + 32 * F.size(F.coalesce("stats", F.array())))).first()[0] or 0
    met = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def run(columns: list[list]) -> list[list]:
        rules: dict[str, Rules] = {}
        texts = []
        for host, page, *own in zip(*columns, strict=True):
            if host not in rules:
                rules[host] = Rules(*own)
            texts.append(rules[host].text(page))
        return [texts, [len(t) for t in texts]]

    return map_rows(met.select("page_id", "url", "host", "html", "wrapper", "stats", "template"), run, "text string, n_chars long", keep=["page_id", "url"], read=["host", "html", "wrapper", "stats", "template"])
