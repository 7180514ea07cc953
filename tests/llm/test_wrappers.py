"""HTML extraction: parsing, simple tree matching against all matchings, induction on hosts of known templates."""

import html
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm import wrappers
from factloom.llm.wrappers import Node, page_tree, parse

PAGES = "page_id long, url string, html string"


def blocks(page):
    return [text for _, text, _ in parse(page)[1]]


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.main_texts(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<p>b <b>c</b>\n d<br>e</p>f", ["a", "b c d e", "f"]),
        ("<script>var x='<p>no</p>';</script><style>p{}</style><p title=\"a>b\" data-x='</p>'>yes</p>", ["yes"]),
        ("a &lt;b&gt; &amp;amp; &copy &#233;&#x2014;&nbsp;z &am", ["a <b> &amp; © é— z &am"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("x<!-- <p>no --><p>y<!-- open <p>z", ["x", "y"]),
        ("<p>a</p><a href=\"x", ["a"]),
        ("<p>a < b and 3<4 & c</p></div></p>", ["a < b and 3<4 & c"]),
        ("<title>t</title><textarea><p>u</textarea><template><p>v</template>w<noscript>n</noscript>", ["w"]),
        ("<p>it's <a title=it's href='q\"'>here</a></p>", ["it's here"]),
        ("", []),
        ("<>< ></><1>", ["<>< ></><1>"]),
        ("<div>" * 5000 + "deep" + "</div>" * 5000 + "out", ["deep", "out"]),
    ],
)
def test_parsing(page, want):
    assert blocks(page) == want


def test_long_pages_do_not_take_long():
    for page in ("<a '" * 50_000, "<!-" * 50_000, "<p " * 50_000, "<div class=\"a" * 20_000, "<p>x" * 50_000, "<x>" * 50_000 + "&amp;" * 50_000, "".join(f"<div class=w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}><p>{k}</p></div>" for k in range(3000))):
        tree, found = page_tree(page)
        assert all(len(n.kids) <= wrappers.FAN for n in tree.all())


def plain_matching(a, b):
    """All order-keeping choices of pairs of kids."""
    if a.label != b.label:
        return 0
    best = 0
    for size in range(min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, size):
            for right in itertools.combinations(b.kids, size):
                scores = [plain_matching(x, y) for x, y in zip(left, right, strict=True)]
                if all(scores):
                    best = max(best, sum(scores))
    return 1 + best


def test_simple_tree_matching():
    rng = random.Random(3)
    make = lambda depth: Node(rng.choice("ab"), [make(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])
    for _ in range(150):
        a, b = make(3), make(3)
        b.label = a.label
        score = wrappers.matching(a, b, {})
        assert score == plain_matching(a, b)
        placed = wrappers.slots(a, b)
        assert sum(k >= 0 for k in placed) == score and [k for k in placed if k >= 0] == sorted({k for k in placed if k >= 0})
        text, n = a.text(), len(a.all()) + len(b.all()) - score
        union = wrappers.merge(a, b)
        assert len(union.all()) == n and union.n == 2 and Node.read(text).text() == text
        assert wrappers.matching(union, Node.read(text), {}) == len(Node.read(text).all())  # a union holds both


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


def test_hosts_of_known_templates(spark, monkeypatch):
    """Four sites: articles marked as such, by class names only, by nothing at all, and one of single pages."""
    monkeypatch.setattr(wrappers, "MERGED", 4)
    rng = random.Random(8)
    rows, want = [], {}
    for k in range(160):
        site = k % 4
        paragraphs = [words(rng, rng.randint(15, 40)) + " & <x>" for _ in range(rng.randint(1, 6))]
        title = words(rng, 5)
        body = "".join(f"<p>{html.escape(p)}" if rng.random() < 0.5 else f"<p>{html.escape(p)}</p>" for p in paragraphs)
        menu = "<ul>" + "".join(f"<li><a href=/>{words(rng, 1)}</a></li>" for _ in range(rng.randint(3, 7))) + "</ul>"
        comments = "".join(f"<div class=comment><p>{words(rng, 12)}</p></div>" for _ in range(rng.randint(0, 3)))
        if site == 0:
            page = f"<header><h1>My site</h1>{menu}</header><main><article><header><h1>{title}</h1></header>{body}<p>Share this story with friends</p><aside>{words(rng, 30)}</aside></article><section id=comments>{comments}</section></main><footer>{words(rng, 9)}</footer>"
        elif site == 1:
            page = f"<body class='has-sidebar comments-open'><div id=nav-top>{menu}</div><div class='cookie-notice'>{words(rng, 20)}</div><div class=post><h1>{title}</h1>{body}</div><div class=sidebar2><p>{words(rng, 25)}</div><div id=respond><form><p>Write<input></form></div></body>"
        elif site == 2:
            page = f"<div><div>{menu}</div><div><p>Always the very same words of welcome stand here.</p></div><div><h2>{title}</h2>{body}</div><div><p>All rights are with the publisher of this place.</p></div></div>"
        else:
            page = f"<nav>{menu}</nav><div class=text><h1>{title}</h1>{body}</div><div class=ad>{words(rng, 9)}</div>"
        rows.append((k, f"http://site{site}.example.org/{k}" if site < 3 else f"https://u@One{k}.example.org:80/", f"<!DOCTYPE html><html><head><title>{title}</title></head>{page}</html>"))
        want[k] = "\n".join([title, *paragraphs])
    got = extracted(spark, rows)
    assert [k for k in want if got[k] != want[k]] == []
    half = {k: t for k, t in extracted(spark, [r if r[0] % 4 != 2 or r[0] < 20 else (r[0], r[1], None) for r in rows]).items() if k % 4 == 2}
    assert "welcome" in half[2] and half[22] == ""  # five pages are too few to call a text template


def test_copies_and_common_paragraphs_stay(spark):
    rng = random.Random(2)
    same = [words(rng, 30) for _ in range(4)]
    near = [(k, "http://copies.example.org/", "<article>" + "".join(f"<p>{p}</p>" for p in same) + f"<p>{words(rng, 3)}</p></article>") for k in range(30)]
    often = [(100 + k, "http://often.example.org/", f"<article><p>{words(rng, 20)}</p>" + (f"<p>{same[0]}</p>" if k % 4 else "") + "</article>") for k in range(40)]
    exact = [(200 + k, None, "<p>one and the same text</p>") for k in range(20)]
    got = extracted(spark, near + often + exact)
    assert all(got[k].startswith("\n".join(same)) for k in range(30))
    assert all((same[0] in got[100 + k]) == bool(k % 4) for k in range(40)) and all(got[200 + k] == "one and the same text" for k in range(20))


def test_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(k, f"http://h{k % 3}.example.org/{k}", f"<div class=x{k}><article><p>{words(rng, 9)}</p><p>constant words</p></article></div>") for k in range(60)]
    there = extracted(spark, rows)
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    assert extracted(spark, rows) == there and all("constant" not in t for t in there.values())


def test_odd_pages(spark):
    rows = [(1, "http://a.example.org", None), (None, None, "<p>x</p>"), (2, "not a url", ""), (2, "http://[", "<p>y"), (3, "http://a.example.org", "<nav>only a menu</nav>"), (4, "http://b", "퟿\x00<p>z z</p>"), (5, "x", "word " * 200_000)]
    table = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("mine")).withColumn("host", F.lit(1)).withColumn("tree", F.lit(2))
    out = wrappers.main_texts(table)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r["page_id"]), r["text"][:20], r["n_chars"]) for r in out.collect())
    assert got == sorted([("1", "", 0), ("None", "x", 1), ("2", "", 0), ("2", "y", 1), ("3", "", 0), ("4", "퟿\x00\nz z", 6), ("5", "word " * 4, 999_999)])
    assert wrappers.main_texts(table.limit(0)).collect() == []


def test_given_pages(spark, sf):
    """The given pages hold one article element each; its blocks are its heading and paragraphs."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inside.replace("<br>", " ")))]
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
