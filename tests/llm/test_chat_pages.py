"""Chat rotation and page differencing against plain Python, with nulls, ties, repeats and hot groups."""

from __future__ import annotations

import hashlib
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from presswork.llm import op01_chat, op06_differencing as pages_op

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "cid", "tie"), (1, 3, "ann", "tie"),
    (2, 0, "system", "alone"), (3, None, "ann", "no turn"), (3, 5, None, "no name"), (None, 1, "ann", "no conversation"), (None, 2, "bob", ""),
    (7, 1030, "ann", "late"), (7, None, "bob", "later"), (7, 2, "bob", "early"), (4, 0, "system", "be brief"), (4, 90, "system", "go on"), *[(4, i, "ann" if i % 3 else "bob", f"turn {i} é") for i in range(150)], *[(5, 7, "ann" if i % 2 else "bob", f"same turn {i}") for i in range(200)], *[(6, 1, "ann", "again")] * 50,
]


def rotated(rows, turns=64):
    messages = Counter((c, t, r if r is not None else "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows)
    held = defaultdict(list)
    for (c, t, r, x), n in messages.items():
        held[c].append(((t is None, t or 0), r, hashlib.md5(x.encode()).hexdigest()[:2], x, n))
    people, lead = defaultdict(set), {}
    for c, t, r, x in sorted(messages, key=lambda m: (m[1] is None, m[1] or 0, m[3])):
        if r != "system":
            people[c].add(r)
        else:
            lead.setdefault(c, f"<|system|>\n{x}<|end|>\n")
    out = []
    for c, said in held.items():
        said.sort()
        for part in range(-(-len(said) // turns)):
            own = said[part * turns : (part + 1) * turns]
            for person in people[c]:
                text, mask = lead.get(c, "") if part else "", []
                for _, r, _, x, _ in own:
                    text += "<|system|>\n" if r == "system" else "<|assistant|>\n" if r == person else f"<|user name={r}|>\n"
                    start = len(text)
                    text += x + "<|end|>\n"
                    mask += [start, len(text)] if r == person and r != "system" else []
                out.append((c, part, person, text, tuple(mask), len(own), sum(n for *_, n in own)))
    return Counter(out)


@pytest.mark.parametrize("turns", [1024, 64, 3])
def test_rotation(spark, turns):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({"said": F.lit(1), "block": F.lit(2), "part": F.lit(3)})
    got = op01_chat.rotated(rows, turns).select("conv_id", "part", "perspective", "text", "mask", "n_messages", "n_rows").collect()
    assert Counter((*r[:4], tuple(r[4]), *r[5:]) for r in got) == rotated(ROWS, turns)
    for r in got:
        for a, b in zip(r["mask"][::2], r["mask"][1::2], strict=True):
            assert r["text"][a:b].endswith(op01_chat.END) and r["text"][:a].endswith("<|assistant|>\n")


def test_few_messages_are_whole_whatever_their_turns_are(spark):
    turns = [1022, 1023, 1024, None]
    got = op01_chat.rotated(spark.createDataFrame([(1, t, "ann" if i % 2 else "bob", f"m{i}") for i, t in enumerate(turns)], SCHEMA)).collect()
    assert {(r["perspective"], r["part"], r["n_messages"]) for r in got} == {("ann", 0, 4), ("bob", 0, 4)}


def test_rotation_of_nothing(spark):
    assert op01_chat.rotated(spark.createDataFrame([], SCHEMA)).count() == 0


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page ad-free">
<header class="site-header"><p>Site name</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- note <p>no</p> --><div class="cookie-notice">We use cookies</div>
<aside>Aside</aside><form><p>Search</p><button>Go</button></form><article><header><h1>Head &amp; shoulders</h1></header><p>One   two<br>three<p>Four <b>five</b>.</p>
<div class="ad">Buy</div><ul><li>Item&nbsp;1<li>Item 2</ul><div id="comments"><p>First!</p></div></article><div class="sidebar">Side</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_an_article():
    assert pages_op.main_text(pages_op.parsed(ARTICLE), []) == "Head & shoulders\nOne two three\nFour five.\nItem 1\nItem 2"


def page(lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_shared_lines_go_but_copies_say_nothing(spark):
    top, end = ["Welcome to the site", "Today"], ["Imprint", "Contact"]
    body = lambda k: [f"The text of page {k} has this line {i} alone, and it is long enough to be a text." for i in range(4)]
    rows = [(k, f"http://x.org/a/{k}.html?u={k}", page([*top, *body(k), *end])) for k in range(4)]
    rows += [(10, "http://copy.org/p/1", page([*top, *body(9), *end])), (11, "http://copy.org/p/1/", page([*top, *body(9), *end])), (12, "http://alone.org/", page([*top, *body(7)]))]
    rows += [(20, None, page(["no url"])), (21, None, None), (22, "http://x.org/b", ""), (23, "not a url", "<p>text"), (0, rows[0][1], rows[0][2])]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("h"), "path": F.lit("p")})
    got = pages_op.extracted(table.repartition(1)).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u) for i, u, _ in rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "\n".join(body(1)) and text[3] == "\n".join(body(3))
    assert text[10] == text[11] == "\n".join([*top, *body(9), *end])  # each is the other's copy
    assert text[12] == "\n".join([*top, *body(7)]) and text[20] == "no url" and text[21] == text[22] == "" and text[23] == "text"


@pytest.mark.parametrize("a,b,want", [("abcd", "xbyd", "bd"), ("", "a", ""), ("aaaa", "aa", "aa"), ("abcbdab", "bdcaba", 4), ("x" * 200, "x" * 100, 100)])
def test_longest_common_subsequence(a, b, want):
    found = sorted(pages_op.common(list(a), list(b)))
    assert len(found) == (want if isinstance(want, int) else len(want))
    rest = iter(b)
    assert all(a[i] in rest for i in found)


def site(k, own):
    """A page whose template is div and p alone and longer than what it has of its own; a notice lies in its article."""
    top = [f"This line {i} of the template is on every page of the site, and it is a long one." for i in range(6)]
    return "<html><body>" + "".join(f"<p>{x}</p>" for x in top) + f"<main><h1>Title {k}</h1><p>Read more of us, every day</p><p>{own}</p></main><p>All rights reserved</p></body></html>"


def test_differencing_decides_inside_and_outside_articles(spark):
    plain = lambda html: html.replace("<main>", "<div>").replace("</main>", "</div>")
    rows = [(k, f"http://a.org/p/{k:02}", site(k, f"own text {k} which says more than the notice")) for k in range(12)] + [(100 + k, f"http://b.org/p/{k:02}", plain(site(k, f"own text {k} which says more than the notice"))) for k in range(12)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    text = {r["page_id"]: r["text"] for r in pages_op.extracted(table).collect()}
    assert all(text[k] == text[100 + k] == f"Title {k}\nown text {k} which says more than the notice" for k in range(12))
    alone = pages_op.main_text(pages_op.parsed(rows[0][2]), []), pages_op.main_text(pages_op.parsed(rows[12][2]), [])
    assert "Read more of us" in alone[0] and "template" in alone[1]  # no neighbours: the same pages keep these lines


def test_copies_among_most_neighbours_keep_the_article():
    page_of = lambda k: pages_op.parsed(f"<article><p>the text that all copies have, which is long</p><p>and {k}</p></article><p>template</p>")
    near = [page_of(k) for k in range(6)]
    assert pages_op.main_text(page_of(9), near) == "the text that all copies have, which is long\nand 9"


@pytest.mark.parametrize("partitions,rows", [(1, 1000), (7, 1000), (3, 7), (5, 10)])
def test_neighbours_are_those_of_the_whole_table(spark, partitions, rows):
    lines = lambda k: [f"line {k // 2}", f"line {k // 3} of three", f"text {k}"]  # noqa: E731  shared with the next one or two pages only
    pages = [(k, f"http://{'hot' if k % 3 else 'cold'}.org/{k:03}", page(lines(k))) for k in range(90)]
    pages += [(200, None, page(["a"])), (None, "http://hot.org/010", page(lines(10))), (10, "http://hot.org/010", page(lines(10))), (201, None, None)]
    order = sorted(pages, key=lambda r: ("" if r[1] is None else r[1].split("/")[2], r[1] or "", -(1 << 63) if r[0] is None else r[0]))
    want = Counter()
    for i, (id_, url, html) in enumerate(order):
        near = [pages_op.parsed(h or "") for j, (_, u, h) in enumerate(order) if 0 < abs(i - j) <= 3 and u and url and u.split("/")[2] == url.split("/")[2]]
        want[id_, url, pages_op.main_text(pages_op.parsed(html or ""), near)] += 1
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(partitions)
    assert Counter(map(tuple, pages_op.extracted(table, rows=rows).collect())) == want


@pytest.mark.parametrize("source", ["<a " * 400_000, "<a" + " " * 1_000_000, "<a " * 300_000 + ">", "<a '" * 250_000, "<a \"'" * 200_000 + ">", "<!--" * 250_000, "<script>" * 120_000, "<p><b>" * 150_000, "</p>" * 250_000])
def test_broken_pages_are_read_in_linear_time(source):
    start = time.process_time()
    pages_op.parsed(source)
    assert time.process_time() - start < 6


@pytest.mark.parametrize("source,lines", [
    ("a < b <c", ["a < b <c"]), ("x<!-- <p> -->y<!-- z", ["xy"]), ("<p title='a>b'>one<p>two</P>three", ["one", "two", "three"]), ('<p title="a>one', ["one"]),
    ("<script>var t='</p>';</script >x<STYLE>p</style>y", ["xy"]), ("<!DOCTYPE html><?x y?>z", ["z"]), ("<br/>a<br>b&lt;", ["a b<"]), ("<script>never closed", []),
])
def test_lines_of_markup(source, lines):
    assert pages_op.parsed(source).lines == lines


class Articles(HTMLParser):
    """The text of article elements by the standard library's parser: a line for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.text = False, []

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.text.append(" " if tag == "br" else "\0" if tag in ("p", "h1", "article") else "")

    def handle_endtag(self, tag):
        self.text.append("\0" if tag in ("p", "h1", "article") else "")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        self.text.append(data if self.inside else "")


def test_articles_of_the_given_pages(spark):
    """The whole article of each page, and nothing else: no article's line is most neighbours' line there."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in table.join(pages_op.extracted(table).select("page_id", "text"), "page_id").collect():
        parser = Articles()
        parser.feed(r["html"])
        want = [" ".join(x.split()) for x in "".join(parser.text).split("\0")]
        assert r["text"].split("\n") == [x for x in want if x]


def test_pages_of_nothing(spark):
    assert pages_op.extracted(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("html,text", [
    ("<body><form><nav>Menu</nav><article><h1>Title</h1><p>The article.</p></article><button>Send</button></form></body>", "Title\nThe article."),
    ("<body><form><h1>Title</h1><p>The article is long enough to be most of it.</p><nav>Menu</nav></form><p>x</p></body>", "Title\nThe article is long enough to be most of it.\nx"),
    ('<article><p>a</p><div class="share-price-table">Price</div><p class="notice-of-motion">Motion</p><section id="related-work">Work</section></article>', "a\nPrice\nMotion\nWork"),
    ('<article><p>a</p><div class="share-buttons">Tweet</div><div class="ad-slot-2">Buy</div><section id="article-comments">First!</section><div class="related posts">More</div></article>', "a"),
    ('<div class="search-page"><main><p>Found</p></main></div>', "Found"), ('<article><p>a</p></article><div class="related"><article>card</article></div><form>Search here for many more words</form>', "a"),
    ("<article><p>a</p></article><aside><article>card</article></aside>", "a"),
])
def test_elements_that_take_no_article_away(html, text):
    assert pages_op.main_text(pages_op.parsed(html), []) == text


def test_page_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a1", "http://h/1", "<article>one</article>"), (None, None, None)], "page_id string, url string, html string")
    assert {(r["page_id"], r["text"]) for r in pages_op.extracted(rows).collect()} == {("a1", "one"), (None, "")}
