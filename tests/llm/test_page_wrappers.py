"""Wrappers and the main text of pages, against pages whose text is known and an independent reader."""

import random
import re
from html import escape, unescape
from html.parser import HTMLParser

import pytest

from tutorspark.llm import page_wrappers as pw

SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string"


class Plain(HTMLParser):
    """Texts of the blocks of article elements, by Python's own parser; block by block as the supplied pages write them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in ("p", "h1", "h2", "li", "article", "br"):
            self.cut() if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "article"):
            self.cut()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.now = (self.now or "") + data

    def cut(self):
        text = " ".join((self.now or "").split())
        if text:
            self.blocks.append(text)
        self.now = None


def plain(html):
    reader = Plain()
    reader.feed(html or "")
    reader.close()
    reader.cut()
    return "\n".join(reader.blocks)


def texts(spark, pages, parts=3):
    """Texts of (url, html) pages in order."""
    rows = [(n, url, html, "h", "w", "t") for n, (url, html) in enumerate(pages)]
    got = pw.main_text(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(pages) and all(found[n].url == url for n, (url, _) in enumerate(pages))
    assert all(r.n_chars == len(r.text) for r in found.values())
    return [found[n].text for n in range(len(pages))]


def test_supplied_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r.text for r in pw.main_text(pages).collect()}
    assert len(got) > 100 and got == want and all(got.values())


ARTICLE = """<!doctype html><html><head><title>T</title><script>if (a<b) x("</p>")</script><style>p{{}}</style></head><body class=home>
<header class="top"><a href=/>Site {n}</a></header><div class='menu-bar navMenu'><ul><li><a href=1>One {n}<li><a href=2>Two</ul></div>
<div id="cookie-notice">We use cookies {n}</div><!-- an ad > here --><div class=ad>Buy {n}</div>
<article><header><h1>{title}</h1></header><p class="lead">{first}<p>{second}<div class="share">Tweet {n}</div>
<form><label>Mail {n}</label><input value="x>y"></form><aside>See {n}</aside>{more}<section id=comments><article><p>Reader {n}</p></article></section>
<footer>by {n}</footer></article><div class="sidebar">Side {n}</div><footer>&copy; {n}</footer>"""


def blocks(rng):
    return [" ".join(rng.choice(["word", "é&<", "x", '"q"', " ", "a  b\n", "1 < 2"]) for _ in range(rng.randrange(3, 30))) for _ in range(rng.randrange(3, 9))]


def normal(text):
    return " ".join(text.split())


def test_semantic_pages(spark):
    """Unclosed tags, boilerplate inside the article, references, comments, scripts."""
    rng, pages, want = random.Random(1), [], []
    for n in range(40):
        title, first, second, *more = blocks(rng)
        pages.append((f"http://h{n % 3}.example/", ARTICLE.format(n=n, title=escape(title), first=escape(first), second=escape(second),
                     more="".join(f"<h2>{escape(t)}</h2><ul><li>{escape(t)}</ul>" for t in more))))
        want.append("\n".join(t for t in map(normal, [title, first, second, *(t for t in more for _ in (0, 1))]) if t))
    assert texts(spark, pages) == want


SOUP = """<html><body><div class="wrap"><div class="x1"><span><a href=a>Home {n}</a> <a href=b>About us</a></span></div>
<div class="x2">The daily paper, since 1901, read everywhere and by everyone</div><div class="x3"><h1>{title}</h1>{body}</div>{extra}
<div class="x4"><a href=z>Imprint of the daily paper and its many owners {n}</a></div></div></body></html>"""


@pytest.mark.parametrize("parts", [1, 7])
def test_pages_without_landmarks(spark, parts):
    """The main region is found by text, template texts by being the same, menus by being links."""
    rng, pages, want = random.Random(2), [], []
    for n in range(30):
        title, *body = [f"{n} " + " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(40)) for _ in range(rng.randrange(2, 8))]
        extra = '<div class="sponsored">Get rich</div>' if n % 3 else ""
        pages.append(("https://soup.example/a", SOUP.format(n=n, title=title, body="".join(f"<div class=para>{b}</div>" for b in body), extra=extra)))
        want.append("\n".join([title, *body]))
    assert texts(spark, pages, parts) == want


def test_odd_pages(spark):
    long = "word " * 400_000
    nested = "<div>" * 5000 + "deep text" + "</div>" * 5000
    broken = '<article><p>one<p>two <a href="x>three</a><p>four &am &amp; &lt;b&gt; &#233;&#xe9; &nope; a < b <'
    repeated = "<article><p>same</p></article>"
    pages = [
        (None, None), (None, ""), ("", "  \n "), ("nohost", "plain text only"), ("http://a/", "<article></article>"),
        ("http://a/", f"<article><p>{long}</p></article>"), ("http://b/", nested), ("http://c/", broken),
        ("http://d/", repeated), ("http://d/", repeated), ("http://d/", repeated), ("http://e/", "<p>x</p><script>never closed <p>y</p>"),
        ("http://f/", "<article><p>a<select><option>b</select>c<svg><title>d</title></svg></p><textarea>e</textarea></article>"),
        ("http://g/", '<article><p>read <span class="ad">buy <i>now</i></span>this<br>line</p><p hidden>no</p><p style="display: none">no</p></article>'),
        ("http://i/", "<table><tr><td>a<td>b<tr><td>c</table>"), ("http://j/", "<!-- only a comment"), ("http://k/", "<article>x</article" * 3),
    ]
    got = texts(spark, pages)
    assert got[:5] == ["", "", "", "plain text only", ""]
    assert got[5] == long.strip() and got[6] == "deep text"
    assert got[7].startswith("one\ntwo") and got[7].endswith("four &am & <b> éé &nope; a < b <")
    assert got[8:11] == ["same"] * 3 and got[11] == "x" and got[12] == "ac" and got[13] == "read this line"
    assert got[14] == "a\nb\nc" and got[15] == "" and got[16].startswith("x")


def test_empty_table(spark):
    assert pw.main_text(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pw.learn_wrappers(spark.createDataFrame([], SCHEMA)).collect() == []


def expression(items):
    """A wrapper as text: ? is optional, + repeated, * both."""
    found = []
    for key, kind, _, *rest in items:
        mark = ["", "?", "+", "*"][kind]
        body = "" if key == pw.TEXT else "(" + expression(rest[0]) + ")"
        found.append(("" if key.startswith("(") else key) + body + mark)
    return " ".join(found)


def learn(*pages):
    reader, wrapper = pw.Reader(), None
    for page in pages:
        new = pw.generalised(reader.page(page))
        wrapper = new if wrapper is None else pw.aligned(wrapper, new)
    return wrapper


def test_inference():
    assert expression(learn("<ul><li>a<li>b</ul>", "<ul><li>c</ul>")) == "ul(li(#)+)"
    assert expression(learn("<h1>a</h1><p>b</p>", "<h1>a</h1><div>x</div><p>b</p>")) == "h1(#) div(#)? p(#)"
    assert expression(learn("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>")) == "dl((dt(#) dd(#))+)"
    assert expression(learn("<dl><dt>a<dd>b</dl>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>")) == "dl((dt(#) dd(#))+)"
    assert expression(learn("<p>a</p><table></table>", "<h2>x</h2><table></table>")) == "p(#)? h2(#)? table()"
    ((_, _, pages, ((_, _, _, size, links, same),)),) = learn("<p>ab</p>", "<p><a>ab</a></p>")
    assert (pages, size, links) == (2, 4, 2) and same is not None
    assert learn("<p>ab</p>", "<p>cd</p>")[0][3][0][5] is None


def test_order_of_pages_does_not_decide(spark):
    """A wrapper covers each page that it was learned from."""
    rng = random.Random(3)
    parts = ["<h1>t</h1>", "<p>a</p>", "<p>b</p><p>c</p>", "<ul><li>x<li>y</ul>", "<div class=q>z</div>", "<dl><dt>a<dd>b<dt>c<dd>d</dl>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    wrapper, reader = learn(*pages), pw.Reader()

    def shape(children):
        """The page as a word over tags."""
        return "".join("#" if isinstance(c, tuple) else f"<{c[0]}>{shape(c[1])}</>" for c in children)

    def pattern(items):
        found = ""
        for key, kind, _, *rest in items:
            body = "#" if key == pw.TEXT else pattern(rest[0]) if key.startswith("(") else f"<{re.escape(key)}>{pattern(rest[0])}</>"
            found += f"(?:{body})" + ["", "?", "+", "*"][kind]
        return found

    for page in pages:
        assert re.fullmatch(pattern(wrapper), shape(reader.page(page))), page
    assert unescape("&amp;") == "&"
