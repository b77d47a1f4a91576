import random
import re
import time
from html.parser import HTMLParser

import pytest

from tessera.llm import html_text as ht

SF = "/root/testdata/sf0.01"

CASES = {
    "<p>one<p>two</div>three": "one\n\ntwothree",
    "<p>a  b\n c</p>\n<p> d</p>": "a b c\n\nd",
    "<div>a</div><div>b<div>c</div></div>d": "a\nb\nc\nd",
    "a<br>b<br/><br>c": "a\nb\n\nc",
    "<b>bold</b> and<i> it</i>alic": "bold and italic",
    "x<span> </span>y <span>z</span>": "x y z",
    "<h1>T</h1>text<hr>more": "T\n\ntext\n\nmore",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a<li>b<li value=20>c<li>d</ol>": "9. a\n10. b\n20. c\n21. d",
    "<ul><li><p>a</p><p>b</p></li></ul>": "- a\n\n  b",
    "<dl><dt>t<dd>d1<dd>d2<dt>u</dl>": "t\n  d1\n  d2\nu",
    "<table><tr><th>n<th>long head<tr><td>1<td>2</table>": "n  long head\n1  2",
    "<table><td>a<td>b<tr><td colspan=2>wide cell text</table>": "a  b\nwide cell text",
    "<table><tr><td>a<br>b</td><td>c</td></tr></table>after": "a  c\nb\n\nafter",
    "<table><caption>cap</caption><tbody><tr><td>1</tbody><tfoot><tr><td>2</table>": "cap\n\n1\n2",
    "<pre>a\n  b\n\nc</pre>d": "a\n  b\n\nc\n\nd",
    "<head><title>t</title><style>p{}</style></head><body>b": "b",
    "<script>if (a</b>c) '</p>'</script>x<!-- y -->z": "xz",
    "<p hidden>a</p><p style='display: none'>b</p><p aria-hidden=true>c</p>d": "d",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>": "b",
    "<details><summary>s</summary>body</details><details open><summary>t</summary>u</details>": "s\nt\nu",
    "<select><option>a<option>b</select>c<noscript>n</noscript>": "c",
    "&lt;b&gt; &amp; &eacute;&#233;&nbsp;x": "<b> & éé\xa0x",
    "a < b and c > d": "a < b and c > d",
    "<p>un<b>clo<i>sed": "unclosed",
    "</p></div>x</table>": "x",
    "<a href='x>y' title=\"a>b\">t</a>": "t",
    "<blockquote>q<br>r</blockquote>s": "  q\n  r\n\ns",
    "<!doctype html><!-- open comment": "",
    "": "",
    "<": "<",
    "<textarea><p>a</textarea>b": "b",
}


@pytest.mark.parametrize("page", list(CASES))
def test_pages(page):
    assert ht.page_text(page) == CASES[page]


def test_nested_table_stands_in_its_cell():
    lines = ht.page_text("<table><tr><td>x<table><tr><td>i<td>j</table><td>y</table>").split("\n")
    assert lines[0].split() == ["x", "y"] and lines[-1].strip() == "i  j"


def test_deep_nesting_long_and_random_markup():
    assert ht.page_text("<div>" * 30_000 + "x" + "</div>" * 30_000) == "x"
    assert len(ht.page_text("<p>word " * 100_000).split()) == 100_000
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td>", "</td>", "<li>", "<ul>", "</ul>", "<ol>", "a", " ", "\n", "<!--", "-->",
            "<b", ">", "</", "&amp", "<pre>", "</pre>", "<br>", "'", '"', "<td colspan=x>", "<script>", "</script>", "\x00", "<details>", "é"]
    for _ in range(3000):
        ht.page_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))


class Plain(HTMLParser):
    """Visible words in order, by another parser."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], None

    def handle_starttag(self, tag, attrs):
        if self.skip is None and tag in ("head", "script", "style"):
            self.skip = tag
        if tag in ht.BLOCKS or tag == "br":
            self.out.append(" ")

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if tag in ht.BLOCKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.skip is None:
            self.out.append(data)


def test_words_of_the_given_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = {r.page_id: r.text for r in ht.op10_html_text(spark, SF).collect()}
    assert out.keys() == pages.keys()
    for page, markup in pages.items():
        plain = Plain()
        plain.feed(markup)
        plain.close()
        got = [w for w in re.sub(r"(?m)^ *- ", "", out[page]).split()]
        assert got == "".join(plain.out).split(), page


def test_rows_keep_their_columns(spark):
    rows = [(1, None, 5), (None, "<p>a", 6), (2, "", 7), (2, "", 7)]
    df = spark.createDataFrame(rows, "page_id long, html string, row long").withColumn("text", ht.F.lit("old"))
    out = ht.rendered(df).collect()
    assert sorted((r.page_id or 0, r.text, r.row) for r in out) == [(0, "a", 6), (1, "", 5), (2, "", 7), (2, "", 7)]
    assert ht.rendered(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [
    ["<b '"], ["<b "], ["<b \""], ["<"], ["<!"], ["</"], ["<b '", "x>"], ["<b '", '<i "'], ["<!-"], ["<a b=", "'>"], ["</p>", "<div>"],
    ["<p>", "<div>"], ["<ul><li>x"], ["<blockquote>x"], ["<table><td>x"], ["<td>", "</p>"], ["<p><td>" + "<div>" * 90_000 + "</p>" * 90_000], ["<details>"], ["&"], ["<a x = ' "], ["\""],
])
def test_broken_markup_takes_time_in_proportion(bits):
    """A megabyte of it; stray end tags inside deep elements among them."""
    half = 500_000 // len("".join(bits)) + 1
    pages = ["".join(bits) * 2 * half] if len(bits) == 1 else [bits[0] * half + "".join(bits[1:]) * half]
    for page in pages:
        page = page[:1_000_000]
        began = time.process_time()
        ht.page_text(page)
        assert time.process_time() - began < 5, page[:40]


def ends_one_by_one(page):
    """Start and end of every tag, each searched for from its own ``<``."""
    out, at = [], 0
    whole = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>\"']*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
    while match := whole.search(page, at):
        out.append(match.span())
        at = match.end()
    return out


def test_tags_end_where_a_search_from_each_finds_it():
    rng = random.Random(6)
    bits = ["<b", "<i ", "</u", "'", '"', ">", " ", "x", "=", "<!--", "-->", "<!", "/", "<", "<?"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        tags, at, got = ht.Tags(page), 0, []
        while at < len(page):
            start, at, _ = tags.next(at)
            if start < len(page):
                got.append((start, at))
        assert got == ends_one_by_one(page), page
