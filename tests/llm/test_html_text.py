import re
from html.parser import HTMLParser

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm.html_text import NEVER_SHOWN, RAW, extract, extract_pages

CASES = [
    (None, ""),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
    ("<title>t</title><script>var a='</p>';</script><style>p{}</style>x", "x"),
    ("<div>a</div><div>b</div>c", "a\nb\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>end", "- a\n- b\n  - c\n- d\n\nend"),
    ("<ol start=3><li>a</li><li>b<p>c</p></li></ol>", "3. a\n4. b\n\n   c"),
    ("<table><tr><td>a<td>long cell<td>x<tr><th>bb<td>c<td>y</table>", "a   long cell  x\nbb  c          y"),
    ("<table><tr><td colspan=2>head<td>z<tr><td>aaaa<td>bbb<td>c</table>after", "head       z\naaaa  bbb  c\n\nafter"),
    ("<table><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<p hidden>no</p><p style='color:red; display : none'>no</p><p style='visibility:hidden'>no</p>yes", "yes"),
    ("<style>.ad, #x{display:none} /* .ok{display:none} */</style><div class='big ad'>no</div><b id=x>no</b><div class=ok>yes</div>", "yes"),
    ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd"),
    ("a<!-- x --><!>b</>c<!-- open", "abc"),
    ("1 < 2 <3 and <b>bold</b  >!", "1 < 2 <3 and bold!"),
    ("<a href='x>y' title=\"</a>\">link</a> <i>it</i>", "link it"),
    ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details><dialog>no</dialog>", "s\ns\nyes"),
    ("<blockquote>q<p>r</blockquote>z", "> q\n\n> r\n\nz"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("x&nbsp;y  \n z<p></p><p> </p>w", "x y z\n\nw"),
    ("<div>" * 20000 + "deep", "deep"),
    ("<noscript>no</noscript><template>no</template><textarea>\n<b>t</textarea>", "<b>t"),
    ("<body hidden>x", ""),
    ("</p>a</p>b</div>c", "a\n\nbc"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_cases(html, text):
    assert extract(html) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("<p>|</p>|<div>|</div>|<li>|<ul>|</ul>|<table>|<tr>|<td>|</table>|<b>|</b>|<br>|<script>|</script>|<h1>|</h2>|<!--|-->|word|&lt;|<".split("|") + [" ", "\n"]), max_size=40))
def test_never_fails_and_loses_no_plain_word(parts):
    text = extract("".join(parts))
    if not any(p in ("<script>", "<!--", "<", "-->") for p in parts):
        assert text.count("word") == parts.count("word")


class Visible(HTMLParser):
    """Words outside elements that are never shown, by the standard library."""

    def __init__(self):
        super().__init__()
        self.inside, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag in NEVER_SHOWN & (RAW | {"head"}) and tag != "head"

    def handle_endtag(self, tag):
        self.inside -= tag in NEVER_SHOWN & RAW

    def handle_data(self, data):
        if not self.inside:
            self.words += data.split()


def test_driver_pages_keep_all_visible_words(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(60)
    html = {r.page_id: r.html for r in pages.collect()}
    for r in extract_pages(pages).collect():
        v = Visible()
        v.feed(html[r.page_id])
        v.close()
        got = re.sub(r"^\s*- ", "", r.text, flags=re.M)
        assert "".join(got.split()) == "".join(v.words) and r.n_chars == len(r.text)


def test_spark_edges(spark):
    pages = spark.createDataFrame([(1, None), (1, "<p>a"), (None, "")], "page_id long, html string")
    assert sorted((str(r.page_id), r.text) for r in extract_pages(pages).collect()) == [("1", ""), ("1", "a"), ("None", "")]
    assert extract_pages(pages.where("false")).count() == 0


def test_rules_inside_media_blocks():
    hide = "{display:none}"
    page = f"<style>@media print{{.a{hide}}} @media screen, tv{{.b{hide}}} @import url(x); @supports (x:y){{.c{hide}}} @media (max-width:9px){{.d{hide}}} .e{hide} @media print{{</style>" + "".join(f"<p class={c}>{c}</p>" for c in "abcde")
    assert extract(page).split() == ["a", "d"]


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "<p>a</p>", "x", 5), (1, "<p>a</p>", "y", 6), (None, None, "z", 7)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
