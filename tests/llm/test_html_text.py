import pytest

from quillstream.llm import html_text
from quillstream.llm._support import table

CASES = {
    "<p>One<p>two <b>bold</b>\n text<br>next": "One\n\ntwo bold text\nnext",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li>y</ol>after": "3. x\n4. y\n\nafter",
    "<table><tr><th>Name<th>Age<tr><td>Li<td>7<tr><td>Maximilian<td>30</table>": "Name        Age\nLi          7\nMaximilian  30",
    "<td>lone": "lone",
    "<div hidden>no</div><div style='display: NONE'>no</div>yes<script>var a='<p>';</script><noscript>no</noscript>": "yes",
    "<style>.x, #y {display:none} p{margin:0}</style><p class='a X'>no</p><p id=y>no</p><p>yes": "yes",
    "<title>no</title><h1>Head</h1>text<!-- <p>no</p> -->&amp;&lt;p&gt; &eacute;": "Head\n\ntext&<p> é",
    "<pre>a  b\n   c</pre>d": "a  b\n   c\n\nd",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "<blockquote><p>q<p>r</blockquote>": "> q\n>\n> r",
    "a<hr>b": "a\n---\nb",
    "x<div>y<div>z</div></div>w": "x\ny\nz\nw",
    "<p>a <span> b</span> c</p>": "a b c",
    "<a href='x>y'>link</a>": "link",
    "<table><tr><td>a<table><tr><td>in</table></td><td>b</table>end": "a   b\n\nin\n\nend",
    "no tags < 3 & > 2": "no tags < 3 & > 2",
    "": "",
    "<p>open <b": "open",
    "</p></div>x": "x",
    "<table><tr><td>日本<td>x<tr><td>abcdef<td>y</table>": "日本    x\nabcdef  y",
    "<select><option>a<option>b</select><input value=no>ok": "ok",
}


CASES |= {
    "a<!-->b<p>c": "ab\n\nc",
    "a<!--->b<!-- x --!>c<!-- > -->d": "abcd",
    "<style>@media print{.x{display:none}} .y{display:none}</style><p class=x>seen<p class=y>no<p>end": "seen\n\nend",
    "<style>@media screen and (max-width: 600px){p{display:none}} @media (min-width:600px){.z{display:none}}</style><p>a<p class=z>b": "a",
    "<style>@font-face{src:x} @supports (display:grid){.a{display:none}} @import 'x'; b{display:none}</style><i class=a>1</i><b>2</b><i>3</i>": "3",
    "<style>div.x p{display:none} ul > li.q{display:none}</style><div class=x><span><p>no</span></div><p>yes<ul><li class=q>no<li>on</ul>": "yes\n\n- on",
    "<style>.m{display:none} #k.m{display:block}</style><div class=m>no</div><div id=k class=m>yes</div>": "yes",
    "<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>": "yes",
    "<style>a:hover{display:none} [x]{display:none} *{color:red}</style><a x=1>link</a>": "link",
    "<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>": "A  b\n   c\nd  e",
    "<table><tr><td>1<td rowspan=2 colspan=2>w<td>2<tr><td>3<td>4<tr><td>5</table>": "1  w    2\n3       4\n5",
    "<ol><li value=5>x<li>y<li value=2>z</ol>": "5. x\n6. y\n2. z",
    "<p>t<textarea> a &lt;b&gt;\nc</textarea>u": "t\n\n a <b>\nc\n\nu",
    "<svg><title>no</title><text>drawn</text><style>x{}</style></svg><math><mi>x</mi><mo>+</mo><mi>y</mi></math>": "drawnx+y",
    "<div hidden>no</div><div hidden style='display:block'>yes</div>": "yes",
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert html_text.page_text(page) == CASES[page]


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "core" + "</div>" * 5000
    assert html_text.page_text(deep) == "core"
    assert html_text.page_text("<ul><li>" * 3000 + "x").strip().endswith("x")
    assert html_text.page_text("<p>" + "word " * 100_000).count("word") == 100_000
    assert html_text.page_text("<" * 20_000) == "<" * 20_000


def test_all_visible_words_of_pages(spark, sf):
    import html as h
    import re

    pages = table(spark, sf, "pages")
    got = {r.page_id: r.text for r in html_text.render(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        words = h.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        shown = re.sub(r"(?m)^ *(- |[0-9]+\. |---$)", "", got[r.page_id])
        assert "".join(shown.split()) == "".join(words)


def test_lists_and_tables_keep_their_form_at_any_depth():
    deep = 400
    page = "<div>" * deep + "<ul><li>a<li>b</ul><table><tr><td>x<td>y</table>" + "</div>" * deep
    assert html_text.page_text(page) == "- a\n- b\n\nx  y"


def plain_words(page):
    """A second reading of a page, by the standard library's parser: its visible words in order, with nothing laid out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.words = [], []

        def handle_starttag(self, tag, attrs):
            attrs = dict(attrs)
            style = (attrs.get("style") or "").replace(" ", "").lower()
            gone = tag in html_text.UNSEEN or "hidden" in attrs or "display:none" in style or "visibility:hidden" in style
            if tag not in html_text.VOID:
                self.stack.append((tag, gone or bool(self.stack and self.stack[-1][1])))

        def handle_endtag(self, tag):
            if tag in [t for t, _ in self.stack]:
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if not (self.stack and self.stack[-1][1]):
                self.words.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return "".join("".join(reader.words).split())


def test_equals_a_plain_reading_on_whole_tables(spark):
    """Every page of sf0.01: the same visible characters as the plain reading, in the same order."""
    import re

    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_text.render(pages).collect()}
    for r in pages.collect():
        shown = re.sub(r"(?m)^ *(- |[0-9]+\. |---$)", "", got[r.page_id])
        assert "".join(shown.split()) == plain_words(r.html), r.page_id


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", ""), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.text, r.n_chars, r.n_lines) for r in html_text.render(df).collect())
    assert got == [("1", "", 0, 0), ("2", "", 0, 0), ("2", "", 0, 0), ("None", "x", 1, 1)]
    assert html_text.render(df.limit(0)).count() == 0
