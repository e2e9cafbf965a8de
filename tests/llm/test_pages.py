import random
import time
import timeit
from html.parser import HTMLParser

import pytest

from statforge.llm.pages import page_texts, visible_text


class Plain(HTMLParser):
    """All text outside script, style and title, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        self.out.append("" if tag in ("a", "b") else " ")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_words_equal_those_of_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    text = {r.page_id: r.text for r in page_texts(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        assert [w for w in text[r.page_id].split() if w != "-"] == [w for w in "".join(plain.out).split() if w != "-"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<div>x</div>y<div>z", "x\ny\nz"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table>", "Name  | Qty\napple | 3"),
        ("<table>stray<tr><td>1</table>", "stray\n\n1"),
        ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
        ("x <b>y</b>z   w", "x yz w"),
        ("<div hidden>no</div><p style='display: none'>no</p>yes<script>no</script><style>no</style><!-- no -->", "yes"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<head><title>no</title></head>&lt;b&gt; &amp; &eacute;", "<b> & é"),
        ("<dl><dt>T<dd>D</dl>", "T\n    D"),
        ("</p></div></table>x<p a='>b", "x<p a='>b"),
        ("<table><tr><td>a<table><tr><td>b</table><td>d</table>", "a | d\n  |\nb |"),
        ("", ""),
        ("<script>never closed", ""),
        ("<!-- never closed", ""),
        ("<p>É<h1>Head</h1>text<blockquote>q</blockquote>", "É\n\nHead\n\ntext\n\n  q"),
    ],
)
def test_rendering(page, text):
    got = visible_text(page)
    assert [x.rstrip() for x in got.split("\n")] == [x.rstrip() for x in text.split("\n")]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ol><li>a<li value=5>b<li>c</ol>", "1. a\n5. b\n6. c"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol reversed start=9><li>a<li value=2>b<li>c</ol>", "9. a\n2. b\n1. c"),
        ("<ul><li value=7>a</ul>", "- a"),
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>", "yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>yes", "yes"),
        ("<style>.x{display:none} #y{visibility:hidden} p.z, i {display : none}</style><p class='a x'>no</p><p id=y>no</p><p class=z>no</p><b class=z>yes</b><i>no</i>", "yes"),
        ("<style>.x{display:none}.x{display:block}</style><p class=x>yes", "yes"),
        ("<style>p{display:none}</style><p style='display:block'>yes<p>no", "yes"),
        ("<style>@media print {.x{display:none}} /* .x{display:none} */ a .x{display:none}</style><p class=x>yes", "yes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a | b | c\nd |   | e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>d</table>", "wide one | c\na | b | d"),
        ("<table><tr><td>only<tr><td><p>x<p>y</table>z", "only\n\nx\n\ny\n\nz"),
        ("<table>" + "<tr><td>" + "w" * 1200 + "<td>b</table>", "w" * 1200 + "\nb"),
    ],
)
def test_lists_styles_and_spans(page, text):
    assert visible_text(page) == text


def plain_page(rnd, depth):
    """A random tree of blocks as (markup, lines): what a plain recursive renderer gives for it."""
    kind = rnd.randrange(5 if depth else 2)
    words = " ".join(rnd.choice(["alpha", "beta", "x", "Größe"]) for _ in range(rnd.randrange(1, 4)))
    if kind == 0:
        return f"<p>{words}</p>", ["", words, ""]
    if kind == 1:
        return f"<div>{words}</div>", [words]
    if kind == 2:
        parts = [plain_page(rnd, 0) for _ in range(rnd.randrange(1, 4))]
        return f"<div>{''.join(m for m, _ in parts)}</div>", [x for _, lines in parts for x in lines]
    if kind == 3:
        parts = [" ".join(rnd.choice(["one", "two"]) for _ in range(rnd.randrange(1, 3))) for _ in range(rnd.randrange(1, 4))]
        return f"<ol>{''.join(f'<li>{p}' for p in parts)}</ol>", ["", *(f"{k}. {p}" for k, p in enumerate(parts, 1)), ""]
    cells = [[(plain_page(rnd, depth - 1) if rnd.random() < 0.5 else ("v", ["v"])) for _ in range(3)] for _ in range(rnd.randrange(1, 4))]
    texts = [[squeezed(lines) for _, lines in row] for row in cells]
    width = [max(len(x) for row in texts for x in row[c]) for c in range(3)]
    lines = []
    for row in texts:
        for k in range(max(map(len, row))):
            lines.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, width)).rstrip())
    return f"<table>{''.join('<tr>' + ''.join(f'<td>{m}</td>' for m, _ in row) for row in cells)}</table>", ["", *lines, ""]


def squeezed(lines):
    """Blank lines one at a time, none at the ends."""
    out = []
    for x in lines:
        if x or out and out[-1]:
            out.append(x)
    while out and not out[-1]:
        out.pop()
    return out


def test_layout_equals_a_plain_renderer():
    rnd = random.Random(12)
    for _ in range(400):
        parts = [plain_page(rnd, 3) for _ in range(rnd.randrange(1, 5))]
        got = visible_text("<body>" + "".join(m for m, _ in parts)).split("\n")
        assert got == squeezed([x for _, lines in parts for x in lines])


def test_large_pages_end_soon():
    pages = ["<div>" * 200_000 + "x", "<table>" + "x<b></b>" * 50_000, "<table><tr><td>x" * 20_000, "<table><tr><td>a<td>x" * 20_000, "<ul><li>x" * 20_000, "<blockquote>x" * 20_000, "<p><table><td>" * 3000]
    for page in pages:
        start = time.process_time()
        got = visible_text(page)
        assert time.process_time() - start < 10 * CALIBRATED, page[:30]
        assert got.count("x") == page.count("x")


#: Seconds that a loop of known cost takes here, over those on an idle machine.
CALIBRATED = max(1.0, min(timeit.repeat("sum(range(1_000_000))", number=1, repeat=3)) / 0.02)


def test_hostile_pages():
    for page in ("<div" * 3000, "<div>" * 20000 + "x", "<table>" * 300 + "x", "<table><tr><td>" * 2000 + "x", "<" * 5000, "&" * 5000, "<b><i>" * 5000 + "x</b>" * 5000):
        visible_text(page)
    assert visible_text("<div>" * 20000 + "x") == "x" and visible_text("<table><tr><td>" * 2000 + "x") == "x"


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "<p>a", "c"), (None, "b", "c")], "page_id long, html string, text string")
    assert sorted(map(str, (tuple(r) for r in page_texts(df).collect()))) == sorted(map(str, [(1, None), (2, ""), (2, "a"), (None, "b")]))
    assert page_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><form><tr><td>x</td></tr></form></table>", "x"),
        ("<table><form action=a><tr><td>x<td>y</form><tr><td>z<td>w</table>after", "x | y\nz | w\n\nafter"),
        ("<table><tbody><form><tr><td>x</table>", "x"),
        ("<table><tr><form><td>x<td>y</form></table>", "x | y"),
        ("<form><table><form><tr><td>x</td></tr></form></table>y</form>z", "x\n\ny\nz"),
        ("<table><colgroup><col><tr><td>x</table>", "x"),
        ("<table><colgroup><col><col><td>x<td>y</table>", "x | y"),
        ("<table><colgroup><col><tbody><tr><td>x</table>", "x"),
        ("<table><colgroup>stray<p>too<tr><td>x</table>", "stray\n\ntoo\n\nx"),
        ("<table><div>stray<tr><td>x<td>y</table>", "stray\n\nx | y"),
        ("<table><caption>C<tr><td>x<td>y</table>", "C\nx | y"),
        ("<table><colgroup><form><tr><td>x</table>", "x"),
    ],
)
def test_forms_and_open_colgroups_in_tables(page, text):
    assert visible_text(page) == text
