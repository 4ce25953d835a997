import html
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import html_text, queries
from ledgerloom.llm.html_text import extract, main_text


def brute(page):
    """The tables' pages hold one article of headings and paragraphs."""
    inner = page[page.index("<article>") + 9 :]
    inner = inner[: inner.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[a-z/][^>]*>", "\n", x)).split()) for x in parts)
    return "\n\n".join(t for t in texts if t)


def test_pages_match_brute_force(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op6_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.url) == (brute(pages[r.page_id].html), pages[r.page_id].url)
        assert r.n_chars == len(r.text)


def test_marks_have_no_privilege(spark, sf_dir):
    """article and main renamed to div: the densities alone find the same texts."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        assert main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", r.html)) == brute(r.html)


def test_densities_by_definition(spark, sf_dir):
    """The core by plain recursion: every figure counted anew for every node."""

    def kids(n):
        return [c for c in n.children if not isinstance(c, str) and not c.dropped]

    def below(n):
        return [x for c in kids(n) for x in [c, *below(c)]]

    def chars(n):
        return sum(len("".join(c.split())) for c in n.children if isinstance(c, str)) + sum(map(chars, kids(n)))

    def linked(n):
        return chars(n) if n.tag == "a" else sum(map(linked, kids(n)))

    def density(n, body):
        c, lc, t, lt = chars(n), linked(n), max(1, len(below(n))), max(1, sum(x.tag == "a" for x in below(n)))
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + linked(body) / max(1, chars(body)) * c + math.e)
        return c / t * (math.log(max(1.0, c / max(1, lc) * t / lt)) + 1) / base

    def total(n, body):
        return sum(density(c, body) for c in kids(n) if c.tag not in html_text.INLINE)

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect():
        page = re.sub(r"<(/?)(article|footer|nav)\b", r"<\1div", r.html)
        root = html_text.parse(page)
        body = next(n for n in below(root) if n.tag == "body")
        nodes = html_text.measure(body)
        for n in nodes:
            assert math.isclose(n.density, density(n, body), abs_tol=1e-9) and math.isclose(n.total, total(n, body), abs_tol=1e-9)
        core = max((n for n in [body, *below(body)] if n.tag not in html_text.INLINE), key=lambda n: (round(total(n, body), 9), chars(n)))
        assert any(core is x or core in below(x) or x in below(core) for x in html_text.main_nodes(root))


LONG = "This is a sentence of the article that says something about the matter at hand, and goes on for a while. "


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>one<p>two  \n three<br>four</p>", "one\n\ntwo three four"),
        ("<body><header><h1>Site</h1></header><main><h2>T</h2><p>x &lt;b&gt; y</p></main><footer>f</footer>", "T\n\nx <b> y"),
        ("<article><header><h1>T</h1></header>a<aside>no</aside>b<div class='comments'><p>no</p></div><script>var a='</p>';</script></article>", "T\n\na\n\nb"),
        ("<article>a<!-- <p>no</p> -->b<style>p{}</style> &#65;&nbsp;&eacute;&copy c</article>", "ab A é© c"),
        ("<article><p>1 < 2 and 3 > 2</p></article", "1 < 2 and 3 > 2"),
        ("<article><p title='a>b'>x</p><form><input>no</form><div id=cookie-notice>no</div></article>", "x"),
        ("<script>only</script>", ""),
        (
            "<html><body><div id='top'><a href='/'>home</a> <a href='/b'>about</a></div><div class='content'>"
            + f"<h1>Heading of it</h1><p>{LONG * 3}</p><p>{LONG * 2}</p><p>{LONG}</p></div><div><a href='/1'>one</a> <a href='/2'>two</a> <a href='/3'>three</a></div></body></html>",
            "\n\n".join(["Heading of it", *[" ".join((LONG * k).split()) for k in (3, 2, 1)]]),
        ),
        ("<div class=sidebar>no</div>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


FIVE = "".join(f"<p>{LONG * 2}</p>" for _ in range(5))
LINKS = "<div><a href='/1'>one</a> <a href='/2'>two</a> <a href='/3'>three</a></div>"


@pytest.mark.parametrize(
    ("page", "paragraphs", "others"),
    [
        (f"<body>{LINKS}<div>{FIVE}</div><div>{FIVE}</div></body>", 10, []),
        (f"<body><h1>The heading of it all</h1><div>{FIVE}</div>{LINKS}</body>", 5, ["The heading of it all"]),
        (f"<body><div><div>{FIVE}</div><p>By A. Writer</p><div>{FIVE}</div></div>{LINKS}</body>", 10, None),
        (f"<body><article><p>Read this too</p></article><div>{FIVE}</div></body>", 5, None),
    ],
)
def test_text_in_several_containers(page, paragraphs, others):
    got = main_text(page).split("\n\n")
    want = " ".join((LONG * 2).split())
    assert got.count(want) == paragraphs and "one two three" not in got
    assert others is None or [g for g in got if g != want] == others


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("<>/pabd!-\"'= &;x\n")), max_size=80))
def test_any_text_is_parsed(page):
    main_text(page)


def test_odd_rows(spark):
    rows = [(1, None, None, 1), (None, "u", "<p>x</p>", 2), (3, "v", "", 3), (3, "v", "", 3), (4, None, "<p>" + "y " * 200000, 4)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = [(1, None, "", 0), (None, "u", "x", 1), (3, "v", "", 0), (3, "v", "", 0), (4, None, "y " * 199999 + "y", 399999)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int").limit(0)).collect() == []
