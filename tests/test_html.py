import html as stdlib_html
import random
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from marquee.functions import html as H
from marquee.functions.page_nodes import Page, parse_selector


def pick(page, selector):
    found = Page(page)
    return [found.outer(at) for at in found.find(parse_selector(selector))]


def texts(page, selector):
    found = Page(page)
    return [found.text(at) for at in found.find(parse_selector(selector))]


def test_nested_and_overlapping_elements_in_page_order():
    page = '<div class="movie"><div><b>x</b><div class="a movie"><p>y</div></div></div><section class="movies">n</section>'
    got = pick(page, ".movie, section")
    assert [g[:12] for g in got] == ['<div class="', '<div class="', '<section cla']
    assert got[1] == '<div class="a movie"><p>y</div>'


@pytest.mark.parametrize("selector, ids", [
    ("h2", ["1"]), ("h2, h3", ["1", "2"]), (".t", ["1", "3", "5"]), ("h2.t", ["1"]), ("p[lang]", ["3"]),
    ("a[href*='/film/']", ["4"]), ("span[property='v:votes']", ["6"]), ("h1", []), (".T", []), (".t-x", ["2"])])
def test_selectors(values, selector, ids):
    page = ("<H2 id=1 class='a t'>A</H2><h3 id=2 class=\"t-x\">B</h3><p id=3 lang=en class=t>C<a id=4 href=\"/film/1\">D</a>"
            "<i id=5 class=\"\tt\n\">E</i><span id=6 property='v:votes'>7</span><span id=7 property='v:voted'>8</span>")
    assert values(lambda c: H.select_all(c, selector, "@id"), [page])[0] == ids


def test_table_cells_without_end_tags():
    page = Page("<table class=s><tr><td>1<td>2<tr><td>3<table><tr><td>in</table></td><td>4</table><tr><td>outside")
    rows = page.find(parse_selector(".s tr"))
    assert [len(page.find(parse_selector("td"), row, page.ends[row])) for row in rows] == [2, 3, 1]


def test_markup_characters_in_attributes_and_any_ancestor():
    page = ("<div class=list data-x='a > b' title=\"<p class=movie>\"><ul><li class=on>1<b>x</b></li></ul><p>2</p></div><ul><li class=on>3</li></ul>"
            "<div class=list><div class=list><li class=on>4</li></div></div><a href=/a>b>c</a><img alt=\"it's\" src=x.png><p title=&quot;q&#x3e;>5")
    assert texts(page, ".list .on") == ["1x", "4"] and texts(page, "div.list ul li.on b") == ["x"]
    assert texts(page, "a") == ["b>c"] and texts(page, "p") == ["2", "5"]
    found = Page(page)
    assert found.attributes(found.find(parse_selector("p[title]"))[0]) == {"title": '"q>'}
    assert found.attributes(0) == {"class": "list", "data-x": "a > b", "title": "<p class=movie>"}


def test_unclosed_element_runs_to_the_end():
    assert pick("<div class=m>a<div>b</div>", ".m") == ["<div class=m>a<div>b</div>"]


def test_long_page_does_not_overflow():
    page = "<div class=m>" + "<div><p>x</p></div>" * 60_000 + "</div><div class=m>z</div>"
    got = pick(page, ".m")
    assert len(got) == 2 and len(got[0]) == len(page) - len("<div class=m>z</div>")


def test_stray_end_tags_below_many_open_elements_are_quick():
    page = "<div>" * 50_000 + "<td>" + "</div></span>" * 50_000 + "</td><p class=m>z"
    assert texts(page, ".m") == ["z"]


@pytest.mark.parametrize("depth", [20, 26, 300])
def test_deep_nesting_of_one_tag(depth):
    page = "<div class=m>" + "<div>" * depth + "x" + "</div>" * depth + "</div><div class=m>y</div>"
    assert [len(e) for e in pick(page, ".m")] == [len(page) - 20, 20]


def test_nested_tables_stay_in_their_cell():
    page = "<table class=s><tr><td>" + "<table><tr><td>" * 5 + "in" + "</td></tr></table>" * 5 + "</td><td>10:00</td></tr><tr><td>next"
    rows = pick(page, ".s tr")
    assert rows[0].endswith("<td>10:00</td></tr>") and rows[-1] == "<tr><td>next" and len(rows) == 7


def test_unclosed_element_ends_with_its_parent():
    page = ("<section><div class=movie-block><h3>A</h3><span class=time>10:00</span></section>"
            "<section><div class=movie-block><h3>B</h3><span class=time>11:00</span></div></section>")
    assert pick(page, ".movie-block") == ["<div class=movie-block><h3>A</h3><span class=time>10:00</span>",
                                          "<div class=movie-block><h3>B</h3><span class=time>11:00</span></div>"]


def test_end_tags_that_close_nothing_are_dropped():
    assert texts("<div class=m></span>a</p></div></div><div class=m>b<table><tr><td></div>c</table>d</div>", ".m") == ["a", "bcd"]


def test_lists_and_paragraphs_end_where_html_lets_them():
    page = "<ul class=l><li>a<li>b<ul><li>c</ul>d<li><p>e<p>f<div>g</div></ul><dl><dt>x<dd>y<dt>z</dl>"
    assert pick(page, "li, p, dt") == ["<li>a", "<li>b<ul><li>c</ul>d", "<li>c", "<li><p>e<p>f<div>g</div>", "<p>e", "<p>f", "<dt>x", "<dt>z"]


def test_rows_only_inside_tables():
    assert texts("<tr><td>no</td></tr><article>y</article><table><tbody><tr><td>1<tr><td>2</table>", "article, table tr") == ["y", "1", "2"]


def test_pages_of_closed_elements_agree_with_the_standard_library():
    """Texts and nesting of generated pages without missing tags, against a plain parse of the same page."""
    class Plain(HTMLParser):
        def __init__(self, wanted):
            super().__init__()
            self.wanted, self.open, self.found = wanted, [], []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                return
            self.open.append((tag, len(self.found) if tag == self.wanted else None))
            if tag == self.wanted:
                self.found.append("")

        def handle_endtag(self, tag):
            assert self.open.pop()[0] == tag

        def handle_data(self, data):
            for _, at in self.open:
                if at is not None:
                    self.found[at] += data

    rng = random.Random(5)

    def element(depth):
        inner = "".join(rng.choice(["t ", "a &amp; b", "<br>", "&#x7247;", "<!-- <i> -->"]) if depth == 0 or rng.random() < 0.4 else element(depth - 1)
                        for _ in range(rng.randint(0, 4)))
        tag = rng.choice(["div", "span", "b", "section"])
        return f"<{tag} title='{rng.choice(['x', 'a > b', '</b>'])}'>{inner}</{tag}>"

    for _ in range(200):
        page, tag = element(5), rng.choice(["div", "span", "b"])
        plain = Plain(tag)
        plain.feed(page)
        plain.close()
        assert texts(page, tag) == plain.found


def test_noise_is_removed():
    page = "<script>'</div><h2>no</h2>'</script><STYLE>x</STYLE><!-- <h2>no</h2> --><h2>yes</h2>"
    assert pick(page, "h2") == ["<h2>yes</h2>"]


def test_references_are_decoded_once(values):
    cases = ["a &amp; b", "&lt;p&gt;", "&#39;x&#x27;", "&#12363;&#x7247;", "&amp;lt;", "&#38;lt;b&#38;gt;", "Caf&eacute; L&rsquo;ami", "&amp", "&notit;", "&unknown;"]
    cases += ["".join(f"&{n} " for n in sorted(html5)[i::6]) for i in range(6)]
    assert values(H.text_of, cases) == [stdlib_html.unescape(c) for c in cases]


def test_attribute_forms(values):
    cases = ['<img data-src="no" src="/a.jpg">', "<img src='/b&amp;c'>", "<img src=/d>", "<img>", '<a><img src="x">', "", None]
    assert values(lambda c: H.attribute(c, "src"), cases) == ["/a.jpg", "/b&c", "/d", "", "", "", ""]


def test_fields_of_missing_pages_are_empty(values):
    got = values(lambda c: H.select_fields(c, {"p": ("p", H.TEXT), "day": ("b", H.STRIPPED)}), ["<p>x</p><b> 4 / <i> 1 </i></b>", "", None])
    assert [tuple(r) for r in got] == [(["x"], ["4 /1"]), ([], []), ([], [])]


@pytest.mark.parametrize("base", ["https://h.jp", "https://h.jp/", "https://h.jp/a/b", "http://h.jp/a/b/?q=1#f", "https://h.jp/a/b/c.html"])
def test_resolve_url_agrees_with_urljoin(values, base):
    links = ["/x", "x", "x/y.png", "//cdn.h/x", "https://o.jp/z", "../x", "../../x", "./x", "../", "..", ".", "?p=2", "#t", "", "/a/../b",
             "/a/./b/", "mailto:x@y", "a/../../b?c=../d"]
    assert values(lambda c: H.resolve_url(F.lit(base), c), links) == [urljoin(base, link) for link in links]


def test_links(values):
    base = F.lit("https://b.jp")
    links = ["/p.jpg", "http://o/p.jpg", "p.jpg", ""]
    assert values(lambda c: H.absolute_link(c, base, False), links) == ["https://b.jp/p.jpg", "http://o/p.jpg", "https://b.jpp.jpg", "https://b.jp"]
    assert values(lambda c: H.absolute_link(c, base, True), links)[2] == "https://b.jp/p.jpg"


def test_unsupported_selector_is_refused():
    with pytest.raises(ValueError):
        H.select_all(F.col("v"), "div > p")
