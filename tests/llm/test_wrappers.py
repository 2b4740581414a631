"""Main texts against a plain reader of the article element, and wrappers of hand-made pages."""

from html.parser import HTMLParser

import pytest

from cadenza.llm import plans, wrappers
from cadenza.llm.wrappers import Plan, Wrapper, main_text


class Article(HTMLParser):
    """Text of the article, a line for each block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


def plain(page):
    reader = Article()
    reader.feed(page or "")
    reader.close()
    return "\n".join(line for x in reader.lines if (line := " ".join(x.split())))


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_equals_a_plain_reader(spark, scale):
    folder = f"/root/testdata/{scale}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    out = plans.QUERIES["op12_wrappers"](spark, folder).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def wrapper_of(*pages):
    whole = Wrapper()
    for page in pages:
        whole.add_page(page)
    return whole


def text(page, *others):
    return main_text(page, Plan(wrapper_of(page, *others).text()))


def test_mismatches_become_slots_options_and_repeats():
    a = "<div><h1>One</h1><ul><li>a<li>b</ul><p>Same</p></div>"
    b = "<div><h1>Two</h1><ul><li>c</ul><p>Same</p><hr><table><tr><td>x</table></div>"
    assert str(wrapper_of(a, b)) == (
        "<div><h1>#text</h1> <ul>(<li>#text</li>)+</ul> <p>text</p> (<table><tr><td>text</td></tr></table>)?</div>")
    c, d = "<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>"
    assert str(wrapper_of(c, d)) == str(wrapper_of(d, c)) == "<dl>(<dt>#text</dt> <dd>#text</dd>)+</dl>"


def test_merged_parts_take_all_pages():
    pages = [f"<body><nav><a>{i}</a></nav><section><h2>t{i}</h2>{'<p>x' * (i % 4)}{'<blockquote>q</blockquote>' * (i % 2)}</section>" for i in range(12)]
    left, right = wrapper_of(*pages[:5]), wrapper_of(*pages[5:])
    left.add(Wrapper(right.text()))
    assert left.pages == 12
    assert str(left) == str(wrapper_of(*pages))


PARTS = (
    "<header><a href=/>Site</a><h2>Slogan</h2></header><div class='cookie-notice'>We use cookies</div>"
    "<nav><ul><li>Home<li>News</ul></nav>{body}<aside>Side</aside><div id=sidebar>More</div>"
    "<form><label>Mail</label><button>Send</button></form><section id='comments'><article class='comment'><p>First!</p></article></section>"
    "<script>if (a < b) x('<p>no</p>')</script><style>p{{}}</style><!-- <p>no</p> --><footer>Bottom</footer>"
)


@pytest.mark.parametrize("body", [
    "<article class='post has-sidebar'>{}</article>", "<main>{}</main>", "<div class='entry-content'>{}</div>",
    "<div role=main>{}</div>", "<div class=c7>{}</div>",
])
def test_only_the_article_stays(body):
    inner = (
        "<header><h1>Fish &amp; <i>chips</i>&nbsp;{0}</h1></header><p>One\n two{0}<br>three<p>Four&#33; <a href=x>five</a>"
        "<div class='ad'>Buy</div><ul><li>six<li>seven {0}</ul><table><tr><td>8<td>nine{0}</table>"
    ) if "c7" not in body else (
        "<h1>Fish &amp; <i>chips</i>&nbsp;{0}</h1><p>One\n two{0}<br>three<p>Four&#33; {0} <a href=x>five</a>"
        "<div class='ad'>Buy</div><ul><li>six {0}<li>seven {0}</ul><table><tr><td>8<td>nine{0}</table>"
    )
    pages = ["<!DOCTYPE html><html><head><title>T</title></head><body>" + PARTS.format(body=body.format(inner.format(i))) for i in ("", " longer", " other")]
    want = "Fish & chips\nOne two three\nFour! five\nsix\nseven\n8\nnine"
    assert text(pages[0], *pages[1:]) == want
    assert text(pages[0]).startswith("Fish & chips\nOne two three\nFour! five")


def test_text_that_never_changes_is_left_out_only_without_an_article():
    pages = [f"<body><div><p>Top of all pages, every time the same</p><div><p>{w * 20}</p><p>{w} end</p></div><p>Bottom line</p></div>" for w in ("red ", "blue ", "green ")]
    assert text(pages[0], *pages[1:]) == " ".join(["red"] * 20) + "\nred end"
    same = "<article><p>Same words</p><p>again</p></article>"
    assert text(same, same, same) == "Same words\nagain"
    plainly = "<body><div><p>Same words</p><p>again</p></div>"
    assert text(plainly, plainly) == "Same words\nagain"


def test_teasers_do_not_win_over_the_text():
    page = lambda w: f"<main><p>{w * 40}</p></main><div><article>teaser {w}</article></div>"
    assert text(page("a "), page("b ")) == " ".join("a" * 40)


@pytest.mark.parametrize("page", [
    "", " ", "<", "<p", "a < b", "<article>", "</p></div>", "<p title=\"x>y", "<script>var", "<!-- open", "<article><p>x</artic",
    "<a" * 500, "<div>" * 3000 + "deep", "<b><p></b></p>" * 50, "&#xD800;&#0;&bogus;", "<table><tr><td><p>a</table><p>b",
])
def test_broken_pages(page):
    text(page)
    assert text(f"<article><p>x &am y</p>{page}").startswith("x &am y")


def test_wide_and_varied_hosts_stay_bounded(monkeypatch):
    monkeypatch.setattr(wrappers, "WIDE", 12)
    monkeypatch.setattr(wrappers, "PLACES", 60)
    tags = ["p", "div", "ul", "table", "blockquote", "pre", "h2", "section"]
    pages = []
    for i in range(40):
        order = [tags[(i * j + j) % 8] for j in range(1, 14)]
        pages.append("<body><nav>menu</nav><article>" + "".join(f"<{t} class=k{'xyz'[(i + k) % 3]}{t}{k}><p>t{i}.{k}</p></{t}>" for k, t in enumerate(order)) + "</article>")
    whole = wrapper_of(*pages)
    assert wrappers._size(whole.items) <= 200
    plan = Plan(whole.text())
    for i, page in enumerate(pages):
        assert main_text(page, plan) == "\n".join(f"t{i}.{k}" for k in range(13))


def test_nulls_repeats_hosts_and_clashing_columns(spark):
    body = "<nav>m</nav><article><p>{}</p></article>"
    pages = spark.createDataFrame(
        [(1, None, body.format("a"), "h", 1), (2, "not a url", None, "h", 1), (3, "http://U:p@A.example:80/x", body.format("c"), "h", 1),
         (3, "http://a.example", body.format("c"), "h", 1), (None, "//a.example?q", "", "h", 1)],
        "page_id long, url string, html string, host string, wrapper int")
    out = {(r.page_id, r.url): r for r in wrappers.extract(pages).collect()}
    assert len(out) == 5 and [r.text for r in out.values() if r.page_id == 3] == ["c", "c"]
    assert out[1, None].text == "a" and out[2, "not a url"].text == "" and out[None, "//a.example?q"].text == ""
    assert out[1, None].host == "h" and out[1, None].wrapper == 1
    assert sorted(r.host for r in wrappers.infer(pages).collect()) == ["", "a.example"]
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_partial_wrappers_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 3)
    rows = [(i, "http://one.example/", f"<nav>m</nav><div><p>{i} text {'x' * (i % 7)}</p></div>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(20)
    found = wrappers.infer(pages).collect()
    assert len(found) == 1 and Wrapper(found[0].wrapper).pages == 60
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == {i: " ".join(f"{i} text {'x' * (i % 7)}".split()) for i in range(60)}
