from plumbline.llm import html_extraction as hx
from plumbline.llm.queries import op5_html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="top-ad">Buy</div><!-- <p>hidden</p> -->
<article><header><h1>A &amp; B</h1></header><p>One <b>two</b>
 three<br>four<p>Five &lt;6&gt;<div class="newsletter"><p>Sign up</div><aside>Side</aside>
<form><p>Name <input></form><ul><li>x<li>y</ul><section class="comments"><p>First!</p></section></article>
<footer>&copy; 2020</footer>"""


def test_one_page():
    assert hx.main_text(PAGE) == "A & B\n\nOne two three four\n\nFive <6>\n\nx\n\ny"


def test_edge_cases():
    assert hx.main_text(None) == hx.main_text("") == hx.main_text("<p>") == ""
    assert hx.main_text("1 < 2") == "1 < 2"
    assert hx.main_text("plain  text") == "plain text"
    assert hx.main_text("<p>a</p><p hidden>b</p><div style='display: none'>c</div><p>d") == "a\n\nd"
    assert hx.main_text("<article>" + "<p>word</p>" * 30_000 + "</article>").count("word") == 30_000
    assert hx.main_text("<div class='has-sidebar'><p>in</p></div><article class='comment'>no</article>") == "in"


def test_text_outside_an_article_element_is_kept():
    assert hx.main_text("<main> </main><div><p>Real text</p></div>") == "Real text"
    assert hx.main_text("<article><nav>Menu</nav></article><p>Real text") == "Real text"
    cards = "<div><p>The body</p><p>of the page.</p></div><article><h2>A video</h2></article>"
    assert hx.main_text(cards) == "The body\n\nof the page.\n\nA video"


def test_formulas_and_objects_are_text():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data=a.pdf>a <b>file</b></object>.</p><canvas>A plot</canvas></article>"
    assert hx.main_text(page) == "Let x=2 and a file.\n\nA plot"


def _extracted(spark, rows, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template", "3 AS __page")
    found = hx.extract(pages, **how)
    assert found.columns == [*pages.columns, "text"]
    return {r["page_id"]: r["text"] for r in found.collect()}


def test_template_of_a_host_without_semantic_names(spark):
    def page(i):
        return f"<html><body><div class=x1><p>Menu of the site</p></div><div class=x2><p>Story {i} begins</p><p>and ends {i}.</p></div><div class=x3><p>Imprint</p></div></body></html>"

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(12)] + [(50 + i, "http://b.example/", page(0)) for i in range(9)]
    rows += [(70, None, None), (71, "", ""), (72, "http://a.example/new", page(3)), (72, "http://a.example/new", page(3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS template")
    got = {r["page_id"]: r["text"] for r in hx.extract(pages).collect()}
    assert got[4] == "Story 4 begins\n\nand ends 4."
    assert got[72] == "Story 3 begins\n\nand ends 3."
    assert got[50].startswith("Menu of the site\n\nStory 0")  # copies of one page deduce no template
    assert got[70] == got[71] == ""
    assert hx.extract(pages).count() == len(rows)
    assert hx.extract(pages.limit(0)).count() == 0


def test_slots_tell_the_article_from_menus_and_adverts(spark):
    """Nothing here has a telling name, and everything varies from page to page."""

    def page(i):
        menu = "".join(f"<li><a href=/{i}{j}>Section {i * j} of the site</a></li>" for j in range(30))
        story = "".join(f"<p>Sentence {j} of story {i} is about <a href=/x>this</a>.</p>" for j in range(5 + i % 3))
        return (
            f"<body><div class=q1><ul>{menu}</ul></div><div class=q2>Buy thing {i}</div><div class=q8><div class=q3><h1>Title {i}</h1>"
            f"<div class=q4>{story}</div><div class=q6><a href=/t>Tag {i}</a></div></div></div><div class=q5>Host {i}</div></body>"
        )

    got = _extracted(spark, [(i, "http://a.example/", page(i)) for i in range(9)])
    for i in range(9):
        story = [f"Sentence {j} of story {i} is about this." for j in range(5 + i % 3)]
        assert got[i] == "\n\n".join([f"Title {i}", *story])
    assert hx.main_text(page(1)) != got[1]  # without its host's template the page keeps its menu


def test_crossing_and_disordered_classes_are_no_template():
    def said(html, classes):
        nesting = hx._Nesting(classes, {1: (9, 2, 1), 2: (9, 2, 2)})
        nesting.read(html)
        return nesting

    keys = {x: hx._key(hx._below(hx._below(0, "body"), f"hr.{x}#"), "o") for x in "abcd"}
    classes = {keys["a"]: (1, 2, True), keys["b"]: (1, 2, True), keys["c"]: (2, 2, True), keys["d"]: (2, 2, True)}
    lines = lambda order: "<body>" + "".join(f"<hr class={x}>" for x in order)
    assert said(lines("acdb"), classes).bad == set() and said(lines("acdb"), classes).parent[2] == (1, 1)
    assert said(lines("abcd"), classes).bad == set() and said(lines("abcd"), classes).parent[2] == (0, 0)
    assert 1 in said(lines("acbd"), classes).bad  # the classes cross; the one of lower rank gives way
    assert said(lines("abab"), {k: v for k, v in classes.items() if v[0] == 1}).bad == set()  # a list of two
    assert said(lines("abba"), {k: v for k, v in classes.items() if v[0] == 1}).bad == {1}  # no fixed order


def test_an_article_that_most_pages_carry_is_an_article(spark):
    story = "".join(f"<p>Sentence {j} of the story that everyone carries.</p>" for j in range(6))
    rows = [(i, "http://a.example/", f"<body><div class=ad>Buy {i}</div><article>{story}</article><footer>{i}</footer></body>") for i in range(8)]
    rows.append((9, "http://a.example/", "<body><div class=ad>Buy</div><article><p>Something else.</p></article><footer>9</footer></body>"))
    got = _extracted(spark, rows)
    assert all(got[i].count("Sentence") == 6 and "Buy" not in got[i] for i in range(8)) and got[9] == "Something else."


def test_deep_and_long_pages():
    deep = "<div class=a>" * 20_000 + "text" + "</div>" * 20_000
    assert hx.main_text(deep) == "text"
    keys = hx.token_counts("<div>" * 300 + "<hr>" * 5 + "</div>" + "<hr>")
    assert sorted(keys.values())[-1] == 5 and list(keys.values()).count(1) == 302  # deep elements are not confused
    assert hx.main_text("<b>" * 20_000 + "<p>x" * 20_000).count("x") == 20_000


def test_without_names_of_elements_the_given_pages_give_the_same_articles(spark):
    """The template decides: with elements renamed to mere `div`s, extraction finds what `<article>` held."""

    def renamed(html):
        for a, b in (("article", "k1"), ("nav", "k2"), ("footer", "k3")):
            html = html.replace(f"<{a}>", f'<div class="{b}">').replace(f"</{a}>", "</div>")
        return html.replace('<div class="ad">', '<div class="k4">')

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()
    hosts = {}
    for r in pages:
        hosts.setdefault(r["url"].split("/")[2].lower(), []).append(r)
    rows = [r for found in hosts.values() if len(found) >= 8 for r in found]
    assert len(rows) > 80
    got = _extracted(spark, [(r["page_id"], r["url"], renamed(r["html"])) for r in rows])
    assert all(got[r["page_id"]] == _article(r["html"]) for r in rows)
    assert sum(hx.main_text(renamed(r["html"])) == got[r["page_id"]] for r in rows) == 0


def _article(page):
    import html
    import re

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
    blocks = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]+>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_query_whole_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == _article(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])
