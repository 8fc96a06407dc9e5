from corpuslens.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">We use</div>
<main><article><header><h1>Title &amp; more</h1></header><p>One <b>two<br>three</b>&nbsp; end<p>Four<form><p>in form</p></form>
five<ul><li>a<li>b</ul><div class="comments"><article><p>Nice!</p></article></div><p hidden>hid</p><p style="display: none">hid</p>
<aside>side</aside><!-- <p>gone</p> --><pre>x
 y</pre><span class="ad">buy</span></article><section id="related">rel</section></main><footer>&copy; x</footer></body></html>"""


def texts(page):
    return [text for text, _, _ in html.blocks(page)]


def test_only_the_article():
    assert texts(PAGE) == ["Title & more", "One two three end", "Four", "five", "a", "b", "x y"]


def test_broken_markup():
    assert texts("<p>a < b &lt; c<p>d<!-- x --> e<div>f g</div>tail <b>on") == ["a < b < c", "d e", "f g", "tail on"]
    assert texts("<p><b>a.<br><p>b</p>") == ["a.", "b"]
    assert texts("<script>never closed <p>x") == [] and texts("<p title='open>x") == ["<p title='open>x"]
    assert texts("</div></p>x<div/>y") == ["x", "y"] and texts("") == []
    assert texts("<table><tr><td>1<td>2<tr><th>3</table>") == ["1", "2", "3"]


def test_deep_and_long_pages():
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert texts("<p>" + "w &amp; " * 50_000)[0].startswith("w & w")
    assert texts("<" * 20_000) == ["<" * 20_000]


def run(spark, rows):
    df = spark.createDataFrame([(*row, "x") for row in rows], "page_id long, url string, html string, text string")
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(df).collect()}


def test_recurring_subtrees_go_per_host(spark):
    """Unmarked pages: what all pages of a host share goes, on another host it stays."""
    rows = [(i, f"http://a.com/{i}", f"<div><div><a>Home</a> <a>News</a></div><div>Text {i}</div><div>Bye</div></div>") for i in range(8)]
    rows += [(100, "http://b.com/1", "<div><div><a>Home</a> <a>News</a></div><div>Other</div></div>")]
    out = run(spark, rows)
    assert out[(3, "http://a.com/3")] == ("Text 3", 6)
    assert out[(100, "http://b.com/1")] == ("Home News\nOther", 15)


def test_copies_of_a_page_are_no_template(spark):
    """Re-crawls of one page, marked or not, keep their text; what distinct pages share still goes."""
    for tag in ("article", "div"):
        page = f"<{tag}><p>One</p><p>Two</p></{tag}>"
        rows = [(i, f"http://a.com/{i}", page if i < 12 else f"<{tag}><p>{i}</p><p>Own {i}</p></{tag}>") for i in range(20)]
        out = run(spark, rows)
        assert {out[(i, f"http://a.com/{i}")][0] for i in range(12)} == {"One\nTwo"}
        assert out[(15, "http://a.com/15")][0] == "15\nOwn 15"
    rows = [(i, f"http://a.com/{i}", f"<article><p>Notice</p><p>{i % 12}</p></article>") for i in range(24)]
    assert {text for text, _ in run(spark, rows).values()} == {str(i) for i in range(12)}


def test_a_page_keeps_what_is_all_its_marked_content(spark):
    rows = [(i, f"http://a.com/{i}", f"<article><p>Closed</p><p>{i}</p></article>") for i in range(12)]
    out = run(spark, [*rows, (12, "http://a.com/12", "<article><p>Closed</p></article>")])
    assert out[(12, "http://a.com/12")][0] == "Closed" and out[(3, "http://a.com/3")][0] == "3"


def test_recurring_subtrees_go_at_a_low_share_of_a_large_host(spark):
    """An unmarked menu on a tenth of 1,000 pages goes, and so does a notice in two of five of 1,000 articles."""
    rows = [(i, "http://a.com/", ("<div><p>Section</p><p>Menu</p></div>" if i % 10 == 0 else "") + f"<p>{i}</p>") for i in range(1000)]
    rows += [(i, "http://b.com/", f"<article>{'<p>Notice</p>' if i % 5 < 2 else ''}<p>{i}</p><p>end</p></article>") for i in range(1000, 1900)]
    rows += [(i, "http://c.com/", f"<article>{'<p>Real</p>' if i % 8 == 0 else ''}<p>{i}</p></article>") for i in range(2000, 3000)]
    out = {key[0]: text for key, (text, _) in run(spark, rows).items()}
    assert out[10] == "10" and out[11] == "11"
    assert out[1000] == "1000" and out[1004] == "1004"
    assert out[2000] == "Real\n2000"


def test_main_stays_beside_small_articles(spark):
    cards = "<article><p>Card</p></article><article><p>Other</p></article>"
    rows = [(1, "http://a.com/1", f"<main><h1>Head</h1><p>The text of the page is here</p>{cards}</main>")]
    rows += [(2, "http://a.com/2", "<main><h1>Head</h1><article><p>The text of the page is here</p></article></main>")]
    out = run(spark, rows)
    assert out[(1, "http://a.com/1")][0] == "Head\nThe text of the page is here\nCard\nOther"
    assert out[(2, "http://a.com/2")][0] == "The text of the page is here"


def test_paragraphs_that_articles_share_stay(spark):
    rows = [(i, "http://a.com/", f"<article><p>Shared</p><p>{i}</p></article>" if i % 2 else f"<article><p>{i}</p></article>") for i in range(20)]
    out = run(spark, [(i, f"http://a.com/{i}", page) for i, _, page in rows])
    assert out[(1, "http://a.com/1")][0] == "Shared\n1"


def test_edge_rows(spark):
    out = run(spark, [(1, None, None), (2, "nohost", ""), (3, "http://x/", "a&#x41;b"), (None, "http://x/", "c")])
    assert out == {(1, None): ("", 0), (2, "nohost"): ("", 0), (3, "http://x/"): ("aAb", 3), (None, "http://x/"): ("c", 1)}
    assert run(spark, []) == {}
    twice = spark.createDataFrame([(1, "u", "<p>x")] * 2, "page_id long, url string, html string")
    assert [r.text for r in html.extract(twice).collect()] == ["x", "x"]


def test_query_finds_the_documents_of_the_pages(spark):
    """The given pages were made from documents: without its title, a page's text is one of them."""
    from corpuslens.llm.queries import op5_html

    path = "/root/testdata/sf0.01"
    known = {" ".join(r.text.split()) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = op5_html(spark, path).collect()
    assert len(rows) == 250
    for row in rows:
        assert " ".join(row.text.split("\n", 1)[1].split()) in known and row.n_chars == len(row.text)
