import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators import html as H


def text(page, url="https://e.org/a/b?q=1#f"):
    p = H.parse_page(page, url)
    if p["fallback"]:
        return "\n".join(p["lines"])
    out = [x for i, x in enumerate(p["lines"]) if i == 0 or x != p["lines"][i - 1]]
    return "\n\n".join(out)


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<body><nav>n</nav><p>a</p><footer>f</footer></body>", "a"),
        ("<body><div class='top-ad x'>ad</div><p>a</p></body>", "a"),
        ("<body><div class='top_ad'>kept</div></body>", "kept"),
        ("<body><div class='banners'>kept</div></body>", "kept"),
        ("<body><div id='Sidebar'>gone</div>a</body>", "a"),
        ("<html><title>t</title><body class='no-sidebar'><p>gone</p></body></html>", "t"),
        ("<body><article></article><p>outside</p></body>", ""),
        ("<body><main>m</main><article>a</article></body>", "a"),
        ("<body><div class='my-posts'>p</div><main>m</main></body>", "m"),
        ("<body><div class='my-posts'>p</div>rest</body>", "p"),
        ("<body><div id='entry1'>p</div>rest</body>", "p"),
        ("<article><p>a<p>a<p>b</article>", "a\n\nb"),
        ("<article>one\n two \n\nthree</article>", "one\n\ntwo\n\nthree"),
        ("<article>x <script>s</script><template>t</template><!-- c -->y &amp; &copy; z</article>", "x\n\ny & © z"),
        ("no markup\n at all", "no markup\n at all"),
        ("<article>a</b></i> c</article>", "a c"),
        ("<article><div>a<span>b</div>c</article>d", "a\n\nb\n\nc"),
        ("<article>cut <b>off", "cut\n\noff"),
        ("<article><br/>a<img src=x>b</article>", "a\n\nb"),
        ("<article><form>gone<p>too</form>a</article>", "a"),
    ],
)
def test_clean_text(page, expected):
    assert text(page) == expected


def test_null_and_empty_pages():
    assert H.parse_page(None, "u") is None and H.parse_page("", "u") is None


def test_links_before_and_after_removal():
    p = H.parse_page("<base href='https://other.org/'><nav><a href='/n'>n</a></nav><a href=''>e</a><a href='#top'>t</a><a>none</a><a href=' x '>x</a><a href='mailto:a@b'>m</a>", "https://e.org/a/b?q=1#f")
    assert p["links_all"] == sorted({"https://e.org/n", "https://e.org/a/b?q=1#f", "https://e.org/a/b?q=1#top", "https://e.org/a/x ", "mailto:a@b"})
    assert set(p["links_all"]) - set(p["links_kept"]) == {"https://e.org/n"}


def test_title_with_children_and_entities():
    assert H.parse_page("<title>a &amp; b</title>", "u")["title"] == "a & b"
    assert H.parse_page("<title></title>", "u")["title"] is None
    assert H.parse_page("<p>x</p>", "u")["title"] is None


def test_rendered_and_pooled_profiles():
    p = H.parse_page("<body><div class='ad'>ad</div><div class='my-content'>no</div><div class='content x'>yes</div><form>f</form></body>", "u")
    assert p["rendered_lines"] == ["yes"]
    assert p["pooled_lines"] == ["ad", "no", "yes", "f"]


def test_order_of_extractors(spark):
    page = "<title>T</title><nav><a href='/n'>n</a></nav><script type='application/ld+json'>{\"a\":1}</script><article>text<a href='/t'>t</a></article>"
    df = spark.createDataFrame([("https://e.org/", page), ("https://e.org/none", None)], "url string, html string")
    one = {r.url: r for r in H.scrape(df, ("links", "structured", "clean_text", "full_html")).selectExpr("url", "content", "links", "size(structured_data.json_ld) n", "title").collect()}
    two = {r.url: r for r in H.scrape(df, ("full_html", "clean_text", "links", "structured")).selectExpr("url", "content", "links", "size(structured_data.json_ld) n", "title").collect()}
    a, b = one["https://e.org/"], two["https://e.org/"]
    assert (a.links, a.n, a.content) == (["https://e.org/n", "https://e.org/t"], 1, page)
    assert (b.links, b.n, b.content) == (["https://e.org/t"], 0, "text\n\nt")
    assert one["https://e.org/none"].content is None and one["https://e.org/none"].links is None


def test_metadata_last_wins(spark):
    page = '<meta name=Author content=a><meta name="author" content="b"><meta name="candidate" content="d"><meta property="OG:Title" content="o1"><meta property="og:title" content="o2"><meta name="twitter:card" content="c"><meta>'
    df = H.parsed(spark.createDataFrame([("u", page)], "url string, html string"), "title", "metas")
    m = df.select(H.metadata().alias("m")).first().m
    assert (m.author, m.published_date, m.og_data, m.twitter_data, m.description) == ("b", "d", {"og:title": "o2"}, {"twitter:card": "c"}, None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<article>", "</article>", "<nav>", "</nav>", "a", " b ", "<!-- c", "-->", "<br>", "<a href=/x>", "</a>", "&amp", "<script>", "</script>", "<", "<![CDATA[x]]>", "<!x", "<?y>"]), max_size=30))
def test_any_markup_parses_and_removal_is_monotone(parts):
    p = H.parse_page("".join(parts) or "x", "https://e.org/")
    assert set(p["links_kept"]) <= set(p["links_all"])
    assert p == H.parse_page("".join(parts) or "x", "https://e.org/")
