"""Queries against their SQL over pages of one url and over references without a semicolon."""

import duckdb
import pytest

from conftest import same
from pagemill.operators.html import parse_page
from pagemill.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """(folder, DuckDB) with pages 0 to 27 of sf0.001 and others of their urls; of the others, every third has a title
    cut within a reference, and one is 497 letters and such a cut."""
    path = str(tmp_path_factory.mktemp("odd"))
    p = duckdb.sql(f"SELECT * FROM '{sf}/pages.parquet' WHERE page_id < 28 ORDER BY page_id").fetchall()
    rows = list(p)
    for i, url, _ in p:
        title = f"T{i} &amp; more &amp" if i % 3 == 0 else f"T{i}"
        text = "x" * 497 + "&amp" if i == 4 else f"{title} &quot"
        rows.append((100 + 7 * i, url, f'<html><head><title>{title}</title></head><body><nav><a href="/n{i % 5}">n</a><a href="/of/{i}">o</a></nav><article><h1>{title}</h1><p>{text}</p></article></body></html>'))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return path, c


NAMES = ["added_urls", "extract_urls", "first_write_wins", "format_pages", "html_metadata_cases", "mark_scraped", "line_tools", "page_clean_text", "page_other_profiles", "page_status", "page_status_summary", "page_titles", "quick_add", "replies_in_order"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_pages_are_as_sql_has_them(spark, odd, name):
    path, c = odd
    same(QUERIES[name](spark, path), c, ORACLE[name])


@pytest.fixture(scope="module")
def references(spark, tmp_path_factory):
    """(folder, DuckDB) with pages of references that SQL does not read, of no title, of null and of empty html."""
    path = str(tmp_path_factory.mktemp("references"))
    texts = ["A &lt;b&gt; c", "it&#39;s", "x &ampquot; y", "&COPY; &notit; &eacute;&quot;", "&#x26;quot;", "&amp;lt; &&amp; A&B;C", "x" * 494 + "&nbsp;y"]
    page = lambda x: f"<html><head><title>{x}</title></head><body><article><h1>{x}</h1><p>{x} more</p><p>{x}</p></article></body></html>"
    rows = [(i, f"https://e{i}.org/", page(x)) for i, x in enumerate(texts)]
    rows += [(90, "https://e90.org/", "<html><body><article><p>no title</p></article></body></html>"), (91, "https://e91.org/", None), (92, "https://e92.org/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet' ORDER BY page_id")
    return path, c


REFERENCES = ["page_clean_text", "page_other_profiles", "page_titles", "page_status_summary", "html_metadata_cases", "page_status"]


@pytest.mark.parametrize("name", REFERENCES)
def test_references_are_read_as_sql_has_them(spark, references, name):
    path, c = references
    same(QUERIES[name](spark, path), c, ORACLE[name])


@pytest.fixture(scope="module")
def marks(spark, tmp_path_factory):
    """(folder, DuckDB) with pages whose marks and white space a parser reads otherwise than SQL's patterns."""
    path = str(tmp_path_factory.mktemp("marks"))
    page = lambda title, article, before="": f"<html><head><title>{title}</title></head><body>{before}<article>{article}</article></body></html>"
    x = "x" * 495
    htmls = [
        page("T", "<p>one\ntwo</p><p>\n</p>"), page("T", "<p> one </p><p>　</p><p>\x0b</p>"), page("T", f"<p>{x}</p><p>a</b>b</p>"), page("T", "<nav>n</nav><script>s</script><template>t</template><div class='ad'>d</div>"),
        page("T", "a < b <p>c</p> d < e"), page("T", "<!-- a > b -->c<![CDATA[d]]>"), page("T", "<p>x</p>", "<nav>").replace("<article>", '<article class="a">'), page("T", "<p>x</p>", "<nav>"), page("T", "<p>x</p>").replace("</article>", ""),
        page("T", "<article>one</article>two"), page("Just a <b>moment</b>...", x + "12345"), page("Access denied", x + "12345").replace("title>", "TITLE>"), page("ACCESS DENİED", x + "12345"), page("T", "CHECKİNG your browser"),
        "<html><body>no article</body></html>", "plain text", "", None,
    ]
    rows = [(i, f"https://e{i}.org/", h) for i, h in enumerate(htmls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet' ORDER BY page_id")
    return path, c


@pytest.mark.parametrize("name", ["page_status", "page_status_summary"])
def test_marks_are_read_as_sql_has_them(spark, marks, name):
    path, c = marks
    same(QUERIES[name](spark, path), c, ORACLE[name])


def test_texts_are_as_they_stand():
    p = parse_page("<nav>n</nav><article> a\nb <p> c</p><script>s</script></article>", "u")
    assert p["texts"] == [" a\nb ", " c"] and p["lines"] == ["a", "b", "c"]
    assert parse_page("<i> x </i>", "u", frozenset({"texts"})) == {"texts": [" x "]}
