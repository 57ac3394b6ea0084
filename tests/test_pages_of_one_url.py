"""Queries against their SQL over urls with many pages, of which some are null, empty or odd."""

import duckdb
import pytest

from conftest import same
from pagemill.operators import html, research
from pagemill.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def many(spark, sf, tmp_path_factory):
    """(folder, DuckDB) with pages 0 to 27 of sf0.001, others of their urls under larger ids, and some again."""
    path = str(tmp_path_factory.mktemp("many"))
    p = duckdb.sql(f"SELECT * FROM '{sf}/pages.parquet' WHERE page_id < 28 ORDER BY page_id").fetchall()
    page = lambda i, title, article: f'<html><head><title>{title}</title></head><body><nav><a href="/n{i % 5}">n</a><a href="/of/{i}">o</a></nav><article>{article}</article></body></html>'
    x = "word " * 110
    odd = [
        lambda i: page(i, f"T{i} &amp", f"<p>{x}</p>&quot"), lambda i: None, lambda i: "", lambda i: page(i, "  T\t", "<p>one\ntwo\n\nthree　</p><p> </p>"), lambda i: page(i, "Just a moment...", "<p>verify you are human</p>"),
        lambda i: f"<html><title>T{i}</title><body>no links<article></article></body></html>", lambda i: f'<html><body><a href="/q{i % 3}">no article</a></body></html>', lambda i: p[(i + 5) % 28][2],
    ]
    rows = p + [(100 + 7 * i, url, odd[i % 8](i)) for i, url, _ in p] + [(1003 + i, url, h) for i, url, h in p if i % 9 == 4]
    # u links x behind v, though u's first page stands before v
    rows += [(2001, "https://many.example/u", page(1, "U", "u")), (2002, "https://many.example/v", page(2, "V", '<a href="/x">x</a>')), (2003, "https://many.example/u", page(3, "U", '<a href="/x">x</a>'))]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet/*.parquet'")
    return path, c


NAMES = [
    "compare_methods", "discover_by_status", "discover_first_seen", "discover_on_a_stream", "discovery_counters", "research_as_of", "research_failures", "research_metrics", "research_sources", "retrieve_twice_captured", "search_and_scrape", "search_url_index", "stored_registry", "to_dict_cases",
]


@pytest.mark.parametrize("name", NAMES)
def test_many_pages_of_an_url_are_as_sql_has_them(spark, many, name):
    path, c = many
    same(QUERIES[name](spark, path), c, ORACLE[name])


def test_texts_in_one_piece(spark):
    df = spark.createDataFrame([("u", "<title>T</title><article> a\nb <p>\t</p><p>a\nb</p></article>")], "url string, html string")
    assert [r.content for r in html.scrape(df, text=lambda t: html.F.array_join(t, "|")).collect()] == ["a\nb|a\nb"]
    assert [r.content for r in html.scrape(df).collect()] == ["a\n\nb\n\na\n\nb"]
    assert research.retrieve(df, text=lambda t: html.F.array_join(t, "|")).first().signals.content_length == 7
