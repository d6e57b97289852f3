"""Page text against the standard library's parser and by hand."""

import time
from html.parser import HTMLParser

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graniteql import plans
from graniteql.functions import html

from .conftest import MIDDLE


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.inside = [], 0

    def handle_starttag(self, tag, attrs):
        self.inside += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.inside -= tag in ("script", "style") and self.inside > 0

    def handle_data(self, data):
        self.found.append("" if self.inside else data)


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(reader.found)


PIECES = ["text", " ", "\n", "&amp;", "&lt;b&gt;", "&#65;", "&#x42;", "&nbsp;", "&eacute;", "a &b; c", "<b>", "</b>", "<p class='a > b'>", '<a href="x>y" title=\'"\'>', "<br/>", "<img src=a/b>", "<input disabled >", "</P >", "<!-- c > <b> -->", "<!---->", "<!DOCTYPE html>", "<?php x ?>", "<script>if (a<b) '</p>'; <!-- </script>", "<STYLE type='a'>p > a {}</style>", "<style></style >", "é日", "< a", "1 < 2 <3", "<div\n id = x\n>"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_text_is_the_parsers(page):
    assert html.plain(page) == read(page)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("a<b", "a"),
        ('a<b c="d>e', "a"),
        ("a<!-- b", "a"),
        ("a<!--> b", "a b"),
        ("a<!---> b --!> c", "a b --!> c"),
        ("a<!-- b --!> c", "a c"),
        ("<script>a</scripts>b</SCRIPT\n>c", "c"),
        ("<script>a", ""),
        ("<title>a <b> &amp;</title>c", "a <b> &c"),
        ("<textarea><p></textarea>", "<p>"),
        ("a</>b</ c>d<>e", "abd<>e"),
        ("<a =b='>' c>d", "d"),
        ("<a b=c\"d>e\">f", "e\">f"),
        ("<a/b='>'/>c", "c"),
        ("&amp;lt; &ampx &unknown; &", "&lt; &x &unknown; &"),
        ("<![CDATA[x>y", "y"),
        ("<", "<"),
    ],
)
def test_odd_markup(page, want):
    assert html.plain(page) == want


def test_lines():
    page = "<html><head><title>T &amp; t</title><script>x</script></head><body><h1>One</h1>two <b>th</b>ree<br>four<ul><li> a\n b<li>c</ul></body>"
    assert html.lines(page) == "T & t\nOne\ntwo three\nfour\na b\nc"


def test_long_pages_take_time_in_proportion():
    began = time.process_time()
    for unit in ("<a b='", '<a b="', "<!--", "<", "</", "<a ", "<a b=", "&", "<script>", "<a /", "</script "):
        html.plain(unit * 200_000)
    assert time.process_time() - began < 60


def test_columns(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a</p>b")], "i int, page string")
    got = {r["i"]: (r["p"], r["l"]) for r in rows.select("i", html.plain_text(F.col("page")).alias("p"), html.text_lines(F.col("page")).alias("l")).collect()}
    assert got == {1: (None, None), 2: ("", ""), 3: ("ab", "a\nb")}


def test_query_decodes_what_its_statement_does(spark, tmp_path):
    """References without a semicolon, of other names and doubly written ones, at a tag, before a letter and at the end."""
    rows = [(i, f"<p title='&amp'>a{x}</p><b>{x}</b>{x}b {x}") for i, x in enumerate(["&amp", "&amp;", "&amp;amp;", "&amp;copy;", "&copy", "&copy;", "&quot", "&quot;", "&middot;", "&lt;", "&nbsp;", "&#38;", "&Amp;", "&", "&&amp;;"])] + [(99, None), (100, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = dict(duckdb.sql(plans.ORACLE["t6_html_text"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall())
    assert dict(map(tuple, plans.QUERIES["t6_html_text"](spark, str(tmp_path)).select("page_id", "plain").collect())) == want


def test_pages(spark):
    rows = spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()
    assert all(html.plain(r["html"]) == read(r["html"]) for r in rows)
