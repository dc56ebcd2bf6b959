"""Rows of pages and feeds: many rows, broken markup, repeated tags."""

import time

import pytest
from pyspark.sql import functions as F

from eligo.operators import collect
from eligo.operators.html_rows import rows_of


def test_every_row_of_a_long_list():
    page = "<ul>" + "".join(f"<li><a href='/n/{i}'>Title number {i}</a><span>2024-05-{i % 28 + 1:02d}</span></li>" for i in range(30_000)) + "</ul>"
    rows = rows_of(page)
    assert len(rows) == 30_000 and rows[-1] == ("Title number 29999", "/n/29999", "2024-05-12")


def test_texts_of_nested_rows():
    page = "<table><tr><td><a href=1>short</a> <a href=2>a longer <b>title</b></a></td><td>2024.1.2</td></tr><tr><td><a href=3>x</a></td></tr><tr><td><a href=4>Fourth</a><script>2024.9.9</script></td></tr></table>"
    assert rows_of(page) == [("a longer title", "2", "2024.1.2"), ("Fourth", "4", "")]
    assert rows_of(None) == rows_of("") == rows_of("<p>nothing</p>") == []


@pytest.mark.parametrize("piece", ["<div>x<a href=1>abcd</a>", "<!--", "<script>", "<", "<a href", "</b>", "<b></i>", "<![CDATA[", "<li><a href=1>"])
@pytest.mark.parametrize("tail", ["", ">"])
def test_broken_pages_take_no_longer_than_their_length(piece, tail):
    began = time.time()
    rows_of(piece * (400_000 // len(piece)) + tail)
    assert time.time() - began < 10


def test_items_of_feeds(spark):
    body = (
        "<rss><item><category>a</category><category>b</category><dc:date>2024</dc:date><link/><title><![CDATA[x & <y>]]></title></item>"
        "<item id='2'><title>one &amp; two</title><open>never closed</item><items>no</items><item>cut off"
    )
    rows = spark.createDataFrame([(body,), (None,), ("",), ("<item>",)], "b string").select(collect.xml_rows(F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [[{"category": "a", "dc:date": "2024", "title": "x & <y>"}, {"title": "one & two"}], None, [], []]
