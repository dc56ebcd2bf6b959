"""Text and declared language of broken markup, against plain patterns and in time."""

import re
import time
from html import unescape

import pytest
from hypothesis import given
from hypothesis import strategies as st

from eligo.llm.language import declared_language, page_text

DROP = re.compile(r"(?is)<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->")
TAG = re.compile(r"(?s)<[^>]*>")
DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""")
PIECES = ["<script>", "</script>", "<script", "<!--", "-->", "<", ">", "a", "<nav>", "</nav >", "<html lang=de>", "<html ", "lang='fr'", "&amp;", " ", "<template>", "</style>", "<STYLE>"]


@given(st.lists(st.sampled_from(PIECES), max_size=16))
def test_same_as_the_plain_patterns(pieces):
    html = "".join(pieces)
    assert page_text(html) == unescape(TAG.sub(" ", DROP.sub(" ", html)))
    m = DECLARED.search(html)
    assert declared_language(html) == (m[1] if m else None)


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<", "<html ", "</script", "<html lang>"])
def test_ten_megabytes_of_one_mark(piece):
    html, began = piece * (10_000_000 // len(piece)), time.time()
    page_text(html)
    declared_language(html)
    assert time.time() - began < 20


def test_no_page():
    assert page_text(None) == page_text("") == "" and declared_language(None) is None
