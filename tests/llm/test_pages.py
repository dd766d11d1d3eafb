"""Roles on any element, copies, teasers and line differencing of pages."""

import random
from functools import cache

import pytest

from emberline.llm import pagetext


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    ranges = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        return {r.page_id: r.text for r in pagetext.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>one</p><p class='advert'>buy</p><p>two</p></article>", ["one", "two"]),
    ("<article><p>one<p class=advert>buy<p>two</article>", ["one", "two"]),
    ("<article><ul><li>one<li class='ad'>buy<li>two</ul></article>", ["one", "two"]),
    ("<article><p>one <span class='sponsored'>buy <span>this</span> now</span> two</p></article>", ["one two"]),
    ("<article><p>one <a class='share' href='/x'>tell</a> two</p><p>three</article>", ["one two", "three"]),
    ("<article><p>one <span class='ad'>left open</p><p>two</p></article>", ["one", "two"]),
    ("<article><pre class='ad'>buy</pre><p>one</p><hr class='ad'><p>two</p><img class='ad'><p>three</p></article>", ["one", "two", "three"]),
    ("<article><h2 id='related'>Related work</h2><p class='share-price'>up</p><p data-id='ad'>kept</p></article>", ["Related work", "up", "kept"]),
    ("<article><p hidden>gone</p><p>one</p><p class='ad'>buy<div>two</div></article>", ["one", "two"]),
    ("<article><p>one</p></span></li><p>two</article>", ["one", "two"]),
])
def test_roles_on_any_element(page, want):
    assert [line for _, line in pagetext.lines(page)] == want


def test_copies_keep_their_text_and_lose_the_template(spark):
    page = "<body><div>Site head</div><p>{}</p><div>Site foot</div></body>"
    rows = [(k, f"http://h/a/{k}", page.format("the same story")) for k in range(5)] + [(9, "http://h/b", page.format("another one"))]
    got = texts(spark, rows)
    assert {got[k] for k in range(5)} == {"the same story"} and got[9] == "another one"
    alone = texts(spark, rows[:5])
    assert set(alone.values()) == {"Site head\n\nthe same story\n\nSite foot"}


def test_a_teaser_is_not_the_whole_page(spark):
    page = "<body><div>Head</div><article>Read {0} next</article><div>A long story number {0} that fills the page.</div><div>Foot</div></body>"
    got = texts(spark, [(k, f"http://h/{k}", page.format(k)) for k in range(3)])
    assert got == {k: f"Read {k} next\n\nA long story number {k} that fills the page." for k in range(3)}


def test_very_long_pages_null_ids_and_ties(spark):
    long = "<div>head</div>" + "".join(f"<p>line {k} of a long page</p>" for k in range(50_000))
    got = texts(spark, [(None, "http://h/a", "<div>head</div><p>x</p>"), (2, "http://h/a", long), (2, "http://h/a", long), (3, None, None)])
    assert got[None] == "x" and got[3] == ""
    assert got[2].startswith("line 0 of") and got[2].count("\n\n") == 49_999


def test_common_lines_against_a_plain_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))

        @cache
        def length(i, j):
            if i == len(a) or j == len(b):
                return 0
            return 1 + length(i + 1, j + 1) if a[i] == b[j] else max(length(i + 1, j), length(i, j + 1))

        at = sorted(pagetext.common(a, b))
        assert len(at) == length(0, 0)
        rest = iter(b)
        assert all(a[i] in rest for i in at)
