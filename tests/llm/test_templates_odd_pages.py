"""Site templates: broken and deep pages, names that mislead, and what counting alone decides."""

from __future__ import annotations

import time

import pytest

from outways.llm import site_templates


@pytest.mark.parametrize("page", ["<div>" * 5000 + "deep", '<a "' * 250_000, "<a x" * 250_000, "<a x='" * 170_000, "</p" * 300_000, "<b>" * 50_000 + "</i>" * 100_000, "<div>" * 5000 + "</p>" * 100_000])
def test_deep_and_broken_pages_take_little_time(page):
    began = time.time()
    site_templates.main_text(page)
    assert time.time() - began < 5
    assert site_templates.main_text("<div>" * 5000 + "deep") == "deep"


def test_names_that_are_no_boilerplate():
    text = site_templates.main_text
    assert text('<p title="the hidden gem">keep me</p><p class="overflow hidden x">and me</p><p hidden>not me</p>') == "keep me\n\nand me"
    assert text('<article><h1 class="entry-header">T</h1><p>a <math>x</math> <label>l</label></p><div id="search">s</div><dialog>d</dialog></article>') == "T\n\na x l\n\ns\n\nd"
    assert text('<article><p>post</p><ol><li><article class="comment">first!</article></li></ol></article>') == "post"
    assert text('<article class="post has-comments"><p>post</p></article><article class="comment">first!</article>') == "post"


def test_shapes_that_recur_outside_the_article_go(spark):
    page = "<div id='top'><ul>{links}</ul></div><article><p>own {i}</p><p>more {i}</p></article><div class='x'>Words of the day {i}</div>"
    links = lambda i: "".join(f"<li><a href='/{i}/{k}'>link {i * k}</a></li>" for k in range(2 + i % 3))
    rows = [(i, f"http://h.org/{i}", page.format(links=links(i), i=i)) for i in range(9)]
    # Pages without an article: blocks of links go, equal shapes of text stay.
    rows += [(100 + i, f"http://g.org/{i}", f"<div><ul>{links(i)}</ul></div><div class='t'><p>only {i}</p></div>") for i in range(9)]
    # Too few pages of a host for counting, no telling name either.
    rows += [(200 + i, "http://few.org/", f"<p>only {i}</p><ul>{links(i)}</ul>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for broadcast in (1_000, 0):
        got = {r["page_id"]: r for r in site_templates.extracted(frame, broadcast=broadcast).collect()}
        assert got[3]["text"] == "own 3\n\nmore 3" and got[3]["templates_removed"] == 2
        assert got[103]["text"] == "only 3" and got[103]["templates_removed"] == 1
        assert got[201]["text"].startswith("only 1\n\nlink")


def test_counts_alone_find_the_article():
    pages = [site_templates.Page(f"<nav><ul><li><a href='/{i}'>m{i}</a></li></ul></nav><div class='ad'>buy {i}</div><article><p>text {i}</p></article><footer>foot {i}</footer>") for i in range(6)]
    seen: dict = {}
    for page in pages:
        for _, h, around in site_templates.subtree_hashes(page):
            seen.setdefault(h, set()).add(around)
    for i, page in enumerate(pages):
        dead = {e for e, h, _ in site_templates.subtree_hashes(page) if len(seen[h]) >= site_templates.LEAST_PAGES}
        assert site_templates.blocks(page, dead.__contains__, by_name=False) == [f"text {i}"]


def test_pages_of_one_id_keep_their_own_deletions(spark):
    rows = [(7, f"http://h.org/{i}", f"<div><a href='/'>home</a></div><p>own {i}</p>") for i in range(6)] + [(7, "http://h.org/x", "<p>x</p><div><a href='/'>homely</a></div>")]
    got = sorted(r["text"] for r in site_templates.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast=0).collect())
    assert got == [*[f"own {i}" for i in range(6)], "x"]


def _texts(spark, pages):
    rows = spark.createDataFrame([(i, f"https://host.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_templates.extracted(rows).collect()}


def test_a_long_text_beside_a_short_article_stays(spark):
    body = lambda i: f"<html><body><nav><a href=/>home</a></nav><div class='post-body'><p>{' '.join(f'word{i}x{k}' for k in range(60))}</p></div><article class='card'><p>teaser {i}</p></article></body></html>"
    for pages in (4, 6, 9):
        got = _texts(spark, [body(i) for i in range(pages)])
        assert all(f"word{i}x59" in got[i] for i in range(pages)) and not any("home" in t for t in got.values())


def test_boxes_of_changing_words_beside_a_long_article_go(spark):
    page = lambda i: f"<html><body><div class='hint'><p>tip {i} of the day {i * 7}</p></div><article><p>{' '.join(f'w{i}n{k}' for k in range(40))}</p></article></body></html>"
    got = _texts(spark, [page(i) for i in range(7)])
    assert all("tip" not in t and f"w{i}n39" in t for i, t in got.items())


def test_sections_of_an_article_stay_whatever_their_name(spark):
    parts = "<section id='discussion'><h2>Discussion</h2><p>long words</p></section><div class='related-work'><p>earlier work</p></div><p class='notice'>take care</p><div class='social-history'><p>of a town</p></div>"
    gone = "<div class='comments'><p>nice</p></div><div class='related'><a href=/x>more</a></div><div class='newsletter'>join</div>"
    (text,) = _texts(spark, [f"<html><body><article data-u=/x/><p>start</p>{parts}{gone}</article></body></html>"]).values()
    assert text == "start\n\nDiscussion\n\nlong words\n\nearlier work\n\ntake care\n\nof a town"


def test_only_a_slash_of_its_own_closes_a_tag():
    page = site_templates.Page("<div data-u=/x/>in</div><div data-u='/x/'/>out<br/>")
    opened = [page.tags[w] for k, w in page.events if k == site_templates.OPEN]
    assert opened == ["#root", "div", "div", "br"] and page.events[2:4] == [(site_templates.TEXT, "in"), (site_templates.CLOSE, 1)] and page.events[5] == (site_templates.CLOSE, 2)
