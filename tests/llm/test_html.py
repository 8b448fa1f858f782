"""Operator 8: comments and adverts inside an article, hosts with long templates, groups of pages."""

import pytest

from lumaflow.llm import html_extract


def run(spark, pages):
    df = spark.createDataFrame([(k, u, h, "n") for k, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}


PROSE = "A sentence of the article number {k} which says something of its own and goes on for a while so that it is long enough. " * 3


@pytest.mark.parametrize("kind", ["comment-list", "user-comment", "ad-slot", "adSlot", "post_comments", "x ads-300", "Comments", "newsletter-box"])
@pytest.mark.parametrize("pages", [1, 8])
def test_comments_and_adverts_go(spark, kind, pages):
    made = [(f"http://a.example/{k}", f"<html><body><article><h1>Title {k}</h1><p>{PROSE.format(k=k)}</p><div class=\"{kind}\"><div><b>someone {k}</b><p>I say {k * 7} things to this.</p></div></div><p>End {k}.</p></article></body></html>") for k in range(pages)]
    got = run(spark, made)
    for k in range(pages):
        assert got[k] == f"Title {k} {' '.join(PROSE.format(k=k).split())} End {k}."


@pytest.mark.parametrize("kind", ["download", "roadmap", "commentary", "adventure", "heading", "navy-blue", "article-body"])
def test_words_that_only_begin_alike_stay(spark, kind):
    got = run(spark, [("http://a.example/1", f"<body><article><p>First words.</p><div class='{kind}'>Second words.</div></article></body>")])
    assert got[0] == "First words. Second words."


def test_a_long_template_meets_each_group_once(spark, monkeypatch):
    """A host with thousands of template texts, in groups of any size: the same texts."""
    fixed = "".join(f"<li>fixed entry {k}</li>" for k in range(3000))
    pages = [("http://b.example/" + str(k), f"<html><body><div class='frame'><div class='left'><ul>{fixed}</ul></div><div class='main-part'><p>{PROSE.format(k=k)}</p></div></div></body></html>") for k in range(12)]
    pages += [(None, "<p>alone</p>"), ("http://c.example", None), ("http://c.example", "")]
    whole = run(spark, pages)
    monkeypatch.setattr(html_extract, "GROUP", 2)
    assert run(spark, pages) == whole
    assert whole[12] == "alone" and whole[13] == "" == whole[14] and len(whole) == 15


def test_no_pages(spark):
    assert run(spark, [("http://a", "<p>x</p>")][:0] or [("http://a", None)]) == {0: ""}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
