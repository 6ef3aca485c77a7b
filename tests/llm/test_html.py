"""Extraction from malformed pages, in linear time, and its regions against brute force."""

import html
import math
import random
import re
import time

import pytest

from curatrix.llm import html_text

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><![foo[x]]>tail", "a\ntail"), ("<p>x</p><![ <p>y</p>", "x\ny"), ("a<![CDATA[b]]>c", "ac"), ("a<![if !IE]>b<![endif]>c", "abc"), ("<!DOCTYPE [<!x[>a", "a"), ("a<!>b", "ab"),
        ("a<!-- b", "a b"), ("a<!-->b", "ab"), ("a<!-- b --!>c", "ac"), ("a<?php b ?>c", "ac"), ("a</>b</ >c", "abc"), ("a<b c='d", "a"), ("a<b c='d>e", "ae"), ("a<b c=\"d>e\">f", "af"), ("a<b/c/>d", "ad"),
        ("a < b <3", "a < b <3"), ("a<", "a<"), ("&#99999999999999;x", "�x"), ("&#" + "9" * 9000 + ";x", "�x"), ("&#" + "0" * 9000 + "65;x", "Ax"), ("&#x" + "F" * 9000 + ";x", "�x"), ("&bogus; &amp &#65", "&bogus; & A"),
        ("<p>a<script>b", "a"), ("<p>a<script>b</script >c", "ac"), ("<p>a<style>b</ style>c", "ac"), ("<a =b='c'>d", "d"), ("<a b==c>d", "d"), ("\x00<p>\x00", "\x00\n\x00"),
    ],
)
def test_malformed(page, text):
    assert html_text.main_text(page) == text


def test_any_markup_gives_text():
    rng = random.Random(5)
    marks = ["<", ">", "<!--", "-->", "<![", "]]>", "<!", "</", "/>", "<a ", "<p>", "</p>", "=", "'", '"', "&", "&#", ";", "x", " ", "<script>", "</script>", "<?", "class=ad", "<article>", "<nav>", "\n", "9"]
    for _ in range(3000):
        assert isinstance(html_text.main_text("".join(rng.choices(marks, k=rng.randint(1, 40)))), str)


@pytest.mark.parametrize("mark", ["<!--", "<a b='", "<a b='>' ", "<a b=c ", "</a", "<?x ", "<!x ", "<![x", "<", "&", "<a " + "=" * 50, "<!---- ", "<div>", "<p><b>", "&#9", "<a b=\"'>"])
def test_linear(mark):
    begun = time.process_time()
    assert html_text.main_text("<p>before</p>" + mark * 50_000 + "<p>after</p>").startswith("before")
    assert time.process_time() - begun < 5


def _pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").where("html is not null").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)
        if inner:
            blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner[1]))
            yield r.html, "\n".join(x for x in blocks if x)


def test_clusters_find_the_article_without_names_or_tags(spark, monkeypatch):
    found = list(_pages(spark))
    for page, text in found:  # without its tag
        assert html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == text
    monkeypatch.setattr(html_text, "NAMED", re.compile(r"(?!)"))
    monkeypatch.setattr(html_text, "MOST", 2.0)  # nor does an article stay for its size
    lost = [text for page, text in found if text not in html_text.main_text(page)]
    assert all(len(t) < 60 for t in lost) and len(lost) <= 0.01 * len(found)  # of a word or two, next to a longer advert


def brute_regions(lines, shown, marked, whole):
    def density(i):
        text, tags, region = lines[i]
        mates = [k for k in range(len(lines)) if lines[k][2] == region]
        near = [(math.exp(-((mates.index(k) - mates.index(i)) ** 2) / 2), math.log1p(len(lines[k][0]) / max(1, lines[k][1]))) for k in mates if abs(mates.index(k) - mates.index(i)) <= 3]
        return sum(w * v for w, v in near) / sum(w for w, _ in near)

    values = [density(i) for i in range(len(lines))]
    spread = lambda xs: sum((x - sum(xs) / len(xs)) ** 2 for x in xs)
    cuts = sorted(set(values))[1:]
    within = {c: spread([v for v in values if v < c]) + spread([v for v in values if v >= c]) for c in cuts}
    cut = min(cuts, key=lambda c: within[c]) if cuts else values[0]
    out, best, total = set(), None, sum(len(x[0]) for x, use in zip(lines, shown, strict=True) if use)
    for r in {x[2] for x, use in zip(lines, shown, strict=True) if use}:
        mine = [i for i in range(len(lines)) if shown[i] and lines[i][2] == r]
        size, dense = sum(len(lines[i][0]) for i in mine), sum(len(lines[i][0]) for i in mine if values[i] + (math.log(1.5) if r in marked else 0) >= cut - 1e-12)
        if 2 * dense >= size or (r in whole and 2 * size > total):
            out.add(r)
        best = max(best or (-1, -1, 0), (dense, size, -r))
    return out or {-best[2]}


def test_regions_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        n = rng.randint(1, 25)
        lines = [("x" * int(rng.paretovariate(0.6)) if rng.random() < 0.9 else "x" * 300, rng.randint(0, 9), rng.randint(-1, 4)) for _ in range(n)]
        lines = [(t[:4000], k, r) for t, k, r in lines]
        shown = [r != html_text.OUT and rng.random() < 0.9 for _, _, r in lines]
        if any(shown):
            marked = {r for r in range(5) if rng.random() < 0.3}
            whole = {r for r in marked if r % 2}
            assert html_text.content_regions(lines, shown, marked, whole) == brute_regions(lines, shown, marked, whole)
