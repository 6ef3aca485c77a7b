"""Quality, mixing, decontamination, language, HTML, WARC and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import html_text, language, leaks, mixing, quality, registry, warc
from curatrix.llm.common import work_path
from tests.llm.conftest import sentence, texts
from tests.llm.test_dedup import SPACE, brute_sets

SF = "/root/testdata/sf0.001"


def water(sizes, cap=3):
    """Targets by reshaping the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > cap * sizes[s] or sizes[s] == 0]
        if not over:
            return full | {s: weight[s] * level for s in rest}
        full |= {s: cap * sizes[s] for s in over}


def test_mixing(docs):
    rows = mixing.mix_rates(docs).collect()
    sizes = {}
    for r in rows:
        assert r.mix_size == len(SPACE.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    goal = water(sizes)
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(goal[r.source])
        rate = goal[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.mix_copies <= min(3, int(rate) + 1)
    assert len(rows) == docs.count()
    assert sorted(map(str, mixing.mix_rates(docs.repartition(5)).select("doc_id", "mix_copies").collect())) == sorted(map(str, mixing.mix_rates(docs).select("doc_id", "mix_copies").collect()))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_no"] and out.count() == sum(r.mix_copies for r in rows)


def test_mixing_takes_near_its_target(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") < 3000, "big").when(F.col("id") < 5000, "mid").otherwise("small").alias("source"))
    got = mixing.mix_rates(rows).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in got)


def test_mixing_without_rows_or_words(docs, none):
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.where("text is null or text = ''")).count() == 0


def test_tiles():
    a = list(range(20))
    assert leaks.tile(a, a) == [(0, 0, 20)]
    assert sorted(leaks.tile(a, a[10:] + [99] + a[:10])) == [(0, 11, 10), (10, 0, 10)]
    assert leaks.tile(a, [99, 98] * 5) == [] and leaks.tile([], []) == [] and leaks.tile([1, 2], [1, 2]) == []
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in range(2))
        tiles = leaks.tile(x, y)
        assert all(x[i : i + k] == y[j : j + k] and k >= leaks.TILE for i, j, k in tiles)
        for side in (0, 1):
            marks = [p for t in tiles for p in range(t[side], t[side] + t[2])]
            assert len(marks) == len(set(marks))
        ux, uy = set(range(len(x))) - {p for i, _, k in tiles for p in range(i, i + k)}, set(range(len(y))) - {p for _, j, k in tiles for p in range(j, j + k)}
        runs = [(i, j) for i in range(len(x) - 2) for j in range(len(y) - 2) if x[i : i + 3] == y[j : j + 3] and {i, i + 1, i + 2} <= ux and {j, j + 1, j + 2} <= uy]
        assert not runs  # no tile is left out


def test_leaks(spark, none):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randint(12, 40))) for i in range(40)]
    rows, want = [], {}
    for d in range(120):
        item, text = items[d % 40]
        w = text.split()
        half = len(w) // 2
        leaked = [" ".join(w), " ".join(w[half:] + ["and"] + w[:half]).upper(), ", ".join(w)][d // 40]
        rows.append((d, sentence(rng, 80) + " " + leaked + " " + sentence(rng, 30)))
        want[d] = item
    rows += [(1000 + k, sentence(rng, 100) + " " + " ".join(items[k][1].split()[:6])) for k in range(10)] + [(2000, None), (2001, ""), (None, items[0][1])]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, leak_coverage double, b string")
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "a b"), (None, "c d e f g"), items[3]], "item_id long, text string")
    for size in (leaks.BLOCK_BYTES, 3000):  # one block of items, and several
        got = {r.doc_id: (r.leak_item, r.leak_coverage) for r in leaks.find_leaks(docs, bench, block_bytes=size).collect()}
        assert all(got[d][0] == item and got[d][1] >= leaks.COVERAGE for d, item in want.items())
        assert all(got[d][1] < leaks.COVERAGE for d in got if d is not None and d >= 1000)
        assert got[None] == (0, 1.0)
    assert leaks.decontaminate(docs, bench).count() == 12
    assert leaks.find_leaks(docs, bench.limit(0)).where("leak_item is not null").count() == 0
    assert leaks.find_leaks(none, bench).count() == 0


def test_language(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(-1, None, "en", "src0"), (-2, "", None, None), (-3, "12 34 !!", "de", "src1"), (-4, "", "xx", "new")], docs.schema)
    rows = language.identify_documents(docs.union(odd).withColumn("lid_keep", F.lit("old"))).collect()
    assert len(rows) == docs.count() + 4
    known = [r for r in rows if r.doc_id >= 0 and len(r.text) > 60]
    assert np.mean([r.lid_lang == r.lang for r in known]) > 0.97
    assert np.mean([r.lid_keep for r in known]) > 0.99
    assert not any(r.lid_keep for r in rows if r.doc_id < 0)
    assert language.identify_documents(none.select("doc_id", "text", "lang", "source")).count() == 0
    without = language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).select("lid_lang").distinct().collect()
    assert [r.lid_lang for r in without] == ["und"]


def test_language_of_rows_that_declare_none(spark):
    """A fifth of the rows lose their declaration; text and host alone tell their language."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", F.col("lang").alias("true"), "source")
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = language.identify_documents(docs.withColumn("lang", F.when(~hidden, F.col("true")))).where("lang is null and length(text) > 60").collect()
    assert len(rows) > 150 and np.mean([r.lid_lang == r.true for r in rows]) > 0.97


def test_clashing_names(spark, docs):
    """Columns named as the operators name theirs inside stay as they are."""
    own = ("cut_text", "cut_id", "lid_declared", "lid_text", "lid_host", "lid_suffix", "lid_key", "row", "mix_size", "mix_source", "mix_row", "leak_key", "leak_text", "gone", "repeated_id", "component_id")
    rows = docs.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))).alias(c) for c in own])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SF).collect()
        assert out and all(r[c] == f"{c}{r.doc_id or 0}" for r in out for c in own)
    assert mixing.mix(rows.withColumn("copy_no", F.lit("old"))).columns[-1] == "copy_no"


def test_language_evidence(spark):
    """With text that says little, the declaration, the host and the address suffix decide."""
    de, fr = "der die und ist nicht das", "le la et est pas dans les"
    pages = [(k, f"http://h{k % 3}.example.{'de' if k % 2 else 'fr'}/x", f"<html lang='{'de' if k % 2 else 'fr'}'><p>{(de if k % 2 else fr) * 4}</p></html>") for k in range(60)]
    pages += [(100, "http://h1.example.de/y", "<html><p>1</p></html>"), (101, "https://other.example.fr/", "<p>2</p>"), (102, None, "<html lang=de><p>3</p>"), (103, None, None)]
    rows = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert rows[100].lid_lang == "de" and rows[101].lid_lang == "fr" and rows[102].lid_lang == "de" and not rows[103].lid_keep
    assert all(rows[k].lid_lang == ("de" if k % 2 else "fr") for k in range(60))


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a><a href=/b>B</a></nav><div class="ad">Buy this now</div>
<article><h1>The &amp; title</h1><p>First <b>bold</b>   text&nbsp;here, long enough to count as a paragraph of prose.<br>After the break.<p>Unclosed paragraph &#233;.<div id="comments"><p>nice</p></div></article>
<form><label>Name</label></form><footer>&copy; me</footer><script>var x = "<p>no</p>";</script></body></html>"""
LOOSE = """<body><div class=menu><a>Home</a> <a>About</a></div><div><h2>Short</h2><p>A long paragraph of real content with many words in it, and more of them.</p><p>Another long paragraph of real content, as long as the first one was.</p></div>
<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><aside>see also</aside></body>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "The & title\nFirst bold text here, long enough to count as a paragraph of prose. After the break.\nUnclosed paragraph é."
    named = "<article class='post-header'><header><h1>T</h1></header><div class='article-header'>By me</div><p>text</p><div class='share'>Share</div></article><article class='comment'>hi</article>"
    assert html_text.main_text(named) == "T\nBy me\ntext"
    assert html_text.main_text("<body>a<script>x</script> b<br>c<!-- d --></body>") == "a b c"
    assert html_text.main_text(LOOSE).split("\n")[0] == "Short" and "two" not in html_text.main_text(LOOSE).split()
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    long = "<article><p>" + "word " * 200_000 + "</p></article>"
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "v", long)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract(pages).collect()
    assert len(rows) == 5 and {len(r.text) for r in rows if r.page_id == 3} == {len(long) - len("<article><p></p></article>") - 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_articles_of_the_pages(spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
        assert html_text.main_text(r.html) == "\n".join(x for x in blocks if x)


def test_warc(spark):
    pages = [(3, "http://a/", "same"), (1, "http://b/", "same"), (7, "http://c/", "same"), (2, None, None), (4, "u\r\nv", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: response é"), (5, "w", ""), (6, "x", "y" * 300_000), (9, "q", "uniq")]
    frame = spark.createDataFrame([(*p, "z") for p in [*pages, pages[7], (None, "n", "n")]], "page_id long, url string, html string, sha string")
    for least, revisits in ((0, {3: 1, 7: 1, 5: 2}), (1, {3: 1, 7: 1}), (5, {})):
        path = work_path(spark, "test")
        warc.write_warc(frame.repartition(3), path, least)
        records = warc.read_records(spark, path)
        assert records.groupBy("type").count().where("type = 'request'").first()["count"] == 9
        rows = {r.record_id: r for r in warc.assemble(records).collect()}
        assert len(rows) == 8
        for page, url, html in pages:
            r, data = rows[f"urn:page:{page}:capture"], (html or "").encode()
            assert r.request is not None and r.metadata.payload_bytes == len(data) and r.response.digest == warc.digest_of(data)
            assert r.response.type == ("revisit" if page in revisits else "response")
            if page in revisits:
                assert r.response.refers_to == f"urn:page:{revisits[page]}:capture" and r.response.payload is None
            else:
                assert bytes(r.response.payload) == data
            assert r.url == (url or "").replace("\r", "%0D").replace("\n", "%0A")
    path = work_path(spark, "test")
    warc.write_warc(frame.limit(0), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0
    alone = spark.createDataFrame([("metadata", "m", "gone", None, "u", None, 3, None)], warc.RECORD)
    assert warc.assemble(alone).first().response is None


def test_factorisation_identity():
    """The linear-time sum over pairs is the sum over pairs."""
    m = quality.Machine(np.zeros((len(quality.STATISTICS), quality.BINS - 1)))
    stats, doc, bucket, weight = quality.describe([b"a b c a", b"", b"x! Y"])
    d, f, x = m.features(stats, doc, bucket, weight)
    got, _ = m.raw(d, f, x, 3)
    for k in range(3):
        at = np.flatnonzero(d == k)
        pairs = sum(m.factor[f[i]] @ m.factor[f[j]] * x[i] * x[j] for i in at for j in at if i < j)
        assert got[k] == pytest.approx(m.bias + (m.weight[f[at]] * x[at]).sum() + pairs)


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    rows = quality.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert np.mean([a > b for a in s[y == 1] for b in s[y == 0]]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9 and np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_quality_of_odd_texts(spark, none, docs):
    empty = quality.train(spark.createDataFrame([], "text string, quality int"))
    one = quality.train(spark.createDataFrame([("a b", 1), (None, 1), ("", 1)], "text string, quality int"))
    for machine in (empty, one):
        rows = quality.score(docs.withColumn("quality_score", F.lit("old")), machine).collect()
        assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    assert quality.score(none, empty).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        ids = [r.doc_id for r in after]
        if name == "source_mixing":
            assert out.columns == [*docs.columns, "copy_no"] and after
            break
        assert out.columns == docs.columns and len(ids) == len(set(ids)) and set(ids) <= set(before)
        if name == "near_duplicates":
            part = brute_sets([(i, r.text) for i, r in before.items()], 5, 80)
            assert set(ids) == {i for i, _, component, _ in part if i == component}
        elif name != "repeated_passages":
            assert len(ids) > 0.9 * len(before)
        docs = spark.createDataFrame(after, docs.schema)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_take_odd_rows(spark, docs, none, tmp_path):
    for rows in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            n = out.count()
            assert out.columns[: len(rows.columns)] == rows.columns and (n > 0 or rows is none or name == "language_id")


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in registry.queries())] == [] and "pipeline" in registry.queries()
    assert len(texts()) > 40
