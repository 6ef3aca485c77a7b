"""Cases that a cut inside an operator would lose."""

import math
import random
import re
import time

from pyspark.sql import functions as F

from curatrix.llm import html_text, jaccard, language, leaks, quality, substring, suffix
from tests.llm.conftest import LETTERS, sentence
from tests.llm.test_dedup import brute_bytes, brute_sets, brute_words


def test_leaks_without_a_run_of_five():
    rng = random.Random(11)
    word = sentence(rng, 15).split()
    changed = [f"changed{i}" if i in (4, 9, 14) else w for i, w in enumerate(word)]
    order = [3, 0, 4, 1, 2]
    cut = [w for k in order for w in (*word[3 * k : 3 * k + 3], "and")]
    block = leaks.Benchmark([(7, " ".join(word)), (9, "今日は晴れ。")])
    texts = [sentence(rng, 40) + " " + " ".join(x) + " " + sentence(rng, 40) for x in (changed, cut)]
    got = block.leaks([*texts, "彼は言った、今日は晴れだと。", "今日", ""])
    assert got[0] == (7, 0.8, 3) and got[1] == (7, 1.0, 5) and got[2] == (9, 1.0, 1) and got[3] is None and got[4] is None


def test_leaks_are_those_of_all_pairs():
    """Few words, so that items share runs: the best item is the one that tiling against every item finds."""
    rng = random.Random(12)
    words = [chr(97 + i) * 2 for i in range(9)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 14)))) for i in range(30)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    runs = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    for text, got in zip(texts, leaks.Benchmark(items, 1e-9).leaks(texts), strict=True):
        shares = any(runs(text.split()) & runs(t.split()) for _, t in items)
        assert (got is not None) == shares
        if got:
            most = max(sum(k for _, _, k in leaks.tile(leaks.tokens(t).tolist(), leaks.tokens(text).tolist())) / len(t.split()) for _, t in items)
            assert got[1] >= most - 1e-9


def test_language_beyond_64_declared(spark):
    """70 languages with words of their own, the last of one to five rows; regions of one language are one; a single
    mistaken declaration makes no language; rows that declare nothing known count in the priors."""
    rng = random.Random(13)
    words = {k: ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(40)] for k in range(71)}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(60))
    code = lambda k: f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"
    rows = [(k, text(k), code(k)) for k in range(70) for _ in range(12 if k < 64 else k - 63 if k < 69 else 1)]
    rows += [(70, text(70), c) for c in ("en-US", "en_GB", "EN", "en") for _ in range(12)] + [(70, text(70), "odd")]
    frame = spark.createDataFrame([(i, t, c, "h", k) for i, (k, t, c) in enumerate(rows)], "doc_id long, text string, lang string, source string, k int")
    got = language.identify_documents(frame).collect()
    wrong = [(r.lang, r.lid_lang) for r in got if r.lid_lang != ("en" if r.k == 70 else code(r.k)) or not r.lid_keep]
    assert len(got) == len(rows) and wrong == []


PROSE = [f"Paragraph {k} of the real content, with many words in it, long enough to count as prose and not as a menu." for k in range(4)]


def test_html_beside_teasers_and_in_layout_classes():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    want = "\n".join(PROSE)
    teasers = "".join(f"<article><h3><a href={k}>More {k}</a></h3><p><a href={k}>Read</a></p></article>" for k in range(3))
    assert html_text.main_text(f"<body><div>{body}</div>{teasers}</body>") == want
    assert html_text.main_text(f"<body><article><h1>Title</h1></article><div>{body}</div></body>").endswith(want)
    both = html_text.main_text(f"<body><article>{body}</article><div>{body}</div><div><a href=1>one</a> <a href=2>two</a></div></body>")
    assert both == want + "\n" + want
    for name in ("has-sidebar", "with-header", "content legal", "comments-enabled"):
        page = f"<body><nav>x</nav><div class='{name}'><h1>Title</h1><div>{body}</div><div class='sidebar'>see also</div></div><footer>f</footer></body>"
        assert html_text.main_text(page).split("\n")[-4:] == PROSE, name
        assert "see also" not in html_text.main_text(page)
        assert html_text.main_text(f"<body><div class='{name}'>{body}</div><p>By me</p></body>").split("\n")[:4] == PROSE, name
    long = "".join(f"<p>{x}</p>" for x in PROSE * 3)  # comments longer than the article are comments still
    assert html_text.main_text(f"<body><article><h1>T</h1>{body}</article><div id='comments'>{long}</div></body>") == "T\n" + want
    assert html_text.main_text(f"<body><article><ul>{'<li>item</li>' * 60}</ul></article><div><p>{PROSE[0]}</p></div></body>").count("item") == 60


def test_html_ratios_by_brute_force():
    """Smoothing is the weighted mean over the page; the threshold is the split of least variance within."""
    rng = random.Random(14)
    for n in (1, 2, 3, 9, 40):
        v = [rng.choice([1.0, 2.0, 30.0, 80.0]) * rng.random() for _ in range(n)]
        want = []
        for i in range(n):
            k = {j: math.exp(-((i - j) ** 2) / 2) for j in range(n) if abs(i - j) <= 3}
            want.append(sum(v[j] * w for j, w in k.items()) / sum(k.values()))
        assert all(math.isclose(a, b) for a, b in zip(html_text.smoothed(v), want, strict=True))
        spread = lambda x: sum((y - sum(x) / len(x)) ** 2 for y in x) if x else 0.0
        cuts = {c: spread([x for x in v if x < c]) + spread([x for x in v if x >= c]) for c in v}
        assert cuts[html_text.threshold(v)] <= min(cuts.values()) + 1e-9


def test_html_without_article_tags(spark):
    """The ratios alone find what the article tag marks."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        assert html_text.main_text(r.html) == html_text.main_text(re.sub(r"(</?)article", r"\1div", r.html))


def test_html_names_inside_an_article():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    law = "<div class='legal'><p>The law says this, in a long sentence that is part of the article and its argument.</p></div>"
    links = "<div class='related'><a href=1>One</a><p><a href=2>Two</a></p><p><a href=3>Three</a></p></div>"
    got = html_text.main_text(f"<article><h1>T</h1>{body}{law}{links}{body}</article><nav>x</nav>")
    assert "The law says" in got and "Three" not in got and got.count(PROSE[0]) == 2


def test_html_depth_is_linear():
    took = []
    for n in (4000, 32000):
        begun = time.process_time()
        page = "<div class='sidebar'>" * n + "<span>" * n + "</i>" * n + "<p>x" * 50 + "</span>" * n + "</div>" * n
        assert html_text.main_text(page + f"<p>{PROSE[0]}</p>").endswith(PROSE[0])
        took.append(time.process_time() - begun)
    assert took[1] < 24 * took[0]


def long_rows():
    """Texts longer than the pieces that operators work through, with what matters near their ends."""
    rng = random.Random(15)
    base = sentence(rng, 110_000)
    near = base.split()
    near[50_000], near[109_000] = "changed", "again"
    tail = base[-300_000:]
    return [(4, base), (2, " ".join(near)), (9, sentence(rng, 100) + " " + tail), (7, sentence(rng, 90_000)), (5, base), (1, tail[-400:])], rng


def test_long_texts(spark):
    rows, rng = long_rows()
    assert len(rows[0][1].encode()) > 1 << 19
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in substring.substring_dedup(frame, 13, digest=True).collect()), key=str)
    assert got == brute_words(rows, 13)
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in suffix.suffix_dedup(frame, 100).collect()]
    assert sorted(got, key=str) == brute_bytes(rows, 100)
    for words, percent in ((3, 90), (5, 80)):
        assert sorted(map(tuple, jaccard.jaccard_join(frame, words, percent).collect()), key=str) == brute_sets(rows, words, percent)


def test_long_texts_are_looked_at_to_their_end(spark):
    rows, rng = long_rows()
    item = sentence(rng, 20)
    frame = spark.createDataFrame([(i, t + " " + item) for i, t in rows], "doc_id long, text string")
    found = leaks.find_leaks(frame, spark.createDataFrame([(3, item)], "item_id long, text string")).collect()
    assert len(found) == len(rows) and all(r.leak_item == 3 and r.leak_coverage == 1.0 for r in found)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    long = docs.where("length(text) > 200").groupBy("lang").agg(F.max("doc_id").alias("doc_id"), F.repeat(F.max("text"), F.lit(4000)).alias("text"), F.max("source").alias("source"))
    got = language.identify_documents(docs.unionByName(long.withColumn("doc_id", -F.col("doc_id")))).where("doc_id < 0").collect()
    assert len(got) == long.count() and all(r.lid_lang == r.lang for r in got)
    labelled = docs.select("text", (F.length("text") % 2).cast("int").alias("quality"))
    machine = quality.train(labelled)
    raw = {r.doc_id: r.quality_score for r in quality.score(frame, machine).collect()}
    assert all(math.isclose(raw[i], machine.scores([(t + " " + item).encode()])[0]) for i, t in rows)


def test_leaks_by_brute_force(spark):
    """Every item tiled against every text, with a phrase that all items share, in one block and in several."""
    rng = random.Random(16)
    words = [chr(97 + i) * 2 for i in range(14)]
    phrase = "which of these is right"
    items = [(i, phrase + " " + " ".join(rng.choice(words) for _ in range(rng.randint(3, 16)))) for i in range(60)]
    texts = []
    for d in range(120):
        parts = [rng.choice(items)[1].split() for _ in range(rng.randint(0, 3))]
        parts = [p[k:] + p[:k] for p in parts for k in [rng.randint(0, len(p) - 1)]]
        texts.append((d, " ".join(w for p in parts for w in (*p, *(rng.choice(words) for _ in range(rng.randint(0, 9)))))))
    want = {}
    for d, text in texts:
        got = [(-sum(k for _, _, k in leaks.tile(leaks.tokens(t), leaks.tokens(text))) / len(t.split()), i) for i, t in items]
        best = min(got)
        want[d] = (best[1], -best[0]) if -best[0] >= 0.6 else (None, 0.0)
    assert 20 < sum(w[0] is not None for w in want.values()) < 115
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 900):
        found = {r.doc_id: (r.leak_item, r.leak_coverage) for r in leaks.find_leaks(docs, bench, 0.6, size).collect()}
        assert all(found[d][0] == w[0] and math.isclose(found[d][1], w[1]) for d, w in want.items())
