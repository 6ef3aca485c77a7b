"""Keywords, lexicons, sessions and resampling against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from curatrix.functions import raster
from curatrix.operators import keywords as kw
from curatrix.operators import rules


def test_first_keyword(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    keys = [(" ".join(word() for _ in range(rng.randint(1, 3))), k) for k in rng.sample(range(1000), 120)] + [("A  b", 2000), ("", 3000), (None, 1)]
    texts = [(i, None if i % 17 == 0 else " ".join(word().upper() if rng.random() < 0.3 else word() for _ in range(rng.randint(0, 9))), "clash") for i in range(300)] + [(900, "", "c"), (901, "a  B", "c")]
    want = {}
    for i, t, _ in texts:
        hits = [(o, k.lower()) for k, o in keys if k is not None and t is not None and f" {k.lower()} " in f" {t.lower()} "]
        want[i] = min(hits)[1] if hits else None
    rows, table = spark.createDataFrame(texts, "i int, t string, keyword string").repartition(3), spark.createDataFrame(keys, "keyword string, ord int")
    for limit in (1 << 20, 0):
        got = kw.first_keyword(rows, "t", table, limit)
        assert got.columns == ["i", "t", "keyword"]
        assert {r.i: r.keyword and r.keyword.lower() for r in got.collect()} == want
    assert kw.first_keyword(rows, "t", table.limit(0)).where("keyword is not null").isEmpty()
    assert kw.first_keyword(rows.limit(0), "t", table).isEmpty()


def test_with_lexicon(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["z"])], "k int, w array<string>")
    lexicon = spark.createDataFrame([("a", "A"), ("b", None), ("z", "Z"), ("z", "Z")], "word string, tag string")
    got = {r.k: r.m for r in kw.with_lexicon(rows, "k", F.col("w"), lexicon, "tag", "m").collect()}
    assert got == {1: {"a": "A"}, 2: {}, 3: {}, 4: {"z": "Z"}}


def test_with_lexicon_by_lookup_and_by_join(spark):
    rng = random.Random(9)
    lists = {k: None if k % 11 == 0 else [rng.choice(["a", "b", "c", "d", "", None]) for _ in range(rng.randint(0, 6))] for k in range(200)}
    rows = spark.createDataFrame(list(lists.items()), "k int, w array<string>").repartition(3)
    lexicon = spark.createDataFrame([("a", 1), ("b", None), ("", 3), ("d", 4), (None, 5)], "word string, n long")
    want = {k: {w: n for w, n in (("a", 1), ("", 3), ("d", 4)) if w in (ws or ())} for k, ws in lists.items()}
    for limit in (1 << 20, 0):
        assert {r.k: r.m for r in kw.with_lexicon(rows, "k", F.col("w"), lexicon, "n", "m", limit).collect()} == want
    assert kw.with_lexicon(rows, "k", F.col("w"), lexicon.limit(0), "n", "m").where("size(m) > 0").isEmpty()
    assert kw.with_lexicon(rows.limit(0), "k", F.col("w"), lexicon, "n", "m").isEmpty()


def test_rows_are_not_broadcast_for_a_lexicon(spark):
    rows = spark.range(50).selectExpr("id AS k", "array('a', 'b') AS w")
    lexicon = spark.createDataFrame([("a", 1)], "word string, n long")
    for limit in (1 << 20, 0):
        plan = kw.with_lexicon(rows, "k", F.col("w"), lexicon, "n", "m", limit)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan


def test_words_of_a_lexicon_are_not_sorted_before_they_are_distinct(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet

    def noted(self, *args, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    rows = spark.range(50).selectExpr("id AS k", "array('as', 'bs') AS w")
    lexicon = rows.select(F.explode("w").alias("word")).distinct().select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
    got = kw.with_lexicon(rows, "k", F.col("w"), lexicon, "lemma", "m")
    assert plans and not any("SortAggregate" in p for p in plans)
    assert got.where("m['as'] = 'a' and m['bs'] = 'b'").count() == 50


def test_sessions_of_any_length(spark):
    turns = [(s, k, f"t{k}" if (s * 7 + k) % 13 else None) for s in range(12) for k in range(s * 3)]
    random.Random(1).shuffle(turns)
    step = lambda state, turn: F.concat(state, F.lit("/"), turn["said"])
    got = {r.s: (r.history, r.done) for r in rules.sessions(spark.createDataFrame(turns, "s int, k int, said string"), "s", "k", F.lit("start"), step).collect()}
    want = {}
    for s in range(1, 12):
        state, history, done = "start", [], True
        for _, _, said in sorted(t for t in turns if t[0] == s) if s else []:
            if said is None:
                done = False
                break
            state = f"{state}/{said}"
            history.append(state)
        want[s] = (history, done)
    assert got == want


@pytest.mark.parametrize("to", [(1, 1), (4, 7), (9, 2), (5, 6)])
def test_resampling(spark, to):
    rng = np.random.default_rng(6)
    pictures = [rng.random((h, w)) for h, w in ((1, 1), (1, 5), (6, 1), (5, 6), (13, 9))]

    def brute(x, y, k):
        at = [min(max((i + 0.5) * n / m - 0.5, 0), n - 1) for i, n, m in ((y, x.shape[0], to[0]), (k, x.shape[1], to[1]))]
        total = 0.0
        for a in range(x.shape[0]):
            for b in range(x.shape[1]):
                total += max(0, 1 - abs(a - at[0])) * max(0, 1 - abs(b - at[1])) * x[a, b]
        return total

    frame = spark.createDataFrame([(k, x.ravel().tolist(), *x.shape) for k, x in enumerate(pictures)] + [(-1, None, 1, 1), (-2, [1.0], 1, 2)], "k int, v array<double>, h int, w int")
    got = {r.k: r.r for r in frame.select("k", raster.resized(F.col("v"), F.col("h"), F.col("w"), F.lit(to[0]), F.lit(to[1])).alias("r")).collect()}
    assert got[-1] is None and got[-2] is None
    for k, x in enumerate(pictures):
        assert np.allclose(got[k], [brute(x, y, c) for y in range(to[0]) for c in range(to[1])])
    grey = spark.range(1).select(raster.grey(F.expr("array(1D, 2D, 3D, 10D, 0D, 0D)"))).first()[0]
    assert grey == pytest.approx([0.299 + 2 * 0.587 + 3 * 0.114, 2.99])
