"""Priors and fusion of language ID against plain loops, and many declared codes."""

import math
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import language as lid

WORDS = {"xx": "ab cade bado lemi", "yy": "quir tzo wexu yrq", "zz": "hhon ghth ophi nnuh"}


def rows_of(seed=3):
    """(text, declared, host, suffix): right and wrong and missing declarations, hosts of one language, short and empty texts."""
    rng, out = random.Random(seed), []
    for i in range(260):
        k = rng.choice(list(WORDS)) if i % 3 else "xx"
        text = " ".join(rng.choice(WORDS[k].split()) for _ in range(rng.choice((0, 1, 2, 5, 40))))
        declared = {0: None, 1: rng.choice(list(WORDS)), 2: f"junk{i}"}.get(i % 7, k.upper() + "-AA")
        host = f"h{i % 5}.{k}" if i % 4 else f"mixed{i % 2}.com"
        out.append((text if i % 19 else None, declared, host, host.split(".")[-1]))
    return out + [("1 2 3", "xx", "h0.xx", "xx"), ("1 2 3", None, "h1.yy", "yy"), ("", None, None, None), ("ab cade", "rare", None, "xx"), ("quir wexu", "rare", None, "yy")]


def grams(text):
    """Hashed byte trigrams with a letter; the hash is the operator's."""
    return lid.trigrams([(text or "").encode()])[1].tolist()


def brute(rows):
    declared = [d.split("-")[0].split("_")[0].lower() if d else None for _, d, _, _ in rows]
    said = [d for d, (t, *_) in zip(declared, rows, strict=True) if d is not None and t is not None]
    langs = [k for k in sorted(set(said)) if any(d == k and grams(t) for d, (t, *_) in zip(declared, rows, strict=True) if t)]
    counts = {k: np.zeros(1 << lid.BITS) for k in [*langs, "und"]}
    for d, (t, *_) in zip(declared, rows, strict=True):
        if d in langs and t is not None:
            for g in grams(t):
                counts[d][g] += 1
    likely, smooth = [], {k: 0.05 * min(1.0, c.sum() / (1 << 14)) if k != "und" else 0.05 for k, c in counts.items()}
    for d, (t, *_) in zip(declared, rows, strict=True):
        g, scores = grams(t), []
        for k, c in counts.items():
            if k == d and said.count(k) < 50 and g:
                c = c.copy()
                for x in g:
                    c[x] = max(0, c[x] - 1)
                if c.sum() < 0.5:
                    scores.append(None)
                    continue
            scores.append(sum(math.log((c[x] + smooth[k]) / (c.sum() + smooth[k] * (1 << lid.BITS))) for x in g) * min(1.0, 120 / max(1, len(g))))
        likely.append([scores[-1] if s is None else s for s in scores])
    first = [int(np.argmax(s)) for s in likely]
    n = len(counts)
    whole = np.ones(n)
    table = {k: np.ones(n) for k in langs}
    for d, f in zip(declared, first, strict=True):
        whole[f] += 1
        if d in table:
            table[d][f] += 1
    total, share = sum(table.values()), whole / whole.sum()

    def level(test, above, weight):
        c = np.zeros(n)
        for (_, _, h, s), f in zip(rows, first, strict=True):
            if test(h or "", s or ""):
                c[f] += 1
        return (weight * above + c) / (weight + c.sum())

    out = []
    for d, (t, _, host, suffix), s in zip(declared, rows, likely, strict=True):
        prior = level(lambda h, x: (h, x) == (host or "", suffix or ""), level(lambda h, x: x == (suffix or ""), share, 50.0), 20.0)  # noqa: B023
        score = np.array(s) + np.log(prior) + (np.log(table[d] / total) if d in table else 0)
        p = np.exp(score - score.max())
        p /= p.sum()
        k = int(score.argmax())
        out.append(([*langs, "und"][k], p[k], bool(grams(t)) and k < len(langs) and p[k] >= 0.5))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string, h string, s string").repartition(3)


def found(df):
    return {r.i: r for r in lid.identify(df, *(F.col(c) for c in "tdhsi")).collect()}


def test_languages_of_enough_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(f"c{k}",) for k in range(10) for _ in range(1 + k // 3)], "lang string")
    for most, least in ((10, 1), (9, 2), (7, 2), (6, 3), (3, 4), (1, 4)):
        monkeypatch.setattr(lid, "MOST_LANGUAGES", most)
        assert lid.languages(rows) == {f"c{k}": 1 + k // 3 for k in range(10) if 1 + k // 3 >= least}
    assert lid.languages(rows.limit(0)) == {}


def test_priors_and_fusion(spark):
    rows = rows_of()
    got = found(frame(spark, rows))
    for i, (lang, p, keep) in enumerate(brute(rows)):
        assert got[i].lid_lang == lang and got[i].lid_posterior == pytest.approx(p, rel=1e-3, abs=1e-5) and got[i].lid_keep == keep


def test_many_codes_make_no_models(spark):
    rows = [r for r in rows_of() if not (r[1] or "").startswith(("junk", "rare"))] * 4
    plain = found(frame(spark, rows))
    junk = [(f"{k} ab cade lemi bado", f"c{k}", None, None) for k in range(5000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = found(frame(spark, rows + junk))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB, of the driver's Python
    assert set(lid.languages(frame(spark, rows + junk).select(lid.primary(F.col("d")).alias("lang")).where("lang is not null"))) == set(WORDS)
    same = [got[i].lid_lang == r.lid_lang for i, r in plain.items() if rows[i][1] and len(rows[i][0] or "") > 20]
    assert all(same) and {got[len(rows) + k].lid_lang for k in range(5000)} == {"xx"}
