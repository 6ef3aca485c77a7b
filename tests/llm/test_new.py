"""Whitening, exact dedup and the filter audit against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import audit, exact, whitening
from tests.llm.conftest import texts


# --------------------------------------------------------------------------- whitening


def brute_whitening(rows, k=4):
    """{vec_id: (deviation, whitened)}, n, shares: from (vec_id, list) rows of one length."""
    levels = [(i, [math.floor(256 * float(np.float64(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in levels})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[x[j] - total[j] / n for j in range(d)] for x in fit])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-value)[:k]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), (np.array(x) - np.array(total) / n) @ vector[:, order] / np.sqrt(value[order])) for i, x in levels]
    return out, n, value[order] / value.sum()


def check_whitening(got, rows, k=4):
    want, n, shares = brute_whitening(rows, k)
    assert len(got) == k * len(want)
    by = defaultdict(list)
    for r in got:
        assert r.n == n and r.explained == pytest.approx(shares[r.component - 1], rel=1e-6) and 0 <= r.identity_error < 1e-6
        by[r.vec_id, r.component].append((r.deviation, r.whitened))
    seen = defaultdict(list)
    for i, dev, w in want:
        for c in range(k):
            seen[i, c + 1].append((dev, w[c]))
    for c in range(1, k + 1):
        key = next(x for x in seen if x[1] == c and abs(seen[x][0][1]) > 0.1)
        sign = math.copysign(1, sorted(by[key])[0][1] * sorted(seen[key])[0][1])
        for x in seen:
            if x[1] == c:
                a, b = sorted(by[x]), sorted((d, sign * v) for d, v in seen[x])
                assert [d for d, _ in a] == [d for d, _ in b]
                assert sorted(v for _, v in a) == pytest.approx(sorted(v for _, v in b), abs=1e-8)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 6)) * np.array([9, 5, 3, 2, 1, 0.5]) + 40
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (900, rows[3][1]), (901, rows[3][1])]
    odd = [(-1, None), (-2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (-3, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (-4, [float("inf")] + [0.0] * 5), (-5, [1.0, 2.0]), (-6, [])]
    df = spark.createDataFrame([(i, v, 1, b"x", 0.5) for i, v in rows + odd], "vec_id long, embedding array<float>, n int, x binary, w double").repartition(3)
    check_whitening(whitening.whiten(df).collect(), rows)
    assert whitening.whiten(df, 2).where("component > 2").isEmpty()


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check_whitening(whitening.op11_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_whitening_without_variance_or_rank(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)] + [(None, [3.0, 6.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 21 and {r.component for r in got} == {1} and {round(r.explained, 9) for r in got} == {1.0}


def test_whitening_of_very_large_entries(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [2.0**41, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 1).collect()
    want, _, shares = brute_whitening(rows, 1)
    assert all(r.explained == pytest.approx(shares[0], rel=1e-4) for r in got)
    for r in got:
        exactly = next(d for i, d, _ in want if i == r.vec_id)
        assert r.deviation == (exactly if exactly < 2**63 else None)
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(far, 1).count() == 2
    offset = [(i, [2.0**44 + i, float(-i * i)]) for i in range(9)]
    check_whitening(whitening.whiten(spark.createDataFrame(offset, "vec_id long, embedding array<double>"), 2).collect(), offset, 2)


# --------------------------------------------------------------------------- exact dedup


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def spaced(spark):
    rows = texts() + [(101, "one"), (100, " o\tn e\n"), (102, "o n e"), (103, "one "), (104, "One"), (105, "x" * 128 + "a"), (106, "x" * 128 + "b"), (107, "x" * 128 + "a")]
    rows += [(200 + i, "the hot text") for i in range(300)] + [(None, "the hot  text"), (102, "o n e")]
    return rows, spark.createDataFrame([(i, t, "q", 3, b"y", i, "z") for i, t in rows], "doc_id long, text string, full string, n int, bits binary, row long, best string").repartition(5)


def test_exact(spark, spaced, none):
    rows, df = spaced
    got = sorted(repr(tuple(r)) for r in exact.exact_duplicates(df, digest=True).collect())
    assert got == brute_exact(rows)
    lazy = exact.exact_duplicates(df)
    assert lazy.where("group_size > 1 and text_sha256 is null").isEmpty() and not lazy.where("text_sha256 is null").isEmpty()
    assert exact.exact_duplicates(none).count() == 0


def test_exact_keeps_whole_rows(spaced):
    rows, df = spaced
    kept = exact.deduplicated(df)
    assert kept.columns == df.columns
    want = [w for w in map(eval, brute_exact(rows)) if w[3]]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want)
    assert len({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()}) == len(want)


def test_exact_filter_bits_set_by_chance_change_nothing(spark, spaced, monkeypatch):
    monkeypatch.setattr(exact, "LEAST_BITS", 4)
    monkeypatch.setattr(exact, "MOST_BITS", 4)
    rows, df = spaced
    assert sorted(repr(tuple(r)) for r in exact.exact_duplicates(df, digest=True).collect()) == brute_exact(rows)


# --------------------------------------------------------------------------- filter audit


def brute_audit(rows, labels):
    marks = defaultdict(lambda: (False, False))
    for i, q, t in labels:
        marks[i] = (marks[i][0] or q == 1, marks[i][1] or t == 1)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (o or "") == t for j, o, _ in rows),
        }
        docs.append((lang or "", fails, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in mine)
                shapley[f] += len(gone)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), unique, sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audited(spark):
    rng = np.random.default_rng(4)
    rows = [(i, t, ["en", None, "de", "h"][k % 4]) for k, (i, t) in enumerate(texts())]
    for i in range(300, 420):
        words = rng.choice([f"w{j}" for j in range(int(rng.integers(20, 400)))], int(rng.integers(100, 500))).tolist()
        rows.append((i, " ".join(w.upper() if rng.random() < 0.03 else w for w in words) + rng.choice(["", " 5%", " a|b", ""]), str(rng.choice(["en", "de"]))))
    rows += [(600 + i, rows[-1 - i % 5][1], "fr") for i in range(20)] + [(419, rows[-1][1], "fr"), (None, rows[-1][1], "fr")]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in rng.choice([r[0] for r in rows if r[0]], 90, False)] + [(600, None, 1), (600, 1, None), (None, 1, 1), (99999, 1, 1)]
    return rows, labels, spark.createDataFrame([(*r, 1, b"m", "p") for r in rows], "doc_id long, text string, lang string, n int, mask binary, part string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit(audited, none):
    rows, labels, docs, marks = audited
    assert as_dict(audit.filter_audit(docs, marks)) == brute_audit(rows, labels)
    assert audit.filter_audit(none, marks).count() == 0
    assert as_dict(audit.filter_audit(docs, marks.limit(0))) == brute_audit(rows, [])


def test_audit_in_pieces_and_many_parts(spark, audited, monkeypatch):
    rows, labels, docs, marks = audited
    long = " ".join(f"w{i % 977}é" for i in range(5000)) + " " + "x" * 300 + "\t%"
    whole = audit.failures(long.encode())
    monkeypatch.setattr(audit, "PIECE", 64)
    assert audit.failures(long.encode()) == whole == 2 + 8
    monkeypatch.setattr(audit, "PARTS", 1)
    counts = [("p%d" % (k % 7), k % 4, k % 32, k) for k in range(200)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({c: [r[j] for r in counts] for j, c in enumerate(("part", "label", "mask", "n"))})
    got = Counter()
    for out in audit._accumulate(iter([batch])):
        assert out.num_rows == 1
        for part, cells in zip(out.column("part").to_pylist(), out.column("cells").to_pylist(), strict=True):
            got[part] += sum(cells[-32:])
    assert got == Counter({f"p{j}": sum(r[3] for r in counts if r[0] == f"p{j}") for j in range(7)})
