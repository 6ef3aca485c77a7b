import random

import pytest

LETTERS = "abcdefghijklmnop"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 7))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, short, empty and null texts, repeated rows, a long text, no id."""
    rng = random.Random(7)
    base = sentence(rng, 120)
    passage = sentence(rng, 30)
    words = base.split()
    near = words.copy()
    near[60] = "changed"
    rows: list[tuple[int | None, str | None]] = [
        (5, base), (3, base), (9, base.upper()), (2, " ".join(near)), (11, " ".join(words[:100])), (12, passage + " " + sentence(rng, 60)), (4, sentence(rng, 50) + "\n" + passage), (13, passage),
        (20, ""), (21, None), (22, "one"), (23, "one two"), (24, "one two"), (25, "x " * 90), (26, "x " * 40), (27, "é" * 130), (28, "ü" * 60 + "é" * 120), (30, sentence(rng, 9000)),
        (31, sentence(rng, 200)), (31, None), (None, base), (None, None), (40, "\t \n \x0b"), (41, sentence(rng, 14)),
    ]
    rows = [r for r in rows if r != (31, None)]
    rows += [(31, rows[18][1]), (31, rows[18][1])]
    for i in range(50, 80):
        rows.append((i, sentence(rng, rng.randint(1, 60)) + " " + rng.choice([base, passage, sentence(rng, 20), base[40:400]])))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en" if i is None or i % 2 else None, None if i == 5 else f"src{(i or 0) % 4}", 1, "k", b"h", 0.5) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, b int, kind string, h binary, n double").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id = -1")
