from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, z int, h string, label string, score string"


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    """Words of a small vocabulary with exact and near copies, shared passages and lines, nulls, and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "on", "ti", "é", "ou", "th"]) for _ in range(r.randint(1, 4)))
    run = lambda k: " ".join(word() for _ in range(k))
    passage, lines = run(60), [run(12) for _ in range(4)]
    out: list[str | None] = []
    for i in range(n):
        k = i % 10
        if k == 0 and out:
            out.append(out[r.randrange(len(out))])
        elif k == 1 and out and out[-1]:
            ws = out[-1].split(" ")
            ws[len(ws) // 2] = "changed"
            out.append(" ".join(ws))
        elif k == 2:
            out.append(run(30) + " " + passage + "\n" + run(20))
        elif k == 3:
            out.append("\n".join([run(9), *lines, run(8)]))
        elif k == 4:
            out.append(r.choice([None, "", " ", "one", "two words", "\n\n", "x" * 300, "ab " * 200, "  lead\t\ttail  "]))
        else:
            out.append("\n".join(run(r.randint(5, 40)) for _ in range(r.randint(1, 5))))
    return out


def rows(values: list[str | None]) -> list[tuple]:
    return [(i * 3 + 1, t, "en", "s", len(t or ""), 5, "h", "l", "s") for i, t in enumerate(values)]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame(rows(texts()), SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def pairs(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, one id with several texts."""
    return spark.createDataFrame([(None, "a b c", *[None] * 7), (1, "a b c", *[None] * 7), (1, "a b c", *[None] * 7), (2, None, *[None] * 7), (2, "x y z", *[None] * 7), (None, None, *[None] * 7)], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
