from __future__ import annotations

import random

from larkspan.llm import decontaminate


def brute_score(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        here = [0]
        for j, y in enumerate(b):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        best, above = max(best, *here), here
    return best / (2 * len(a))


def test_edited_copies_match_brute_force_alignment(spark):
    r = random.Random(4)
    word = lambda: f"w{min(int(r.paretovariate(0.6)), 400)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 5, 6, 9, 17, 30, 39, 39, 39)]
    rows = []
    for item in items:
        for share in (0.15, 0.2, 0.25, 0.3):
            for _ in range(3):
                edited = [f"x{r.randrange(90)}" if r.random() < share else w for w in item]
                rows.append([word() for _ in range(r.randrange(20))] + edited + [word() for _ in range(r.randrange(20))])
        rows.append([f"y{k}" if k % 3 == 2 else w for k, w in enumerate(item)])  # no three words in a row are left
        rows.append([w for x in item for w in (x, "z")])  # no two are
        rows.append(["y" if k % 5 == 4 else w for k, w in enumerate(item)])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    for threshold in (0.5, 0.7, 0.4):
        want = {(d, i): s for d, w in enumerate(rows) for i, item in enumerate(items) if (s := brute_score(item, w)) >= threshold}
        got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(docs, tests, threshold=threshold).collect()}
        assert got == want and len(want) > 50
    gone = {d for d, _ in want}
    assert {x.doc_id for x in decontaminate.decontaminated(docs, tests, threshold=0.4).collect()} == set(range(len(rows))) - gone
