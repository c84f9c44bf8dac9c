from __future__ import annotations

import random

from larkspan.llm import line_dedup


def brute(rows, long):
    """Lines of runs of two lines or more, not all empty, that occur anywhere earlier, and long lines that do."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for k, x in enumerate(lines):
            for n in (1, 2):
                run = tuple(lines[k : k + n])
                if len(run) < n or (n == 1 and len(x) < long) or not any(run):
                    continue
                if run in seen:
                    gone |= set(range(k, k + n))
                seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def kept(spark, rows, **how):
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how)
    return {r.doc_id: r.text for r in out.collect()}


def test_single_long_lines_and_documents_of_one_line(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, passage), (4, f"{passage}\n{passage}"), (5, "short"), (6, "short"), (7, f"x\n{passage}")]
    got = kept(spark, rows, long=line_dedup.LONG)
    assert got == {1: rows[0][1], 2: "c\nd", 3: "", 4: "", 5: "short", 6: "short", 7: "x"} == brute(rows, line_dedup.LONG)


def test_runs_match_all_earlier_runs(spark):
    r = random.Random(6)
    line = lambda: f"{r.random()}"
    rows = [(0, "\n".join([line(), "H1", "H2", line()]))]
    for k in range(1, 60, 2):  # the frequent pair is first seen in document 0, the run around it in document k
        run = "\n".join([line(), "H1", "H2", line()])
        rows += [(k, f"{line()}\n{run}\n{line()}"), (k + 1, f"{line()}\n{run}\n{line()}")]
    rows += [(100 + k, "\n".join(r.choice("abcdefghijklmnop") * r.choice((1, 1, 200)) for _ in range(6))) for k in range(60)]
    assert kept(spark, rows, long=line_dedup.LONG) == brute(rows, line_dedup.LONG)
