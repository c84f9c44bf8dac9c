"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio (operator 3)."""

from __future__ import annotations

import hashlib
import math
from base64 import b64encode
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm._keys import KEY, keyed
from larkspan.llm._shared import table

#: Kind, pattern, the group whose length counts, and its least length. Kinds rank in this order.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Runs of 20 and more characters of keys that hold a digit; the models judge them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Least log-likelihood ratio a character.
THRESHOLD = 0.5

_STEMS = """user name account customer order item price total count index value list map set get put read write open close file path
stream buffer block page table row column field record key hash node tree graph edge link list queue stack heap array string number
date time day month year hour start end first last next previous current default config option setting server client request response
message event handler listener manager service factory builder parser reader writer loader worker thread process task job batch report
invoice payment address street city country region product category image video audio text document section paragraph sentence word
letter language translation version release build test case result error warning info debug trace level source target origin
destination width height length size color style layout view model controller component module package library import export public
private static final class method function variable constant parameter argument return the and that with for this from into over
tion ing able ment ness ship hood ung heit keit lich schaft ción mente idad eau elle oire ement ique""".split()


def labelled_samples(n: int = 1500) -> list[tuple[str, int]]:
    """Strings with 1 for random ones and 0 for ordinary identifiers; the same at each call."""
    out: list[tuple[str, int]] = []
    for i in range(n):
        d = hashlib.sha512(b"%d" % i).digest()
        size = 20 + d[0] % 24
        shown = [d.hex(), b64encode(d).decode(), "".join(ALPHABET[x % 62] for x in d), "".join(ALPHABET[26 + x % 36] for x in d)][i % 4]
        out.append((shown[:size], 1))
        words = [w for w in (_STEMS[x % len(_STEMS)] for x in d[1 : 4 + d[20] % 3]) if w.isascii()]
        tail = ["", str(d[21] % 100), f"{d[21] % 10}", str(1990 + d[21] % 40)][d[22] % 4]
        joint = [words[0] + "".join(w.title() for w in words[1:]), "_".join(words), "-".join(words), "".join(words), "/".join(words), "_".join(words).upper()][i % 6] if words else "name"
        out.append((joint + tail, 0))
    return out


@lru_cache
def ratios(samples: tuple[tuple[str, int], ...] | None = None) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each pair of neighbouring characters, row by row of the alphabet."""
    size = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for text, y in samples or labelled_samples():
        for a, b in zip(text, text[1:]):
            if a in place and b in place:
                counts[y][place[a]][place[b]] += 1
    rows = [[[math.log(x / sum(row)) for x in row] for row in model] for model in counts]
    return [round(rows[1][a][b] - rows[0][a][b], 5) for a in range(size) for b in range(size)]


def _llr(token: Column) -> Column:
    """Mean log-likelihood ratio of a token's pairs of characters: split once, so its work follows its length."""
    model = F.split(F.lit(",".join(map(str, ratios()))), ",").cast("array<double>")
    code = lambda c: F.instr(F.lit(ALPHABET), c)
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, c: Column) -> Column:
        pair = F.element_at(model, F.greatest(F.lit(1), (acc["last"] - 1) * len(ALPHABET) + code(c)).cast("int"))
        return F.struct(code(c).alias("last"), F.when(acc["last"] > 0, acc["sum"] + pair).otherwise(F.lit(0.0)).alias("sum"))

    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["sum"]) / (F.length(token) - 1)


def _matches(rows: DataFrame, rank: int, kind: str, pattern: str, group: int) -> DataFrame:
    """One row per match: where it starts and ends in code points, and the group that is measured."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.regexp_extract_all("text", p, 0).alias("m"), F.regexp_extract_all("text", p, F.lit(group)).alias("g"), F.split("text", pattern, -1).alias("s"))
    each = rows.where(F.col("text").rlike(pattern)).select(*KEY, F.posexplode(parts).alias("n", "x"))
    before = Window.partitionBy(*KEY).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("x.s") + F.coalesce(F.length("x.m"), F.lit(0))
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("x.s")
    out = each.select(*KEY, F.col("x.m").alias("m"), F.col("x.g").alias("g"), start.cast("long").alias("start")).where("m is not null")
    return out.select(*KEY, F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "start", (F.col("start") + F.length("m")).alias("end"), "m", "g")


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, ...) -> (z, i, h, rank, kind, start, end, found): all spans of each distinct document.

    kind is a rule's, or markov: a run of key characters that the model of random strings explains better than that of
    ordinary identifiers, by more than the threshold a character. It may lie on a rule's span.
    """
    any_of = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in [*(r[1] for r in RULES), CANDIDATE]])
    rows = keyed(docs).where(any_of).select("text", *KEY).dropDuplicates(KEY)
    found = [_matches(rows, k, kind, p, group).where(F.length("g") >= least) for k, (kind, p, group, least) in enumerate(RULES)]
    judged = _matches(rows, len(RULES), "markov", CANDIDATE, 0).where(_llr(F.col("m")) > threshold)
    return reduce(DataFrame.unionByName, [*found, judged]).select(*KEY, "rank", "kind", "start", "end", F.col("m").alias("found"))


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans), one row per input row.

    spans: kind:start:end of all spans by start, then kind as listed, comma-joined; base_sha256: of the rules' spans
    alone. Null and empty texts have none. Null and repeated ids, and repeated rows, each keep their row; an empty table
    gives no rows; other columns are ignored. DataFrame functions only.
    """
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    found = secret_spans(docs, threshold).groupBy(*KEY).agg(*counts, order.alias("all"))
    base = F.filter("all", lambda s: s["rank"] < len(RULES))
    found = found.select(*KEY, *(f"n_{k}" for k in ("assign", "access", "hex", "markov")), shown(base).alias("base"), shown(F.col("all")).alias("spans"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keyed(docs).drop("text").join(found, KEY, "left").select(
        "doc_id", none("n_assign"), none("n_access"), none("n_hex"), none("n_markov"),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
