"""Column functions against hand-made cases and plain-Python restatements on random inputs."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspan.functions import parse as P
from larkspan.functions import spans as S
from larkspan.functions import text as T
from larkspan.operators.detect import CATALOGUES
from larkspan.schema import SPANS


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def span_rows(seed, n=120):
    r = random.Random(seed)
    return [(i, [(a := r.randrange(40), a + r.randint(1, 12), r.choice(["PER", "LOC", "ORG"]), "", r.choice([0.3, 0.5, 0.5, 0.9])) for _ in range(r.randrange(9))]) for i in range(n)]


KIND = "array<struct<start:int,end:int,label:string,text:string,score:double>>"


def py_earliest(spans):
    out = []
    for e in sorted(spans, key=lambda e: (e[0], e[0] - e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def py_longest(spans):
    out = []
    for e in sorted(spans, key=lambda e: e[0]):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
        elif e[1] - e[0] > out[-1][1] - out[-1][0]:
            out[-1] = e
    return out


def py_scored(spans):
    out = []
    for e in sorted(spans, key=lambda e: (e[0], e[0] - e[1])):
        hit = next((k for k in out if min(k[1], e[1]) - max(k[0], e[0]) > 0.5 * min(k[1] - k[0], e[1] - e[0])), None)
        if hit is None:
            out.append(e)
        elif e[4] > hit[4]:
            out.remove(hit)
            out.append(e)
    return out


@pytest.mark.parametrize(("ours", "theirs"), [(S.resolve_earliest, py_earliest), (S.resolve_longest, py_longest), (S.resolve_scored, py_scored)])
def test_overlaps_match_plain_python(spark, ours, theirs):
    rows = span_rows(3)
    df = spark.createDataFrame(rows, f"id int, spans {KIND}")
    got = {r.id: [tuple(e) for e in r.v] for r in df.select("id", ours(F.col("spans"), KIND).alias("v")).collect()}
    assert got == {i: theirs(s) for i, s in rows}


def test_overlap_policies_differ_as_specified(spark):
    spans = [(0, 5, "A", "", 0.7), (3, 20, "B", "", 0.9), (20, 22, "C", "", 0.5)]
    df = spark.createDataFrame([(spans,)], f"s {KIND}")
    pick = lambda f: [e.label for e in df.select(f(F.col("s"), KIND).alias("v")).first().v]
    assert pick(S.resolve_earliest) == ["A", "C"] and pick(S.resolve_longest) == ["B", "C"] and pick(S.resolve_scored) == ["A", "B", "C"]
    df = spark.createDataFrame([([(0, 10, "A", "", 0.6), (2, 9, "B", "", 0.9)],)], f"s {KIND}")
    assert pick(S.resolve_scored) == ["B"]


TEXTS = ["", "Zürich 😀 kunde@bank.ch, +41 79 555 22 11", "CHF 1'250.00 Mio. am 1. Mai 2024 und 01.03.2025", "5kä 5k 250K, Q3 2025 in 1999", "CH93 0076 2011 6238 5295 7 079 123 45 67", "EUR 5", "\n12 USD\nMärz 2020"]


@pytest.mark.parametrize("n", range(len(CATALOGUES["base"])))
def test_found_spans_match_finditer(spark, n):
    label, pattern = CATALOGUES["base"][n]
    p = re.compile(pattern)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", S.find(F.col("t"), pattern, label).alias("v")).collect():
        assert [(e.start, e.end, e.text) for e in r.v] == [(m.start(), m.end(), m.group()) for m in p.finditer(r.t)]


def test_replacing_and_tagging(spark):
    df = spark.createDataFrame([("Herr Müller aus Bern 😀!", [(5, 11, "PER", "Müller"), (16, 20, "LOC", "Bern")])], f"t string, s {SPANS}")
    r = df.select(S.anonymize(F.col("t"), F.col("s")).alias("a"), S.mask_spans(F.col("t"), F.col("s")).alias("m"), S.tag(F.col("t"), F.col("s")).alias("x"), S.mark(F.col("t"), F.col("s")).alias("k"), S.mask_for_export(F.col("t"), F.col("s")).alias("e")).first()
    assert r.a == r.e == "Herr [PER] aus [LOC] 😀!" and r.m == "Herr ▮ aus ▮ 😀!"
    assert r.x == "Herr <PER>Müller</PER> aus <LOC>Bern</LOC> 😀!" and r.k == "Herr @@PER Müller## aus @@LOC Bern## 😀!"
    assert one(spark, S.mask_placeholders(F.lit("[PER] [ORG_12] [X] [LOC3]"))) == "▮ ▮ [X] ▮"
    assert one(spark, S.mask_strings(F.lit("Anna anna ANNAS \\E"), F.array(F.lit("anna"), F.lit("\\E")))) == "▮ ▮ ▮S ▮"


def py_raw(text, spans):
    for a, b, label, *_ in sorted(spans, key=lambda e: -e[0]):
        text = text[:a] + f"[{label}]" + text[b:]
    return text


def test_overlapping_replacement_is_as_garbled_as_slicing(spark):
    rows = [(i, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz", [e[:4] for e in s]) for i, s in span_rows(9)]
    df = spark.createDataFrame(rows, f"id int, t string, s {SPANS}")
    got = {r.id: r.v for r in df.select("id", S.anonymize(F.col("t"), F.col("s"), False).alias("v")).collect()}
    assert got == {i: py_raw(t, s) for i, t, s in rows}


def test_tags_are_parsed(spark):
    text, spans = S.parse_tags(F.lit("  Tel mit < PER > Rolf\nK </PER> in <LOC>Bern</LOC>.\n"))
    assert one(spark, text) == "Tel mit Rolf\nK in Bern."
    assert [(e.start, e.end, e.label, e.text) for e in one(spark, spans)] == [(8, 14, "PER", "Rolf\nK"), (18, 22, "LOC", "Bern")]


@pytest.mark.parametrize(("align", "texts", "want"), [
    (S.align_counts, ["Bern"], [(0, 4)]), (S.align_counts, ["Bern", "Bern"], [(0, 4), (14, 18)]), (S.align_counts, ["bern"], [(0, 4)]), (S.align_counts, ["Genf", ""], []),
    (S.align_free, ["Bern", "Bern", "Bern"], [(0, 4), (14, 18)]), (S.align_free, ["Bern, Zug", "Zug"], [(0, 9)]), (S.align_free, ["bern"], []),
    (S.align_cursor, ["Zug", "Bern"], [(6, 9), (14, 18)]), (S.align_cursor, ["und", "Zug"], [(6, 9), (10, 13)]),
])
def test_alignment(spark, align, texts, want):
    found = F.array(*[F.struct(F.lit(t).alias("text"), F.lit("LOC").alias("label")) for t in texts])
    assert [(e.start, e.end) for e in one(spark, align(F.lit("Bern, Zug und Bern"), found))] == want


def test_iob_tags(spark):
    tokens = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 4), (5, 9), (10, 13), (14, 18)]])
    tags = lambda *x: F.array(*map(F.lit, x))
    read = lambda *x: [(e.start, e.end, e.label) for e in one(spark, S.iob_spans(F.lit("Herr Rolf aus Bern"), tokens, tags(*x)))]
    assert read("B-PER", "I-PER", "O", "B-LOC") == [(0, 9, "PER"), (14, 18, "LOC")]
    assert read("I-PER", "B-PER", "I-LOC", "O") == [(5, 9, "PER"), (10, 13, "LOC")]
    assert read("O", "O", "I-LOC", "I-LOC") == []
    spans = F.array(S.span(F.lit(0), F.lit(9), F.lit("PER"), F.lit("Herr Rolf")), S.span(F.lit(14), F.lit(18), F.lit("LOC"), F.lit("Bern")))
    assert one(spark, S.iob_labels(tokens, spans)) == ["B-PER", "I-PER", "O", "B-LOC"]


@pytest.mark.parametrize(("text", "secret", "want"), [
    ("Der Inhaber Müller zahlt", "Müller", True), ("Der Inhaber Müller zahlt", "INHABER", True), ("Der Inhaber Müller zahlt", "haber", False), ("Fischerei und Lesezugriff", "Zug", False),
    ("er zahlt CHF 2.5 Mio. an", "CHF 2.5 Mio.", False), ("Tel +41 79 555 22 11.", "+41 79 555 22 11", False), ("Tel +41 79 555 22 11.", "79 555 22 11", True), ("ab[PER]cd", "PER", True), ("a b", "", False), ("x a\\Eb y", "a\\Eb", True),
])
def test_leaks(spark, text, secret, want):
    assert one(spark, T.leaked(F.lit(text), F.lit(secret))) is want


def py_bleu(c, r):
    c, r = c.lower().split(), r.lower().split()
    logs = 0.0
    for n in (1, 2, 3, 4):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
        hit = sum((a & b).values())
        if not hit:
            return 0.0
        logs += math.log(hit / sum(a.values())) / 4
    return (1.0 if len(c) >= len(r) else math.exp(1 - len(r) / len(c))) * math.exp(logs)


def py_rouge(c, r):
    a, b = Counter(c.lower().split()), Counter(r.lower().split())
    hit = sum((a & b).values())
    return 2 * hit / (sum(a.values()) + sum(b.values())) if hit else 0.0


def test_text_scores_match_plain_python(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcD") for _ in range(r.randrange(12))), " ".join(r.choice("abcd") for _ in range(r.randrange(12)))) for i in range(150)] + [(999, "a b c d e", "a b c d e"), (998, "a a b", "a b b")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for x in df.select("a", "b", T.bleu4(F.col("a"), F.col("b")).alias("bleu"), T.rouge1(F.col("a"), F.col("b")).alias("rouge")).collect():
        assert abs(x.bleu - py_bleu(x.a, x.b)) < 1e-12 and abs(x.rouge - py_rouge(x.a, x.b)) < 1e-12
    assert one(spark, T.edit_distance(F.lit("kitten"), F.lit("sitting"))) == 3 / 7
    assert one(spark, T.edit_distance(F.lit(""), F.lit("a"))) == 1.0 and one(spark, T.edit_distance(F.lit(""), F.lit(""))) == 0.0


def test_small_functions(spark):
    assert one(spark, T.slug(F.lit("Größe (LLM) + Ärger!"))) == "groesse_llm_aerger" and one(spark, T.slug(F.lit("Käse X"), False)) == "k_se_x"
    assert one(spark, T.safe_name(F.lit("Llama 3 [fs+v]"))) == "llama_3_fsv"
    assert [one(spark, T.model_label(F.lit(x))) for x in ("B-PERderiv", "I-LOCpart", "gpe", "MISC", "O")] == ["PER", "LOC", "LOC", None, None]
    assert one(spark, T.plain(F.lit(" N/A "))) == "" and one(spark, T.plain(F.lit(" Rolf "))) == "rolf"
    assert one(spark, T.clean_rewrite(F.lit('Anonymized: "Ein Kunde."'))) == "Ein Kunde."
    assert one(spark, T.preview(F.lit("x" * 201))) == "x" * 200 + "…"


@pytest.mark.parametrize(("answer", "method", "want"), [
    ("Herr @@PER Markus\nSteiner##, @@JOB CEO##", "marked", [("Markus\nSteiner", "PER"), ("CEO", "JOB")]),
    ('```json\n[{"text": "Bern", "label": "loc "}, {"text": "x", "label": "NO"}]```', "json_fallback", [("Bern", "LOC")]),
    ("<LOC>Bern</LOC> <PER>x</LOC>", "xml_fallback", [("Bern", "LOC")]), ("Bern", "failed", []), ("[broken", "failed", []), ("", "failed", []),
])
def test_marked_answers(spark, answer, method, want):
    got = one(spark, P.marked_entities(F.lit(answer)))
    assert got.method == method and [(e.text, e.label) for e in got.entities] == want


@pytest.mark.parametrize(("answer", "want"), [
    ('```json\n{"readability": 14, "meaning": 0, "hallucination": 3, "anonymization_quality": "7", "reidentification_risk": null}\n```', None),
    ("readability: 7, Meaning = 3 hallucination: 1", (7, 3, 1, None, None)), ("", (None,) * 5), ('{"readability": 5}', (5, None, None, None, None)),
])
def test_judge_answers(spark, answer, want):
    got = one(spark, P.judge_scores(F.lit(answer)))
    assert tuple(got[s] for s in P.SCORES) == (want or (10, 1, 3, 7, None))


def test_guesses_truths_and_verdicts(spark):
    g = one(spark, P.guesses(F.lit('x {"person": {"guesses": ["a", null, "b", "c", "d"], "confidence": 3, "reasoning": "r"}, "age": 4} y')))
    assert g["person"].guesses == ["a", "b", "c"] and g["person"].confidence == "3" and g["age"].guesses == [] and len(g) == 7
    t = one(spark, P.ground_truth(F.lit('{"person": ["A", " "], "organization": "none", "age": 44, "location": "N/A"}')))
    assert (t.person, t.organization, t.age, t.location) == (["A"], None, "44", None)
    v = one(spark, P.verdicts(F.lit('{"person": "match", "age": "LESS PRECISE", "location": "no match", "education": "??"}')))
    assert (v["person"], v["age"], v["location"], v["education"], v["occupation"]) == ("MATCH", "NO_MATCH", "NO_MATCH", "SKIP", "SKIP")
    assert [one(spark, P.is_placeholder(F.lit(x))) for x in ("[PER]", "Herr [PER]", "der [ORG] Meier", None, "")] == [True, True, False, True, True]
    assert one(spark, P.matches(F.lit("Markus Steiner"), F.lit("steiner"))) and not one(spark, P.matches(F.lit("unknown"), F.lit("unknown")))
    assert one(spark, P.matches_any(F.array(F.lit("A Meier"), F.lit("-")), F.array(F.lit("meier"))))


@pytest.mark.parametrize(("text", "want"), [('{"a": 1} x', {"a": 1}), ('so {"a": [1, {"b": "}"', {"a": [1, {"b": "}"}]}), ('{"a": "x\\"y"', {"a": 'x"y'}), ('{"a": [1,', {"a": [1]}), ("none", None), (None, None), ('{"a": "cut', None)])
def test_cut_off_json_is_closed(spark, text, want):
    got = one(spark, P.repaired(F.lit(text).cast("string")))
    assert (json.loads(got) if got else None) == want
