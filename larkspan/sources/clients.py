"""Models and services behind one interface: prompts go in by Arrow batches, answers come out; retries live in the client."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.parse import SCORES, loose_marks, marked_entities
from larkspan.functions.text import clean_rewrite
from larkspan.schema import ATTRIBUTES, LABELS, SPANS

Client = Callable[[str], str]


class Busy(Exception):
    """The service asks to wait."""


def retrying(call: Client, fallback: Callable[[str], str] = lambda _: "", tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> Client:
    """Tries again, after wait * n seconds where the service is busy; then the fallback."""

    def run(prompt: str) -> str:
        for n in range(1, tries + 1):
            try:
                return call(prompt)
            except Busy:
                sleep(wait * n)
            except Exception:  # any failure of a call is met by another try
                continue
        return fallback(prompt)

    return run


def rest(url: str, token: str, send: str = "text", take: str = "text", timeout: float = 60.0) -> Client:
    """A client of a JSON service with a bearer token: posts {send: prompt} and gives the answer's field. Status 429 is Busy."""

    def call(prompt: str) -> str:
        head = {"Authorization": f"Bearer {token}", "Content-Type": "application/json"}
        request = urllib.request.Request(url, json.dumps({send: prompt}).encode(), head, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())[take]
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise Busy from e
            raise

    return call


def ask(rows: DataFrame, prompt: Column, connect: Callable[[], Client], tasks: int | None = None) -> DataFrame:
    """Adds answer and seconds. connect() runs once a task; tasks caps how many ask at once."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for part in parts:
            out, took = [], []
            for p in part["prompt__"]:
                began = time.time()
                out.append(client(p or ""))
                took.append(time.time() - began)
            yield part.drop(columns="prompt__").assign(answer=out, seconds=took)

    asked = rows.withColumn("prompt__", prompt)
    asked = asked.repartition(tasks) if tasks else asked
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return asked.mapInPandas(run, f"{schema}, answer string, seconds double")


def tag_prompt(text: Column, examples: list[tuple[str, str]] = ()) -> Column:
    """Asks for the text with @@LABEL ...## around personal data."""
    head = f"Mark personal data in the text as @@LABEL words##. Labels: {', '.join(LABELS)}. Change nothing else.\n"
    shots = "".join(f"Text: {a}\nMarked: {b}\n" for a, b in examples)
    return F.concat(F.lit(head + shots + "Text: "), text, F.lit("\nMarked: "))


def rewrite_prompt(text: Column) -> Column:
    return F.concat(F.lit("Rewrite the note so that nobody can be identified; keep its meaning.\nNote: "), text, F.lit("\nRewritten: "))


def verify_prompt(text: Column, e: Column) -> Column:
    return F.concat(F.lit("Is '"), e["text"], F.lit("' personal data of kind "), e["label"], F.lit(" in this text? Answer yes or no.\n"), text)


def truth_prompt(text: Column) -> Column:
    """Asks for the attributes that a text tells of a person, as a JSON object."""
    return F.concat(F.lit(f"Which of {', '.join(ATTRIBUTES)} does the text tell? Answer with one JSON object of these keys; null or [] for what it does not tell.\nText: "), text)


def attack_prompt(anon: Column) -> Column:
    """Asks for guesses at the attributes from an anonymized text alone."""
    return F.concat(F.lit(f"The text is anonymized; marks in brackets tell nothing. From what is left, guess {', '.join(ATTRIBUTES)} as one JSON object of these keys; null or [] without a basis.\nText: "), anon)


def verdict_prompt(truth: Column, guesses: Column) -> Column:
    """Asks which guesses are right."""
    return F.concat(F.lit("For each key, is the guess right? Answer with one JSON object of MATCH, NO_MATCH, or SKIP where there is no truth.\nTruth: "), F.coalesce(truth, F.lit("{}")), F.lit("\nGuesses: "), F.coalesce(guesses, F.lit("{}")))


def judge_prompt(text: Column, anon: Column) -> Column:
    """Asks for the rubric's scores of an anonymized text."""
    return F.concat(F.lit(f"Score the anonymized text from 1 to 10 (hallucination 0 or 1) as one JSON object with {', '.join(SCORES)}, and each one's reason as <name>_reason.\nText: "), text, F.lit("\nAnonymized: "), anon)


def rewrite_with(connect: Callable[[], Client]) -> Callable[[DataFrame], DataFrame]:
    """A rewriting pipeline: prompt, answer, clean-up. (id, rewritten, seconds)"""
    return lambda docs: ask(docs.select("id", "text"), rewrite_prompt(F.col("text")), connect).select("id", clean_rewrite(F.col("answer")).alias("rewritten"), "seconds")


def replaced_by(connect: Callable[[], Client], sleep: Callable[[float], None] = time.sleep) -> Callable[[DataFrame], DataFrame]:
    """An external anonymizer, tried again where it is busy or fails; the text itself where it does not answer. (id, rewritten, seconds)"""
    return lambda docs: ask(docs.select("id", "text"), F.col("text"), lambda: retrying(connect(), lambda t: t, sleep=sleep)).select("id", F.col("answer").alias("rewritten"), "seconds")


def tagged_by(connect: Callable[[], Client]) -> Callable[[DataFrame], DataFrame]:
    """A fine-tuned tagger: marks of any label, each aligned to its first free occurrence. (id, entities, seconds)"""

    def run(docs: DataFrame) -> DataFrame:
        rows = ask(docs.select("id", "text"), F.col("text"), connect).withColumn("p", loose_marks(F.col("answer")))
        return rows.select("id", S.align_free(F.col("text"), F.col("p")).alias("entities"), "seconds")

    return run


def tag_with(connect: Callable[[], Client], examples: list[tuple[str, str]] = ()) -> Callable[[DataFrame], DataFrame]:
    """A detector: prompt, answer, marks with fallbacks, alignment to the text. (id, entities, method, seconds)"""

    def run(docs: DataFrame) -> DataFrame:
        rows = ask(docs.select("id", "text"), tag_prompt(F.col("text"), examples), connect).withColumn("m", marked_entities(F.col("answer")))
        return rows.select("id", S.align_counts(F.col("text"), F.col("m.entities")).alias("entities"), F.col("m.method").alias("method"), "seconds")

    return run


def verified(found: DataFrame, docs: DataFrame, connect: Callable[[], Client]) -> DataFrame:
    """Keeps the spans that a model confirms (yes or ja); all documents stay."""
    each = found.select("id", F.posexplode("entities").alias("n", "e")).join(docs.select("id", "text"), "id")
    said = ask(each, verify_prompt(F.col("text"), F.col("e")), connect).where(F.lower(F.trim("answer")).rlike("^(yes|ja)"))
    kept = said.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).cast(SPANS).alias("entities"))
    return found.select("id").join(kept, "id", "left").withColumn("entities", F.coalesce("entities", S.no_spans()))
