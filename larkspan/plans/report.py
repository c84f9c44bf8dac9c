"""Fixed-width text reports over small, already aggregated tables."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame, SparkSession

from larkspan.operators import judge, leakage


def percent(x: float | None, digits: int = 1) -> str:
    return "n/a" if x is None else f"{100 * x:.{digits}f} %"


def value(x: object) -> str:
    if x is None:
        return "-"
    if isinstance(x, (list, tuple)):
        return ", ".join(map(str, x)) or "-"
    return f"{x:.4f}" if isinstance(x, float) else str(x)


def wrap(text: str, width: int = 100, indent: str = "  ") -> str:
    return "\n".join(textwrap.fill(line, width, initial_indent=indent, subsequent_indent=indent) for line in text.splitlines())


def lines(df: DataFrame, title: str, order: list[str] | None = None, most: int = 1000) -> str:
    """An aggregate as a table of text. Rows beyond `most` are an error: reports are for aggregates."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate them first")
    cells = [df.columns, *[[value(x) for x in r] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    body = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells]
    rule = "-" * min(160, max(map(len, body)))
    return "\n".join([title, rule, body[0], rule, *body[1:]])


def evaluation(facts: DataFrame, pipeline: str) -> str:
    """Per-label tables of one pipeline's fact rows, by subset, matching and tier."""
    rows = facts.where(f"pipeline = '{pipeline}'").select("subset", "matching", "tier", "label", "tp", "fp", "fn", "precision", "recall", "f1")
    return lines(rows, f"Evaluation of {pipeline}", ["subset", "matching", "tier", "label"])


def leakage_report(leaks: DataFrame, pipeline: str) -> str:
    """Leaked strings of one pipeline: pooled by label and stratum, and by tier."""
    return "\n\n".join([lines(leakage.pooled(leaks), f"Leakage of {pipeline}", ["label", "meta_temp"]), lines(leakage.pooled_by_tier(leaks), "By tier", ["tier"])])


def judge_report(rows: DataFrame, pipeline: str) -> str:
    return lines(judge.score_summary(rows), f"Scores of {pipeline}", ["score"])


def attack_report(attacks: DataFrame) -> str:
    return "\n\n".join([lines(judge.attack_summary(attacks), "Inference attacks"), lines(judge.attribute_rates(attacks), "By attribute", ["pipeline", "attribute"])])


def save(text: str, path: str, spark: SparkSession) -> None:
    """A report as one text file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
