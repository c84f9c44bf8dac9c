"""Record types, the closed label vocabulary, and its small dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,text:string>"
SPANS = f"array<{SPAN}>"
SCORED = "array<struct<start:int,end:int,label:string,text:string,score:double,recognizer:string>>"

#: The label vocabulary in its tiers, sampling temperatures by stratum, the attributes of an inference attack
#: with their tiers, words for nothing, and what other vocabularies' labels are called here.
TIERS = {
    1: ["PER", "LOC", "ORG"],
    2: ["IBAN", "EMAIL", "PHONE", "DATE", "MONEY"],
    3: ["JOB", "AGE", "NATION", "EDU"],
}
LABELS = ["PER", "LOC", "ORG", "IBAN", "EMAIL", "PHONE", "DATE", "MONEY", "JOB", "AGE", "NATION", "EDU"]
ALL = "All Categories"
STRATA = {0.30: "Low", 0.70: "Medium", 0.85: "High"}
LIST_ATTRIBUTES = ("person", "organization")
ATTRIBUTES = {"person": 1, "age": 3, "location": 1, "occupation": 3, "education": 3, "nationality": 3, "organization": 1}
NULL_WORDS = ("", "unknown", "none", "null", "n/a", "-")
LABEL_MAPS = {
    "small_ner": {"PER": "PER", "PERSON": "PER", "LOC": "LOC", "GPE": "LOC", "ORG": "ORG"},
    "token_ner": {"PER": "PER", "PERSON": "PER", "LOC": "LOC", "LOCATION": "LOC", "GPE": "LOC", "ORG": "ORG", "ORGANIZATION": "ORG"},
    "registry": {
        "PERSON": "PER",
        "LOCATION": "LOC",
        "ORGANIZATION": "ORG",
        "NRP": "NATION",
        "EMAIL_ADDRESS": "EMAIL",
        "PHONE_NUMBER": "PHONE",
        "IBAN_CODE": "IBAN",
        "DATE_TIME": "DATE",
        "CH_IBAN": "IBAN",
        "CH_PHONE": "PHONE",
        "MONEY": "MONEY",
        "JOB_TITLE": "JOB",
        "AGE": "AGE",
        "NATIONALITY": "NATION",
        "EDUCATION": "EDU",
    },
}

EXPORT = "id bigint, text string, raw_text string, meta_temp string, label array<struct<start:int,end:int,text:string,labels:array<string>>>"
NOTE = f"id bigint, text string, meta_temp string, entities {SPANS}"
PREDICTION = f"id bigint, entities {SCORED}"


def label_tier(spark: SparkSession, with_all: bool = True) -> DataFrame:
    """(tier, label): every label in its tier and, if asked for, in the tier of all labels."""
    rows = [(f"Tier {k}", label) for k, labels in TIERS.items() for label in labels]
    return spark.createDataFrame(rows + [(ALL, label) for label in LABELS] * with_all, "tier string, label string")


def stratum(temperature: Column) -> Column:
    out = F.lit("Unknown")
    for value, name in STRATA.items():
        out = F.when(temperature == value, name).otherwise(out)
    return out


def known(label: Column) -> Column:
    return label.isin(*LABELS)
