"""Similarity of texts, the leak predicate, and small string functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.spans import let, quote
from larkspan.schema import LABEL_MAPS, NULL_WORDS


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _numbered(items: Column) -> Column:
    """Items with the number of their occurrence."""
    return let(F.sort_array(items), lambda x: F.transform(x, lambda w, i: F.concat_ws("\u0002", w, (i - F.array_position(x, w)).cast("string"))))


def _clipped(a: Column, b: Column) -> Column:
    """Items of a that b holds, each as often as in the one with fewer."""
    single = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    # what one side has once at most needs no numbers
    return F.when(single, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(_numbered(a), _numbered(b))))


def rouge1(candidate: Column, reference: Column) -> Column:
    """F1 of clipped unigrams of lower-cased texts; 0 if either has none."""

    def score(a: Column, b: Column) -> Column:
        f1 = let(_clipped(a, b), lambda hit: 2.0 * hit / (F.size(a) + F.size(b)))
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(f1)

    return let(words(F.lower(candidate)), lambda a: let(words(F.lower(reference)), lambda b: score(a, b)))


def ngrams(tokens: Column, n: int) -> Column:
    # word by word: a slice copies all tokens for each gram
    grams = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.concat_ws("\u0001", *[F.get(tokens, i + k) for k in range(n)]))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def bleu4(candidate: Column, reference: Column) -> Column:
    """Geometric mean of clipped 1- to 4-gram precisions with brevity penalty; 0 if any is 0."""

    def precision(a: Column, b: Column, n: int) -> Column:
        return let(ngrams(a, n), lambda x: let(ngrams(b, n), lambda y: ratio(_clipped(x, y), F.size(x))))

    def score(a: Column, b: Column) -> Column:
        short = F.when(F.size(a) < F.size(b), F.exp(1 - F.size(b) / F.nullif(F.size(a), F.lit(0)))).otherwise(F.lit(1.0))
        parts = F.array(*[precision(a, b, n) for n in (1, 2, 3, 4)])
        mean = lambda p: F.exp(F.aggregate(p, F.lit(0.0), lambda acc, x: acc + F.log(x)) / 4)
        return let(parts, lambda p: F.when(F.forall(p, lambda x: x > 0), short * mean(p)).otherwise(F.lit(0.0)))

    return let(words(F.lower(candidate)), lambda a: let(words(F.lower(reference)), lambda b: score(a, b)))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance as a share of the longer text."""

    def score(a: Column, b: Column) -> Column:
        far = F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))
        return F.when(a == b, F.lit(0.0)).when((a == "") | (b == ""), F.lit(1.0)).otherwise(far)

    return let(a, lambda x: let(b, lambda y: score(x, y)))


def leaked(text: Column, secret: Column) -> Column:
    """Whether a text still holds a string as whole words, in any case. Where the string begins or ends with no word
    character, the word boundary asks for one beside it."""
    pattern = F.concat(F.lit("(?U)\\b"), quote(F.lower(secret)), F.lit("\\b"))
    # few texts hold the string at all: only for those is a pattern made
    held = F.coalesce(F.length(F.trim(secret)) > 0, F.lit(False)) & F.contains(F.lower(text), F.lower(secret))
    return F.when(held, F.regexp_like(F.lower(text), pattern)).otherwise(F.when(text.isNotNull(), F.lit(False)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def slug(name: Column, umlauts: bool = True) -> Column:
    s = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")) if umlauts else ():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_name(name: Column) -> Column:
    return F.translate(F.lower(name), " +[]", "_")


def plain(value: Column) -> Column:
    """Trimmed and lower-cased; words for nothing become empty."""
    s = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(s.isin(*NULL_WORDS), F.lit("")).otherwise(s)


def model_label(raw: Column, kind: str = "token_ner") -> Column:
    """A model's label without position and derivation marks, in the vocabulary; null if it has no place there."""
    base = F.regexp_replace(F.regexp_replace(raw, "^[BIES]-", ""), "deriv|part", "")
    table = F.create_map(*[F.lit(x) for pair in LABEL_MAPS[kind].items() for x in pair])
    return F.coalesce(F.try_element_at(table, base), F.try_element_at(table, F.upper(base)))


def clean_rewrite(text: Column) -> Column:
    """A model's rewriting without fences, leading announcement and enclosing quotes."""
    s = F.trim(F.regexp_replace(text, "```[a-z]*", ""))
    s = F.regexp_replace(s, r"^(?iu)\s*(?:anonymi[sz]ed|anonymisiert\w*)(?:\s+(?:text|note|notiz))?\s*:\s*", "")
    return F.trim(F.regexp_replace(s, '^"(?s)(.*)"$', "$1"))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)
