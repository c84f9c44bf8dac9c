"""Spans of code points in texts, as columns: finding, resolving overlaps, replacing, tagging and aligning them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.schema import LABELS, SPANS

MASK = "▮"
#: Stands around a match while a text is cut.
CUT = "\u0000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def no_spans(kind: str = SPANS) -> Column:
    return F.array().cast(kind)


def span(start: Column, end: Column, label: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"), text.alias("text"))


def find(text: Column, pattern: str, label: str) -> Column:
    """All matches of a Java pattern, read with Unicode classes, as spans in their order."""
    p = pattern if pattern.startswith("(?") and "U" in pattern[:6] else f"(?U){pattern}"
    # one scan gives what lies between matches and the matches by turns; where the text holds the sign itself, two do
    zipped = F.arrays_zip(F.split(text, p, -1).alias("s"), F.regexp_extract_all(text, F.lit(p), 0).alias("m"))
    scanned = F.flatten(F.transform(zipped, lambda x: F.when(x["m"].isNull(), F.array(x["s"])).otherwise(F.array(x["s"], x["m"]))))
    found = F.when(F.contains(text, F.lit(CUT)), scanned).otherwise(F.split(F.regexp_replace(text, p, f"{CUT}$0{CUT}"), CUT, -1))
    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), no_spans().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        b = acc["pos"] + F.length(x)
        out = F.when(acc["hit"], F.concat(acc["out"], F.array(span(acc["pos"], b, F.lit(label), x)))).otherwise(acc["out"])
        return F.struct(b.alias("pos"), (~acc["hit"]).alias("hit"), out.alias("out"))

    return F.when(text.rlike(p), F.aggregate(found, start, step, lambda acc: acc["out"])).otherwise(no_spans())


def ranked(spans: Column, *by: Callable[[Column], Column]) -> Column:
    """Sorted by the keys, then by the order they come in."""
    keyed = F.transform(spans, lambda e, i: F.struct(*[k(e).alias(f"k{n}") for n, k in enumerate(by)], i.alias("seq"), e.alias("e")))
    return F.transform(F.sort_array(keyed), lambda x: x["e"])


def size_of(e: Column) -> Column:
    return e["end"] - e["start"]


def overlap(a: Column, b: Column) -> Column:
    """Code points that both spans cover; touching spans share none."""
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))


def by_start(spans: Column) -> Column:
    return ranked(spans, lambda e: e["start"])


def resolve_earliest(spans: Column, kind: str = SPANS) -> Column:
    """The earliest start wins, of equal starts the longest, of equal spans the first: no kept spans overlap."""
    in_order = ranked(spans, lambda e: e["start"], lambda e: -size_of(e))
    return F.aggregate(in_order, no_spans(kind), lambda acc, e: F.when((F.size(acc) == 0) | (e["start"] >= F.get(acc, F.size(acc) - 1)["end"]), F.concat(acc, F.array(e))).otherwise(acc))


def resolve_longest(spans: Column, kind: str = SPANS) -> Column:
    """In order of their starts, a span that overlaps the last kept one replaces it if it is longer."""

    def step(acc: Column, e: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        apart = (F.size(acc) == 0) | (e["start"] >= last["end"])
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(e))
        return F.when(apart, F.concat(acc, F.array(e))).when(size_of(e) > size_of(last), longer).otherwise(acc)

    return F.aggregate(by_start(spans), no_spans(kind), step)


def resolve_scored(spans: Column, kind: str, share: float = 0.5) -> Column:
    """Spans that overlap a kept one by more than the share of the shorter: the higher score stays, on a tie the kept one."""
    in_order = ranked(spans, lambda e: e["start"], lambda e: -size_of(e))

    def step(acc: Column, e: Column) -> Column:
        hits = F.filter(acc, lambda k: overlap(k, e) > share * F.least(size_of(k), size_of(e)))

        def swap(first: Column) -> Column:
            others = F.filter(acc, lambda k, i: i + 1 != F.array_position(acc, first))
            return F.when(first.isNull(), F.concat(acc, F.array(e))).when(e["score"] > first["score"], F.concat(others, F.array(e))).otherwise(acc)

        return let(F.get(hits, F.lit(0)), swap)

    return F.aggregate(in_order, no_spans(kind), step)


def drop_overlapping(spans: Column, kept: Column) -> Column:
    """The spans that share no code point with the kept ones."""
    return F.filter(spans, lambda e: ~F.exists(kept, lambda k: (e["start"] < k["end"]) & (k["start"] < e["end"])))


def dedupe(spans: Column) -> Column:
    """Of spans with equal bounds and label, the first."""
    key = lambda e: F.struct(e["start"], e["end"], e["label"])
    first = lambda all_, keys: F.filter(all_, lambda e, i: F.array_position(keys, key(e)) == i + 1)
    return let(spans, lambda all_: let(F.transform(all_, key), lambda keys: first(all_, keys)))


def replace(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """Text with sorted, disjoint spans replaced: one pass, no offsets to carry."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        before = F.substring(text, acc["pos"] + 1, e["start"] - acc["pos"])
        return F.struct(e["end"].alias("pos"), F.concat(acc["out"], before, new(e)).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))


def replace_raw(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """Text with spans replaced from the last start to the first, overlaps and all, each in the text as it then is."""
    in_order = ranked(spans, lambda e: -e["start"])
    return F.aggregate(in_order, text, lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["start"]), new(e), F.substring(acc, e["end"] + 1, F.length(acc))))


def placeholder(e: Column) -> Column:
    return F.concat(F.lit("["), e["label"], F.lit("]"))


def anonymize(text: Column, spans: Column, resolved: bool = True) -> Column:
    return replace(text, resolve_longest(spans), placeholder) if resolved else replace_raw(text, spans, placeholder)


def mask_spans(text: Column, spans: Column, token: str = MASK) -> Column:
    return replace(text, resolve_longest(spans), lambda _: F.lit(token))


def mask_placeholders(text: Column, token: str = MASK) -> Column:
    return F.regexp_replace(text, rf"\[(?:{'|'.join(sorted(LABELS, reverse=True))})_?\d*\]", token)


def mask_strings(text: Column, strings: Column, token: str = MASK) -> Column:
    """Every occurrence of the strings, longest first, whatever their case and surroundings."""
    in_order = F.transform(F.sort_array(F.transform(F.array_distinct(strings), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda x: x["s"])
    return F.aggregate(in_order, text, lambda acc, s: F.when(s == "", acc).otherwise(F.regexp_replace(acc, F.concat(F.lit("(?iu)"), quote(s)), F.lit(token))))


def quote(s: Column) -> Column:
    """A pattern that matches the string itself."""
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def mask_for_export(text: Column, spans: Column) -> Column:
    """By falling start, a span is replaced unless it is invalid for the text as it then is, or reaches over the last start."""
    in_order = ranked(spans, lambda e: -e["start"], lambda e: -e["end"])
    start = F.struct(F.lit(2**31 - 1).alias("last"), text.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        bad = (e["start"] >= e["end"]) | (e["end"] > F.length(acc["out"])) | (e["end"] > acc["last"])
        out = F.concat(F.substring(acc["out"], F.lit(1), e["start"]), placeholder(e), F.substring(acc["out"], e["end"] + 1, F.length(acc["out"])))
        return F.struct(F.when(bad, acc["last"]).otherwise(e["start"]).alias("last"), F.when(bad, acc["out"]).otherwise(out).alias("out"))

    return F.aggregate(in_order, start, step, lambda acc: acc["out"])


def tag(text: Column, spans: Column) -> Column:
    """<LABEL>...</LABEL> around each span."""
    return replace(text, by_start(spans), lambda e: F.concat(F.lit("<"), e["label"], F.lit(">"), e["text"], F.lit("</"), e["label"], F.lit(">")))


def mark(text: Column, spans: Column) -> Column:
    """@@LABEL ...## around each span."""
    return replace(text, by_start(spans), lambda e: F.concat(F.lit("@@"), e["label"], F.lit(" "), e["text"], F.lit("##")))


def parse_tags(raw: Column) -> tuple[Column, Column]:
    """Tagged text -> (clean text, spans). Contents of tags are stripped; offsets are of the clean text."""
    p = rf"(?s)<\s*({'|'.join(LABELS)})\s*>(.*?)</\s*\1\s*>"
    pieces = let(strip(raw), lambda x: F.arrays_zip(F.split(x, p, -1).alias("s"), F.regexp_extract_all(x, F.lit(p), 1).alias("l"), F.regexp_extract_all(x, F.lit(p), 2).alias("t")))
    start = F.struct(F.lit("").alias("out"), no_spans().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        head, inner = F.concat(acc["out"], x["s"]), strip(F.coalesce(x["t"], F.lit("")))
        a = F.length(head)
        more = F.when(x["l"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span(a, a + F.length(inner), x["l"], inner))))
        return F.struct(F.concat(head, inner).alias("out"), more.alias("spans"))

    done = F.aggregate(pieces, start, step)
    return done["out"], done["spans"]


def align_counts(text: Column, found: Column) -> Column:
    """(text, label) pairs -> spans: each distinct pair takes as many occurrences as it is named, from the left, of exact
    case or else of any; bounds that an earlier pair has taken are passed over."""
    pairs = F.array_distinct(F.filter(found, lambda e: e["text"] != ""))
    start = F.struct(no_spans().alias("out"))

    def step(acc: Column, p: Column, low: Column) -> Column:
        need = F.size(F.filter(found, lambda e: (e["text"] == p["text"]) & (e["label"] == p["label"])))
        n = F.length(p["text"])
        begin = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("got"), acc["out"].alias("out"))

        def look(s: Column, _: Column) -> Column:
            exact = F.call_function("locate", p["text"], text, s["pos"])
            at = F.when(exact > 0, exact).otherwise(F.call_function("locate", F.lower(p["text"]), low, s["pos"]))
            used = F.exists(s["out"], lambda e: (e["start"] == at - 1) & (e["end"] == at - 1 + n))
            stop = (s["got"] >= need) | (at == 0) | (s["pos"] > F.length(text))
            more = F.concat(s["out"], F.array(span(at - 1, at - 1 + n, p["label"], F.substring(text, at, n))))
            taken = F.struct((at + n).alias("pos"), (s["got"] + F.when(used, 0).otherwise(1)).alias("got"), F.when(used, s["out"]).otherwise(more).alias("out"))
            return F.when(stop, s).otherwise(taken)

        # an occurrence taken by another pair costs a look: there are at most as many as spans so far
        return F.struct(F.aggregate(F.sequence(F.lit(1), need + F.size(acc["out"])), begin, look)["out"].alias("out"))

    return by_start(let(F.lower(text), lambda low: F.aggregate(pairs, start, lambda acc, p: step(acc, p, low)))["out"])


def align_free(text: Column, found: Column) -> Column:
    """Each (text, label) takes its first exact occurrence that overlaps no span taken before."""

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p["text"])
        look = lambda at: F.call_function("locate", p["text"], text, at)
        meets = lambda at: F.filter(acc, lambda e: (at - 1 < e["end"]) & (at - 1 + n > e["start"]))
        # whatever begins between a place and the end of a span it meets meets that span too
        later = lambda at, _: let(meets(at), lambda m: F.when((at > 0) & (F.size(m) > 0), look(F.array_max(F.transform(m, lambda e: e["end"])) + 1)).otherwise(at))
        tries = F.sequence(F.lit(0), F.size(acc))
        place = F.when(n > 0, F.aggregate(tries, look(F.lit(1)), later)).otherwise(F.lit(0))
        return let(place, lambda at: F.when((at == 0) | ~p["label"].isin(*LABELS), acc).otherwise(F.concat(acc, F.array(span(at - 1, at - 1 + n, p["label"], p["text"])))))

    return by_start(F.aggregate(found, no_spans(), step))


def align_cursor(text: Column, found: Column) -> Column:
    """Each (text, label) takes its next occurrence after the last one taken, or else its first; overlaps are resolved."""
    start = F.struct(F.lit(1).alias("pos"), no_spans().alias("out"))

    def step(acc: Column, p: Column) -> Column:
        n, on = F.length(p["text"]), F.call_function("locate", p["text"], text, acc["pos"])
        at = F.when(on > 0, on).otherwise(F.call_function("locate", p["text"], text, F.lit(1)))
        ok = (at > 0) & p["label"].isin(*LABELS)
        more = F.concat(acc["out"], F.array(span(at - 1, at - 1 + n, p["label"], p["text"])))
        return F.struct(F.when(ok, at + n).otherwise(acc["pos"]).alias("pos"), F.when(ok, more).otherwise(acc["out"]).alias("out"))

    return resolve_earliest(F.aggregate(found, start, step)["out"])


def iob_labels(tokens: Column, spans: Column) -> Column:
    """IOB2 label of each token (start, end): that of the span its first code point lies in."""
    holder = lambda t: F.get(F.filter(spans, lambda e: (e["start"] <= t["start"]) & (t["start"] < e["end"])), F.lit(0))
    named = lambda held: F.transform(held, lambda e, i: F.when(e.isNull(), F.lit("O")).when((i > 0) & (F.get(held, i - 1) == e), F.concat(F.lit("I-"), e["label"])).otherwise(F.concat(F.lit("B-"), e["label"])))
    return let(F.transform(tokens, holder), named)


def iob_spans(text: Column, tokens: Column, tags: Column) -> Column:
    """IOB2 tags of tokens -> spans. An inside tag of another label starts a span if one is open, else it is skipped."""
    start = F.struct(no_spans().alias("out"), F.lit(False).alias("open"))

    def step(acc: Column, x: Column) -> Column:
        kind, label = F.substring(x["tag"], 1, 2), F.substring(x["tag"], F.lit(3), F.length(x["tag"]))
        last = F.get(acc["out"], F.size(acc["out"]) - 1)
        new = F.concat(acc["out"], F.array(span(x["t"]["start"], x["t"]["end"], label, F.lit(""))))
        longer = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(span(last["start"], x["t"]["end"], last["label"], F.lit(""))))
        goes_on = (kind == "I-") & acc["open"]
        out = F.when(kind == "B-", new).when(goes_on & (last["label"] == label), longer).when(goes_on, new).otherwise(acc["out"])
        return F.struct(out.alias("out"), ((kind == "B-") | goes_on).alias("open"))

    done = F.aggregate(F.arrays_zip(tokens.alias("t"), tags.alias("tag")), start, step)["out"]
    return F.transform(done, lambda e: span(e["start"], e["end"], e["label"], F.substring(text, e["start"] + 1, e["end"] - e["start"])))


def tokens(text: Column) -> Column:
    """White-space tokens as (start, end)."""
    return F.transform(find(text, r"\S+", "O"), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))


def context(text: Column, e: Column, reach: int) -> Column:
    """The span with `reach` code points on either side, on one line."""
    a = F.greatest(F.lit(0), e["start"] - reach)
    return F.translate(F.substring(text, a + 1, F.least(F.length(text), e["end"] + reach) - a), "\n", " ")
