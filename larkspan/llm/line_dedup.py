"""Line dedup by winnowing over line hashes (operator 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm._keys import KEY, keyed
from larkspan.llm._shared import cut, table

#: Lines of a gram, and grams of a window: a repeated run of GRAM + WINDOW - 1 lines always shares a selected gram.
GRAM, WINDOW = 2, 2
#: Characters from which a line is a passage of its own; more than 50 words always have as many.
LONG = 100


def _selected(g: Column, window: int) -> Column:
    """Places of the grams that are the smallest of one of the windows they lie in (of fewer grams: of all)."""
    n = F.size(g)
    width = F.least(F.lit(window), n)
    lows = F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: F.array_min(F.slice(g, s, width)))
    near = lambda j: F.slice(lows, F.greatest(F.lit(1), j - window + 1), F.lit(window))
    return F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda j: F.array_contains(near(j), F.element_at(g, j)))).otherwise(F.array().cast("array<int>"))


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (z, i, h, runs): of each document with some, the lines (from 1) of its later repeated runs.

    Each selected gram is matched with its first place in the table (smallest doc_id, then hash of the text, then line)
    and the match is extended both ways over equal lines, compared by their hashes, so no pairs of copies are made. With
    `long`, every gram, selected or not, and every line of so many characters that occurs earlier is a run as it stands.
    """
    lines = F.split("text", "\n", -1)
    hashes = F.transform(lines, lambda x: F.xxhash64(x))
    some = keyed(docs).where(F.contains(F.col("text"), F.lit("\n")) | (F.length("text") >= (long or 1 << 31)))
    sizes = F.transform(lines, lambda x: F.length(x) >= long) if long else F.array().cast("array<boolean>")
    # as many parts as the session's shuffles have: what is small in bytes is heavy in work
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = cut(some.select(*KEY, hashes.alias("l"), sizes.alias("o")).repartition(parts, *KEY).dropDuplicates(KEY))
    blank = F.xxhash64(F.lit(""))
    window_of = lambda j: F.slice("l", j, F.lit(gram))
    grams = arrays.select(*KEY, "l", "o", F.when(F.size("l") >= gram, F.transform(F.sequence(F.lit(1), F.size("l") - gram + 1), lambda j: F.xxhash64(F.array_join(window_of(j).cast("array<string>"), ",")))).otherwise(F.array().cast("array<bigint>")).alias("g"))
    grams = grams.select("*", _selected(F.col("g"), window).alias("s"))
    full = lambda j: F.exists(window_of(j), lambda x: x != blank)
    place = lambda g, at, size, selected: F.struct(g.alias("g"), at.cast("int").alias("at"), F.lit(size).alias("size"), selected.alias("s"))
    if long:
        every = F.transform(F.col("g"), lambda g, p: place(g, p + 1, gram, F.array_contains("s", p + 1)))
        alone = F.transform(F.col("l"), lambda x, p: place(F.xxhash64(x, F.lit("line")), p + 1, 1, F.lit(False)))
        places = F.concat(F.filter(every, lambda x: full(x["at"])), F.filter(alone, lambda x: F.element_at("o", x["at"])))
    else:
        places = F.transform(F.filter("s", full), lambda at: place(F.element_at("g", at), at, gram, F.lit(True)))
    picked = grams.select(*KEY, F.explode(places).alias("p")).select(*KEY, "p.*")
    first = picked.groupBy("g").agg(F.min(F.struct("z", "i", "h", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("g", "f")
    met = picked.join(first, "g").where("struct(z, i, h, at) <> f")
    if long:
        met = cut(met)
    direct = met.select(*KEY, F.struct(F.col("at").alias("a"), (F.col("at") + F.col("size") - 1).alias("b")).alias("r"))
    met = met.where("s")
    shifts = met.groupBy(*KEY, F.col("f.z").alias("fz"), F.col("f.i").alias("fi"), F.col("f.h").alias("fh"), (F.col("at") - F.col("f.at")).alias("shift")).agg(F.sort_array(F.collect_set("at")).alias("at"))
    other = arrays.select(F.col("z").alias("fz"), F.col("i").alias("fi"), F.col("h").alias("fh"), F.col("l").alias("k"))
    faced = shifts.join(arrays, KEY).join(other, ["fz", "fi", "fh"])
    low, high = F.greatest(F.lit(1), F.col("shift") + 1), F.least(F.size("l"), F.size("k") + F.col("shift"))
    differ = F.filter(F.sequence(low, high), lambda p: F.element_at("l", p) != F.element_at("k", p - F.col("shift")))
    # what lies between two neighbouring differences is a run; it counts if it holds a whole selected gram
    stops = F.concat(F.array(low - 1), differ, F.array(high + 1))
    runs = F.transform(F.sequence(F.lit(1), F.size("stops") - 1), lambda q: F.struct((F.element_at("stops", q) + 1).alias("a"), (F.element_at("stops", q + 1) - 1).alias("b")))
    held = F.filter(runs, lambda r: F.exists("at", lambda p: (p >= r["a"]) & (p + (gram - 1) <= r["b"])))
    found = faced.select(*KEY, "at", stops.alias("stops")).select(*KEY, F.explode(held).alias("r"))
    found = found.unionByName(direct) if long else found
    return found.groupBy(*KEY).agg(F.collect_set("r").alias("runs"))


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, long: int | None = None) -> DataFrame:
    """The documents, all columns as they are but for text, and n_lines and n_removed (names that are taken: with __line).

    Lines end at \\n. Later copies of a run of lines go; a run of gram + window - 1 lines that occurs earlier is always
    matched, with the first place of one of its grams, and goes as far as it agrees with that place. With `long`, all of a
    run of gram lines or more that occurs anywhere earlier goes, and each line of so many characters that does, also where it
    is a whole document; without, documents of one line are left as they are. Grams of empty
    lines alone match nothing. Null texts stay null, with no lines; empty texts are one empty line. Null doc_ids rank last.
    Rows with equal id and text are one document. An empty table stays so. DataFrame functions only.
    """
    marks = repeated_runs(docs, gram, window, long)
    taken = set(docs.columns)
    names = [n if n not in taken else f"{n}__line" for n in ("n_lines", "n_removed")]
    keys = [f"{k}__key" for k in KEY]
    # document columns may be called z, i or h: the keys get names of their own
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({keys[0]: F.col("doc_id").isNull(), keys[1]: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), keys[2]: F.xxhash64(text)})
    marks = marks.select(*[F.col(k).alias(n) for k, n in zip(KEY, keys)], F.col("runs").alias("runs__key"))
    lines = F.when(F.col("text").isNotNull(), F.split(F.col("text"), "\n", -1))
    joined = own.join(marks, keys, "left")
    covered = F.flatten(F.transform("runs__key", lambda r: F.sequence(r["a"], r["b"])))
    kept = F.array_except(F.sequence(F.lit(1), F.size(lines)), covered)
    left = F.when(F.col("runs__key").isNull(), lines).otherwise(F.transform(kept, lambda p: F.element_at(lines, p)))
    count = F.coalesce(F.size(lines), F.lit(0))
    out = joined.withColumn("left__key", left)
    gone = (F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("left__key"))).cast("long")
    cols = [F.array_join("left__key", "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(count).cast("long")
    return out.select(*cols, total.alias(names[0]), gone.alias(names[1]))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), long=LONG)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
