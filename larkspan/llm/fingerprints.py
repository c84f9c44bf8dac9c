"""Document fingerprints: SimHash with signed votes, and permuted block tables (operator 4)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.llm._keys import KEY, keyed
from larkspan.llm._shared import cut, table

_SPACE = "[\\x20\\x09-\\x0D]+"
_LANES = 0x0000000100000001
#: Radius of the search, and the rows that ask: those whose id is divisible by EACH.
RADIUS, EACH = 3, 100


def simhash(texts: DataFrame, *by: str) -> DataFrame:
    """(by..., text) -> (by..., fp) for groups of texts with words.

    Terms are neighbouring words (and a text's last word), each weighted by how often it occurs. A term's hash votes
    for its set bits and against the others; a bit is set if its votes are positive. Two bits' votes share a long, so a
    row costs 32 additions and no array of votes; rows of a text are added up before the shuffle.
    """
    w = F.split(F.lower("text"), _SPACE)
    terms = texts.select(*by, w.alias("w")).select(*by, F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))))
    hashed = terms.where("a <> ''").select(*by, F.xxhash64("a", "b").alias("t"))
    sums = [F.sum(F.shiftright("t", b).bitwiseAND(F.lit(_LANES))).alias(f"v{b}") for b in range(32)]
    votes = hashed.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    bits = []
    for b in range(32):
        for shift, count in ((b, F.col(f"v{b}").bitwiseAND(F.lit(0xFFFFFFFF))), (b + 32, F.shiftrightunsigned(f"v{b}", 32))):
            bit = 1 << shift if shift < 63 else -(1 << 63)
            bits.append(F.when(count * 2 > F.col("n"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*by, reduce(Column.bitwiseOR, bits).alias("fp"))


def shown(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint as a long), one row per input row; no words: zero."""
    rows = keyed(docs)
    fps = simhash(rows.select("h", "text", "z", "i"), *KEY)
    return rows.drop("text").join(fps, KEY, "left").select("doc_id", F.coalesce("fp", F.lit(0)).alias("fp"))


def within(queries: DataFrame, stored: DataFrame, radius: int) -> DataFrame:
    """(fp) x (fp) -> (query, fp): all stored fingerprints within the radius of each query, exactly, each pair once.

    Of radius + 2 blocks of bits, such a pair agrees on two at least. Each choice of two blocks is a table keyed by
    their bits; distinct queries look up their key in each, and the distance decides.
    """
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    masks = [a | b for a, b in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)]))
        return df.select("fp").distinct().select(F.col("fp").alias(name), keys.alias("k")).select(name, "k.t", "k.key")

    pairs = tables(queries, "query").join(tables(stored, "fp"), ["t", "key"])
    return pairs.where(F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius).select("query", "fp").distinct()


def successors(rows: DataFrame) -> DataFrame:
    """(z, i, h, n) of documents -> the same, and (nz, ni, nh): the next document by falling doc_id (null ids last, equal
    ids by a hash of their text), after the last one the first. No task holds more than a range of keys."""
    order = F.struct("z", F.bitwise_not("i").alias("r"), "h")
    keys = rows.select(*KEY, "n").dropDuplicates(KEY)
    placed = cut(keys.withColumn("o", order).repartitionByRange("o").withColumn("p", F.spark_partition_id()))
    heads = placed.groupBy("p").agg(F.min("o").alias("head"))  # a row for each partition, not for each document
    over = Window.orderBy("p")
    heads = heads.select("p", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("p").orderBy("o")
    linked = placed.withColumn("x", F.lead("o").over(inside)).join(F.broadcast(heads), "p")
    x = F.coalesce("x", "after")
    return linked.select(*KEY, "n", x["z"].alias("nz"), F.bitwise_not(x["r"]).alias("ni"), x["h"].alias("nh"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by falling doc_id. near: the share of equal bits. Null and empty texts have fingerprint zero. Rows with
    equal id and text are one document, each with its row; other equal ids follow each other by a hash of their
    text, null ids come last. An empty table gives no rows; other columns are ignored. DataFrame functions only.
    """
    rows = keyed(docs)
    chain = cut(successors(rows.select(*KEY, F.length("text").cast("long").alias("n"))))
    half = F.floor(F.col("n") / 2).cast("int")
    text = rows.select(*KEY, "text")
    by_next = chain.select(F.col("nz").alias("z"), F.col("ni").alias("i"), F.col("nh").alias("h"), F.col("z").alias("pz"), F.col("i").alias("pi"), F.col("h").alias("ph"), "n")
    tails = text.join(by_next, KEY).select(F.col("pz").alias("z"), F.col("pi").alias("i"), F.col("ph").alias("h"), F.substring("text", F.lit(1), half).alias("tail"), half.alias("half"))
    both = text.join(tails.dropDuplicates(KEY), KEY).dropDuplicates(KEY)
    edited = F.concat(F.substring("text", F.lit(1), (F.length("text") - F.col("half")).cast("int")), F.col("tail"))
    made = both.select(*KEY, edited.alias("text"))
    fps = cut(simhash(text, *KEY))
    new = simhash(made, *KEY).withColumnRenamed("fp", "efp")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    after = fps.select(F.col("z").alias("nz"), F.col("i").alias("ni"), F.col("h").alias("nh"), F.col("fp").alias("nfp"))
    told = chain.join(fps, KEY, "left").join(after, ["nz", "ni", "nh"], "left").join(new, KEY, "left")
    told = told.join(made.select(*KEY, F.sha2("text", 256).alias("edited_sha256")), KEY)
    told = told.select(*KEY, F.col("n").alias("n_chars"), "edited_sha256", zero("fp").alias("fp"), zero("efp").alias("efp"), zero("nfp").alias("nfp"))
    return rows.select("doc_id", *KEY).join(told, KEY).select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )


def counts_within(docs: DataFrame, radius: int = RADIUS, each: int = EACH) -> DataFrame:
    """(doc_id, fingerprint, ...) -> the same and n_within: for rows whose id is divisible by `each`, how many rows of the
    table have a fingerprint within the radius, themselves included; null for other rows. The search is within(): exact,
    over all rows, through the permuted block tables; equal fingerprints are looked up once."""
    fp = F.conv("fingerprint", 16, -10).cast("long")
    rows = cut(docs.withColumn("fp__key", fp))
    stored = rows.groupBy(F.col("fp__key").alias("fp")).agg(F.count("*").alias("n"))
    asked = rows.where(F.pmod("doc_id", F.lit(each)) == 0).select(F.col("fp__key").alias("fp"))
    near = within(asked, stored, radius).join(stored, "fp").groupBy(F.col("query").alias("fp__key")).agg(F.sum("n").alias("n_within"))
    out = rows.join(near, "fp__key", "left")
    return out.select(*docs.columns, F.when(F.pmod("doc_id", F.lit(each)) == 0, F.col("n_within")).alias("n_within"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_within(edited_fingerprints(table(spark, sf_dir, "documents")))
