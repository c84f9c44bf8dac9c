"""Notes with gold spans known by construction, from customers and nations, and predictions that err by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import spans as S
from larkspan.functions.rows import spread
from larkspan.schema import SPANS

TAIL = ", Ende."


def _digits(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def segments() -> list[tuple[str, Column, str]]:
    """(words before, value, label) in their order."""
    k = F.col("c_custkey")
    day = F.concat_ws(".", _digits(k % 28 + 1, 2), _digits(k % 12 + 1, 2), (k % 25 + 2000).cast("string"))
    phone = F.concat_ws(" ", F.lit("079"), _digits(k % 1000, 3), _digits(k % 97, 2), _digits(k % 89, 2))
    iban = F.concat_ws(" ", F.concat(F.lit("CH"), _digits(k % 90 + 10, 2)), F.lit("0076"), _digits(k % 10000, 4), _digits(k * 7 % 10000, 4), _digits(k * 13 % 10000, 4), (k % 10).cast("string"))
    return [
        ("Tel mit ", F.col("c_name"), "PER"),
        (" aus ", F.col("n_name"), "LOC"),
        (", Limite ", F.concat(F.lit("CHF "), F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")), "MONEY"),
        (", Termin ", day, "DATE"),
        (", Mail ", F.concat(F.lit("kunde"), k.cast("string"), F.lit("@bank.ch")), "EMAIL"),
        (", Tel. ", phone, "PHONE"),
        (", IBAN ", iban, "IBAN"),
    ]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, meta_temp, text, entities)."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    rows = spread(customers, "c_custkey").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    # written out by column and not as one fold over the segments, so that Spark compiles it
    rows = rows.select("c_custkey", *[v.alias(f"v{i}") for i, (_, v, _) in enumerate(segments())])
    starts, ends, at = [], [], F.lit(0)
    for i, (head, _, _) in enumerate(segments()):
        starts.append(at + len(head))
        ends.append(at := starts[-1] + F.length(f"v{i}"))
    text = F.concat(*[x for i, (head, _, _) in enumerate(segments()) for x in (F.lit(head), F.col(f"v{i}"))], F.lit(TAIL))
    entities = F.array(*[S.span(starts[i], ends[i], F.lit(label), F.col(f"v{i}")) for i, (_, _, label) in enumerate(segments())]).cast(SPANS)
    stratum = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return rows.select(F.col("c_custkey").alias("id"), stratum.alias("meta_temp"), text.alias("text"), entities.alias("entities"))


def predicted() -> Column:
    """Of a note's gold spans, every 7th goes, every 5th starts late, every 11th is an ORG; some notes begin with a span
    that is none."""
    m = lambda i: F.col("id") + i * 5
    numbered = F.transform("entities", lambda e, i: F.struct(e.alias("e"), i.alias("i")))
    kept = F.filter(numbered, lambda x: m(x["i"]) % 7 != 0)

    def bend(x: Column) -> Column:
        late = (m(x["i"]) % 5 == 0).cast("int")
        label = F.when(m(x["i"]) % 11 == 0, F.lit("ORG")).otherwise(x["e"]["label"])
        return S.span(x["e"]["start"] + late, x["e"]["end"], label, F.substring(x["e"]["text"], late + 1, F.length(x["e"]["text"])))

    false = F.when(F.col("id") % 13 == 0, F.array(S.span(F.lit(0), F.lit(3), F.lit("ORG"), F.lit("Tel"))).cast(SPANS)).otherwise(S.no_spans())
    return F.concat(false, F.transform(kept, bend)).cast(SPANS)


def predictions(made: DataFrame) -> DataFrame:
    """(id, entities)."""
    return made.select("id", predicted().alias("entities"))


def _sql_segments() -> str:
    k = "c_custkey"
    pad = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
    values = [
        ("Tel mit ", "c_name", "PER"),
        (" aus ", "n_name", "LOC"),
        (", Limite ", "'CHF ' || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR)", "MONEY"),
        (", Termin ", f"{pad(f'{k} % 28 + 1', 2)} || '.' || {pad(f'{k} % 12 + 1', 2)} || '.' || CAST({k} % 25 + 2000 AS VARCHAR)", "DATE"),
        (", Mail ", f"'kunde' || CAST({k} AS VARCHAR) || '@bank.ch'", "EMAIL"),
        (", Tel. ", f"'079 ' || {pad(f'{k} % 1000', 3)} || ' ' || {pad(f'{k} % 97', 2)} || ' ' || {pad(f'{k} % 89', 2)}", "PHONE"),
        (", IBAN ", f"'CH' || {pad(f'{k} % 90 + 10', 2)} || ' 0076 ' || {pad(f'{k} % 10000', 4)} || ' ' || {pad(f'{k} * 7 % 10000', 4)} || ' ' || {pad(f'{k} * 13 % 10000', 4)} || ' ' || CAST({k} % 10 AS VARCHAR)", "IBAN"),
    ]
    return " UNION ALL ".join(f"SELECT c_custkey AS id, c_custkey % 3 AS m3, {i} AS seq, '{h}' AS head, {v} AS surface, '{x}' AS label FROM customer JOIN nation ON c_nationkey = n_nationkey" for i, (h, v, x) in enumerate(values))


#: The same in DuckDB's SQL: gold (id, meta_temp, seq, label, s, e, surface), notes (id, meta_temp, text), pred (id, label, s, e).
SQL = f"""WITH seg AS ({_sql_segments()}),
gold AS (SELECT id, CASE m3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS meta_temp, seq, label, surface,
  CAST(sum(length(head) + length(surface)) OVER w - length(surface) AS INTEGER) AS s, CAST(sum(length(head) + length(surface)) OVER w AS INTEGER) AS e
  FROM seg WINDOW w AS (PARTITION BY id ORDER BY seq)),
notes AS (SELECT id, CASE m3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS meta_temp, string_agg(head || surface, '' ORDER BY seq) || '{TAIL}' AS text FROM seg GROUP BY id, m3),
pred AS (SELECT id, CASE WHEN (id + seq * 5) % 11 = 0 THEN 'ORG' ELSE label END AS label, s + CASE WHEN (id + seq * 5) % 5 = 0 THEN 1 ELSE 0 END AS s, e FROM gold WHERE (id + seq * 5) % 7 <> 0
  UNION ALL SELECT DISTINCT id, 'ORG', 0, 3 FROM gold WHERE id % 13 = 0)"""

#: Adds outcomes of strict matching: out (id, meta_temp, outcome, label, s, e, surface).
STRICT = f"""{SQL},
out AS (SELECT g.id, n.meta_temp, n.text, CASE WHEN p.id IS NULL THEN 'fn' ELSE 'tp' END AS outcome, g.label, g.s, g.e FROM gold g JOIN notes n USING (id) LEFT JOIN pred p ON p.id = g.id AND p.s = g.s AND p.e = g.e AND p.label = g.label
  UNION ALL SELECT p.id, n.meta_temp, n.text, 'fp', p.label, p.s, p.e FROM pred p JOIN notes n USING (id) LEFT JOIN gold g ON p.id = g.id AND p.s = g.s AND p.e = g.e AND p.label = g.label WHERE g.id IS NULL)"""
