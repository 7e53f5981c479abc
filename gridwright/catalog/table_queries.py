"""Reading, writing, projections and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.catalog.base import (
    GAP_KEYS_SQL, GAP_SQL, LANG_FEATURES, LANG_SQL, LINE_KEYS, gapped, languages, query, r4, table,
)
from gridwright.functions.columns import categorical_columns, numeric_columns
from gridwright.operators import preprocess as R
from gridwright.operators import profile as P
from gridwright.plans import scoring
from gridwright.session import scratch_path
from gridwright.sources import tables as S

CUSTOMER_SQL = """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"""


def _customer_text(spark, sf, sep: str) -> str:
    """The customer table as CSV with ``NA`` for missing balances."""
    path = scratch_path(spark, "customer-csv")
    balance = F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_acctbal").cast("string"))
    table(spark, sf, "customer").withColumn("c_acctbal", balance).write.option("header", True).option(
        "sep", sep).csv(path)
    return path


@query("s01_read_csv", CUSTOMER_SQL)
def _(spark, sf):
    return S.read_table(spark, _customer_text(spark, sf, ","))


@query("s02_read_delimited", CUSTOMER_SQL)
def _(spark, sf):
    return S.read_table(spark, _customer_text(spark, sf, ";"), sep=";")


@query("s03_read_scoring_batch", CUSTOMER_SQL.replace("CAST(c_nationkey AS BIGINT) AS", ""))
def _(spark, sf):
    training = table(spark, sf, "customer").schema
    return S.read_scoring(spark, _customer_text(spark, sf, ","), training)


def _round_trip(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    S.write_csv(df, path)
    return S.read_table(df.sparkSession, path)


@query("s04_write_predictions", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  l_extendedprice AS prediction FROM lineitem""")
def _(spark, sf):
    return _round_trip(table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("prediction")), "predictions")


@query("s07_columns", """SELECT CAST(p AS INTEGER) AS position, c AS "column", t AS dtype FROM (VALUES
  (0, 'event_id', 'bigint'), (1, 'ts', 'timestamp_ntz'), (2, 'user_id', 'bigint'),
  (3, 'event_type', 'string'), (4, 'value', 'double'), (5, 'props', 'string')) v(p, c, t)""")
def _(spark, sf):
    return S.columns(table(spark, sf, "events"))


INFO = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string"}


@query("s08_column_info", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype,
    '{'numerical' if t in ('bigint', 'double') else 'categorical'}' AS kind,
    count(*) - count({c}) AS n_missing, count(DISTINCT {c}) AS n_unique FROM events""" for c, t in INFO.items()))
def _(spark, sf):
    return P.column_info(table(spark, sf, "events"))


@query("p01_split_target", """SELECT 'features' AS part, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS checksum FROM events
  UNION ALL SELECT 'target', count(value), CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) FROM events""")
def _(spark, sf):
    x, y = S.split_target(table(spark, sf, "events"), "value")
    one = x.agg(F.lit("features").alias("part"), F.count("*").alias("n"), F.sum("user_id").alias("checksum"))
    two = y.agg(F.lit("target").alias("part"), F.count("value").alias("n"),
                F.sum(F.round(F.col("value") * 100).cast("long")).alias("checksum"))
    return one.unionByName(two)


@query("p02_column_kinds", """SELECT c AS "column", k AS kind, n FROM (VALUES ('event_id', 'numerical'), ('ts', 'categorical'),
  ('user_id', 'numerical'), ('event_type', 'categorical'), ('value', 'numerical'), ('props', 'categorical')) v(c, k),
  (SELECT count(*) AS n FROM events)""")
def _(spark, sf):
    df = table(spark, sf, "events")
    kinds = [(c, "numerical") for c in numeric_columns(df)] + [(c, "categorical") for c in categorical_columns(df)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for c, k in kinds])
    return df.agg(F.count("*").alias("n")).select(F.inline(cells), "n")


@query("p03_preview", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def _(spark, sf):
    return S.preview(table(spark, sf, "events"), ["event_id"], 100).select("event_id", "user_id", "event_type", "value")


@query("p04_missing_detail", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing,
    {r4(f'(count(*) - count({c})) * 100.0 / count(*)', 2)} AS pct_missing FROM g"""
    for c in ("quantity", "discount", "tax", "price", "flag", "status")
).replace("FROM g", f"FROM ({GAP_SQL}) g") + ") WHERE n_missing > 0")
def _(spark, sf):
    return P.missing_detail(gapped(spark, sf).drop(*LINE_KEYS, "cents"))


@query("p05_final_clean", f"""SELECT {GAP_KEYS_SQL}, coalesce(quantity, 0) AS quantity,
  coalesce(CASE WHEN discount = 0 THEN 0 ELSE price / discount END, 0) AS ratio FROM ({GAP_SQL})""")
def _(spark, sf):
    # a plain floating division leaves infinities and NaN behind
    d = F.col("discount")
    wild = F.when(d == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("price"), d))
    wild = F.when(d.isNull(), F.lit(float("nan"))).otherwise(wild)
    df = gapped(spark, sf).select(*LINE_KEYS, "cents", "quantity", wild.alias("ratio"))
    return R.finite(df, ["quantity", "ratio"])


@query("p06_align_scoring", """SELECT event_id, CAST(0 AS DOUBLE) AS weight,
  CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE value END AS value, CAST(user_id AS DOUBLE) AS user_id FROM events""")
def _(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(F.col("event_id") % 9 != 0, F.col("value")))
    return scoring.align(df, ["weight", "value", "user_id"], keep=["event_id"])


@query("p07_samples", """SELECT 'event_type' AS "column", rank, value FROM (
    SELECT event_type AS value, row_number() OVER (ORDER BY md5('42:' || event_id)) AS rank FROM events) WHERE rank <= 5
  UNION ALL SELECT 'user_id', rank, value FROM (
    SELECT CAST(user_id AS VARCHAR) AS value, row_number() OVER (ORDER BY md5('42:' || event_id)) AS rank
    FROM events) WHERE rank <= 5""")
def _(spark, sf):
    return P.samples(table(spark, sf, "events"), ["event_id"], ["event_type", "user_id"])


@query("d25_encode_target", f"""SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS label FROM ({LANG_SQL})""")
def _(spark, sf):
    df = languages(spark, sf).drop(*LANG_FEATURES)
    return R.encode(df, "lang", R.dictionary(df, "lang")).select("doc_id", F.col("lang").alias("label"))
