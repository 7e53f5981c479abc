"""Registration of queries with their SQL equivalents, and the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where one exists, its SQL text."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(x: str, digits: int = 4) -> str:
    """SQL report rounding, equal to ``functions.columns.r``."""
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0.0)"


# -- inputs: a frame and the same rows as SQL -------------------------------------------------

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_NUM_SQL = "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"


def line_numbers(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(*NUM)


# line items with gaps
GAP_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_discount END AS discount,
  l_tax AS tax, l_extendedprice AS price,
  CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_returnflag END AS flag,
  l_linestatus AS status FROM lineitem"""
GAP_KEYS = [*LINE_KEYS, "cents"]
GAP_KEYS_SQL = ", ".join(GAP_KEYS)


def gapped(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        F.round(c("l_extendedprice") * 100).cast("long").alias("cents"),
        F.when(c("l_orderkey") % 17 != 0, c("l_quantity")).alias("quantity"),
        F.when(c("l_partkey") % 13 != 0, c("l_discount")).alias("discount"),
        c("l_tax").alias("tax"), c("l_extendedprice").alias("price"),
        F.when(c("l_suppkey") % 11 != 0, c("l_returnflag")).alias("flag"),
        c("l_linestatus").alias("status"),
    )


# binary predictions made from the keys: label, score in [0, 1), thresholded prediction
BINARY_SQL = """SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS label,
  CAST((l_orderkey * 37 + l_linenumber * 11) % 1000 AS DOUBLE) / 1000 AS score,
  CASE WHEN (l_orderkey * 37 + l_linenumber * 11) % 1000 >= 500 THEN 1 ELSE 0 END AS prediction
  FROM lineitem"""


def binary_predictions(spark, sf) -> DataFrame:
    mix = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 1000
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("label"),
        (mix.cast("double") / 1000).alias("score"),
        F.when(mix >= 500, 1).otherwise(0).alias("prediction"),
    )


# three classes with probabilities
CLASSES = [0.0, 1.0, 2.0]
MULTI_SQL = """SELECT label, CAST(prediction AS BIGINT) AS prediction, a / t AS p0, b / t AS p1, c / t AS p2 FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
    (l_orderkey * 7 + l_linenumber) % 3 AS prediction, a, b, c, a + b + c AS t FROM (
    SELECT *, CAST(1 + (l_orderkey * 37 + l_linenumber * 11) % 100 AS DOUBLE) AS a,
      CAST(1 + (l_orderkey * 53 + l_linenumber * 17) % 100 AS DOUBLE) AS b,
      CAST(1 + (l_partkey * 29) % 100 AS DOUBLE) AS c FROM lineitem))"""


def multi_predictions(spark, sf) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    a = (1 + (k * 37 + n * 11) % 100).cast("double")
    b = (1 + (k * 53 + n * 17) % 100).cast("double")
    c = (1 + (F.col("l_partkey") * 29) % 100).cast("double")
    t = a + b + c
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("label"),
        ((k * 7 + n) % 3).cast("long").alias("prediction"),
        F.array(a / t, b / t, c / t).alias("probability"),
    )


# a regression target and a simple prediction of it
REG_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS label,
  l_extendedprice * 0.99 AS prediction FROM lineitem"""


def reg_predictions(spark, sf) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS,
        (p * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("label"),
        (p * 0.99).alias("prediction"),
    )


# documents: shares of accented letters tell the language
ACCENTS = {"fr": "éèêà", "de": "äöüß", "es": "ñáíóú"}
LANG_FEATURES = ["fr", "de", "es"]


def _share_sql(letters: str) -> str:
    return f"CASE WHEN length(text) > 0 THEN CAST(length(text) - length(translate(text, '{letters}', '')) AS DOUBLE) / length(text) ELSE 0 END"


LANG_SQL = "SELECT doc_id, lang, " + ", ".join(
    f"{_share_sql(v)} AS {k}" for k, v in ACCENTS.items()) + " FROM documents"


def languages(spark, sf) -> DataFrame:
    t = F.col("text")
    # a text without characters has share 0 of every letter
    return table(spark, sf, "documents").select(
        "doc_id", "lang",
        *[F.when(F.length(t) > 0, F.regexp_count(t, F.lit(f"[{v}]")).cast("double") / F.length(t)).otherwise(0.0).alias(k)
          for k, v in ACCENTS.items()],
    )


# line items as a model table: price, discount and tax decide the net price
NET_FEATURES = ["price", "discount", "tax", "quantity"]
NET_KEYS = GAP_KEYS
NET_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  l_extendedprice / 1000 AS price, l_discount AS discount, l_tax AS tax, l_quantity AS quantity,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) / 1000 AS net,
  CASE WHEN l_extendedprice * (1 - l_discount) * (1 + l_tax) > 40000 THEN 1.0 ELSE 0.0 END AS big
  FROM lineitem"""


def net_prices(spark, sf) -> DataFrame:
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    net = p * (1 - d) * (1 + t)
    return table(spark, sf, "lineitem").select(
        *LINE_KEYS, F.round(p * 100).cast("long").alias("cents"),
        (p / 1000).alias("price"), d.alias("discount"), t.alias("tax"),
        F.col("l_quantity").alias("quantity"), (net / 1000).alias("net"),
        F.when(net > 40000, 1.0).otherwise(0.0).alias("big"),
    )
