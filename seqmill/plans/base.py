"""The event log that the registered queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ["click", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: rally, event_id, rank, token, value, confidence (the share ``k`` of its properties), ts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("rally"), "event_id", rank.alias("rank"), F.col("event_type").alias("token"), "value", (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"), "ts")


LOG = """s AS (SELECT user_id AS rally, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS rank, event_type AS token, value,
    CAST(props ->> '$.k' AS DOUBLE) / 100 AS confidence, ts FROM events)"""


def spans(spark, sf_dir):
    return log(spark, sf_dir).select("rally", (F.col("rank") * 3).alias("start"), (F.col("rank") * 3 + (F.col("event_id") % 9)).alias("end"))


SPANS = "i AS (SELECT rally, rank * 3 AS start, rank * 3 + event_id % 9 AS \"end\" FROM s)"


def judged(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ["click", "error", "purchase", "signup", "view"]])
    guess = F.when(F.col("confidence") < 0.7, F.col("token")).otherwise(F.get(names, (F.col("event_id") % 5).cast("int")))
    return log(spark, sf_dir).withColumn("guess", guess)


JUDGED = "j AS (SELECT *, CASE WHEN confidence < 0.7 THEN token ELSE ['click', 'error', 'purchase', 'signup', 'view'][event_id % 5 + 1] END AS guess FROM s)"
