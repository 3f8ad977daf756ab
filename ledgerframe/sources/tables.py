"""The canonical log over Parquet tables of events, and the dimension tables beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerframe.functions import ids

STREAM = ["stream_id"]


def by_version() -> Window:
    return Window.partitionBy("stream_id").orderBy("stream_version")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_log(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """One stream for each user, in the order of event ids; positions are ids from 1. ``by`` is the column whose
    shuffle numbers the versions: a condition on user_id reaches the scan past the first, a fold by stream_id shares that of the
    second."""
    ev, uid = table(spark, sf_dir, "events"), ids.uuid_of(F.col("user_id"))
    ev = ev.select("user_id", uid.alias("stream_uuid"), ids.typed_id(F.lit("user"), uid).alias("stream_id"), "event_id", "event_type", "ts", "value", "props")
    version = F.row_number().over(Window.partitionBy(by).orderBy("event_id")).cast("long")
    return ev.withColumn("stream_version", version).select(
        (F.col("event_id") + 1).alias("global_position"), F.lit("user").alias("stream_type"), "stream_uuid",
        "stream_id", "stream_version", "event_type", F.col("ts").alias("timestamp"),
        F.col("value").cast("decimal(18,2)").alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.lit("application/json").alias("data_content_type"), "user_id",
    )


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conversation_"), F.col("conv_id").cast("string")).alias("stream_id"), "conv_id", (F.col("turn") + 1).alias("stream_version"), "role", "text")
