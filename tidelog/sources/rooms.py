"""Events of a room: what a transport delivered, with changes as base64 in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "delivery_id bigint, batch_id int, room_id string, event_id string, event_type string, content_json string, peer string, counter bigint, received_at timestamp"


def _field(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "string")


def most_used(events: DataFrame) -> tuple[str | None, str | None]:
    """(event type, payload format) that most events have, of equals the last by name: what a room is used for, for
    those who were not told."""
    read = events.select("event_type", F.try_variant_get(F.try_parse_json("content_json"), "$.format", "string").alias("f"))
    last = lambda c: read.groupBy(c).count().filter(F.col(c).isNotNull()).agg(F.max_by(c, F.struct("count", c))).first()[0]
    return last("event_type"), last("f")


def classified(events: DataFrame, event_type: str, payload_format: str) -> DataFrame:
    """``events`` with ``status`` and ``payload``: ``ok``; ``foreign_type`` and ``foreign_format`` are skipped without
    being errors, names being compared exactly; ``broken`` is content that is no JSON, lacks a format or a payload, or whose payload is no base64.
    One bad event never hides another. ``payload`` is the bytes of an ok event, else null."""
    read = events.withColumn("_v", F.try_parse_json("content_json")).withColumn("_f", _field("format")).withColumn("_p", _field("payload"))
    sound = F.col("_p").rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length("_p") % 4 == 0)
    status = (
        F.when(~F.coalesce(F.col("event_type") == event_type, F.lit(False)), "foreign_type")
        .when(F.col("_f").isNull(), "broken")
        .when(F.col("_f") != payload_format, "foreign_format")
        .when(~F.coalesce(sound, F.lit(False)), "broken")
        .otherwise("ok")
    )
    return read.withColumn("status", status).withColumn("payload", F.when(F.col("status") == "ok", F.unbase64("_p"))).drop("_v", "_f", "_p")


def content(payload: Column, form: str) -> Column:
    """The JSON content of an event that carries ``payload``."""
    return F.to_json(F.struct(F.lit(form).alias("format"), F.base64(payload).alias("payload")))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The events as a stream; files that appear later are read when they do. ``path`` is a folder, or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(EVENTS)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)
