"""Stream topologies: parsing, exactly-once stamps, stamp joins, snapshot sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.functions.detection import stamp_ns
from voxelar.sources.readers import PAYLOAD


def payload_stream(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Payloads with ``stamp_ns`` and event time ``ts``, and the messages that are broken or lack a stamp."""
    parsed = raw.withColumn("p", F.from_json(F.col(value).cast("string"), PAYLOAD))
    parsed = parsed.withColumn("stamp_ns", stamp_ns(F.col("p.stamp_sec"), F.col("p.stamp_nanosec")))
    good = parsed.where("stamp_ns is not null").select("p.*", "stamp_ns", F.timestamp_micros(F.floor(F.col("stamp_ns") / 1000)).alias("ts"))
    return good, parsed.where("stamp_ns is null").select(value)


def once(stream: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Each stamp once while the watermark remembers it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["stamp_ns"])


def stamped_pairs(clouds: DataFrame, metadata: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Clouds and metadata of exactly equal stamps, each stamp once; what stays unmatched leaves with the watermark."""
    a, b = once(clouds, delay).alias("a"), once(metadata, delay).alias("b")
    same = (F.col("a.stamp_ns") == F.col("b.stamp_ns")) & (F.col("a.ts") == F.col("b.ts"))
    return a.join(b, same).select("a.*", *[F.col(f"b.{c}").alias(f"meta_{c}") for c in metadata.columns if c not in ("stamp_ns", "ts")])


def snapshots(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``sink``, which must be safe to repeat for a batch number."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
