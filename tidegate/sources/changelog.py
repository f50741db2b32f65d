"""Change logs: Kafka topics or files of the same shape, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("key binary, value binary, topic string, partition int, offset bigint, "
              "timestamp timestamp")


def read_change_log(spark: SparkSession, path_or_topic: str, stream: bool = False,
                    format: str = "parquet", **options: str) -> DataFrame:
    """A log with columns ``key, value, topic, partition, offset, timestamp``.

    ``format="kafka"`` subscribes to topics (``kafka.bootstrap.servers`` and rate
    limits such as ``maxOffsetsPerTrigger`` are options); ``parquet``, ``json`` and
    ``orc`` read a folder of that shape (``maxFilesPerTrigger`` limits a stream).
    """
    reader = (spark.readStream if stream else spark.read).options(**options)
    if format == "kafka":
        frame = reader.format("kafka").option("subscribe", path_or_topic).load()
    elif format == "json":
        text = reader.format("json").schema(
            "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
        ).load(path_or_topic)
        frame = text.withColumns({"key": F.col("key").cast("binary"), "value": F.col("value").cast("binary")})
    else:
        frame = reader.format(format).schema(LOG_SCHEMA).load(path_or_topic)
    return frame.select("key", "value", "topic", "partition", "offset", "timestamp")


def read_clean_topics(validated: DataFrame, repaired: DataFrame) -> DataFrame:
    """Both clean topics as one frame; ``origin`` keeps the topic kind."""
    return validated.withColumn("origin", F.lit("validated")).unionByName(
        repaired.withColumn("origin", F.lit("repaired")), allowMissingColumns=True)
