"""Messages in the shape of Spark's Kafka source.

`fmt="kafka"` needs the spark-sql-kafka package on the class path. Files of the same columns
(`schemas.MESSAGE`) can stand in for it. Position handling is Spark's: `startingOffsets` (default
latest) applies to the first start only, afterwards the checkpoint decides, and new partitions are
found by the source. Rate limits are source options: `maxOffsetsPerTrigger` for Kafka,
`maxFilesPerTrigger` for files. A stream stops if the topic no longer holds messages that it has to read; who
would rather go on without them says `failOnDataLoss="false"`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickbars.schemas import MESSAGE

_KAFKA = {"includeHeaders": "true"}
_KAFKA_STREAM = {"startingOffsets": "latest"}


def _topics(topics: str | list[str] | None) -> dict[str, str]:
    if topics is None:
        return {}
    names = topics.split(",") if isinstance(topics, str) else topics
    return {"subscribe": ",".join(t.strip() for t in names)}


def read_messages(
    spark: SparkSession, fmt: str = "kafka", path: str | None = None, topics: str | list[str] | None = None, **options: str
) -> DataFrame:
    """Messages as a batch."""
    if fmt == "kafka":
        return spark.read.format(fmt).options(**{**_KAFKA, **_topics(topics), **options}).load()
    return spark.read.format(fmt).schema(MESSAGE).options(**options).load(path)


def stream_messages(
    spark: SparkSession, fmt: str = "kafka", path: str | None = None, topics: str | list[str] | None = None, **options: str
) -> DataFrame:
    """Messages as a stream."""
    if fmt == "kafka":
        defaults = {**_KAFKA, **_KAFKA_STREAM, **_topics(topics)}
        return spark.readStream.format(fmt).options(**{**defaults, **options}).load()
    return spark.readStream.format(fmt).schema(MESSAGE).options(**options).load(path)
