"""Writing messages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_messages(messages: DataFrame, fmt: str = "kafka", path: str | None = None, **options: str) -> None:
    """Messages to Kafka (`topic` as column or option) or to files of the same columns."""
    if fmt == "kafka":
        options = {"includeHeaders": "true", **options}
    messages.write.format(fmt).mode("append").options(**options).save(path)
