"""Expressions on messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_HEADER = "eventType"


def event_header_in(headers: Column | str, allowed: Iterable[str], name: str = EVENT_HEADER) -> Column:
    """True if any header of that name has one of the allowed values."""
    # Compared as bytes: no cast per header, and text that is no UTF-8 cannot match.
    values = [F.lit(v.encode("utf-8")) for v in allowed]
    found = F.exists(
        headers, lambda h: (h["key"] == name) & h["value"].isNotNull() & h["value"].isin(*values)
    )
    return F.coalesce(found, F.lit(False))


def json_null(value: Column | str) -> Column:
    """True if the payload is the JSON literal null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.btrim(value.cast("string"), F.lit(" \t\r\n")) == "null", F.lit(False))


def status_label(success: Column | str) -> Column:
    success = F.col(success) if isinstance(success, str) else success
    return F.when(success, "OK").otherwise("FAIL")
