"""Readers."""

from tickbars.sources.deals import read_deals_csv, read_deals_jdbc
from tickbars.sources.ledger import read_ledger
from tickbars.sources.messages import read_messages, stream_messages
from tickbars.sources.ranges import cut_points, range_predicates

__all__ = ["cut_points", "range_predicates", "read_deals_csv", "read_deals_jdbc", "read_ledger", "read_messages", "stream_messages"]
