from .adapters import (
    customers_as_subscriptions,
    events_as_trades,
    lineitem_as_trades,
    orders_as_change_feed,
    orders_as_requests,
)
from .changes import parse_changes, read_changes, split_changes
from .export import export_json, export_projection
from .storage import (
    append_batch,
    append_trades,
    append_with_retry,
    compact_batches,
    read_batches,
    day_counts,
    read_trades,
    read_trades_jdbc,
)

__all__ = [
    "append_batch",
    "append_trades",
    "append_with_retry",
    "compact_batches",
    "customers_as_subscriptions",
    "events_as_trades",
    "export_json",
    "export_projection",
    "lineitem_as_trades",
    "orders_as_change_feed",
    "orders_as_requests",
    "parse_changes",
    "read_batches",
    "read_changes",
    "day_counts",
    "read_trades",
    "read_trades_jdbc",
    "split_changes",
]
