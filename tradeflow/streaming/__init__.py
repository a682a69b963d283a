from . import anomaly, changes, sinks, state, subscriptions, windows

__all__ = ["anomaly", "changes", "sinks", "state", "subscriptions", "windows"]
