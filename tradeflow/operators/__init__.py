from . import anomaly, candles, changes, health, history, latest, ordered, quality

__all__ = ["anomaly", "candles", "changes", "health", "history", "latest", "ordered", "quality"]
