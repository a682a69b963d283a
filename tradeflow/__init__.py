"""Stock-trade stream and history analytics on Spark."""
