"""Headline queries on one node; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Batch queries are
run once to warm up, then the median of three runs counts. A stream counts with
one run, start and end of the query included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from tradeflow import plans  # noqa: E402
from tradeflow.operators.candles import candle_report, candles  # noqa: E402
from tradeflow.operators.history import HistoryQuery, TimeRange, history  # noqa: E402
from tradeflow.operators.quality import normalize_trades  # noqa: E402
from tradeflow.plans.queries import event_trades, trade_stream  # noqa: E402
from tradeflow.session import local_session, work_dir  # noqa: E402
from tradeflow.sources import append_trades, read_trades  # noqa: E402
from tradeflow.streaming import state, windows  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

BATCH = [
    "history_filter",
    "history_range",
    "history_page",
    "history_summary",
    "latest_price",
    "latest_for_subscriptions",
    "tick_candles_60s",
    "tick_candles_7s",
    "candles_minute",
    "candles_hour",
    "candles_day",
    "candles_rollup",
    "candle_gaps",
    "quality_gate",
    "normalize",
    "export_json",
    "anomaly_zscore",
    "anomaly_zscore_split",
    "anomaly_jump",
    "anomaly_volume",
    "anomaly_burst",
    "anomaly_range",
    "changes_current",
]
STREAMS = ["stream_candles", "stream_dedup", "stream_zscore", "stream_subscriptions"]

# Fixed value: rows of the thirty-day history target.
MONTH_ROWS = 1_296_000


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median(run) -> float:
    run()
    return statistics.median(timed(run) for _ in range(3))


def month_of_trades(spark, rows: int):
    """The event rows repeated up to ``rows``, each copy at another time and id."""
    trades = event_trades(spark, SF_DIR, zoned=True)
    held = trades.count()
    copies = -(-rows // held)
    return (
        trades.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumn("event_time", F.col("event_time") + F.make_dt_interval(secs=F.col("copy") * 0.25))
        .withColumn("event_id", F.concat_ws("-", "event_id", "copy"))
        .drop("copy")
        .limit(rows)
    )


def candle_stream_run(spark) -> tuple[float, list[int]]:
    """Seconds of a candle stream over trades in several deliveries, and milliseconds of each batch."""
    place = work_dir(spark, "stream")
    stream = windows.candle_stream(trade_stream(spark, SF_DIR), "60 seconds", "10 minutes")
    began = time.perf_counter()
    query = state.finish(state.start(stream, f"{place}/out", f"{place}/checkpoint"))
    took = time.perf_counter() - began
    return took, sorted(p["durationMs"]["triggerExecution"] for p in query.recentProgress)


def main() -> None:
    spark = local_session(CPUS, "12g")
    found = plans.queries()
    seconds: dict[str, float] = {}
    for name in BATCH:
        seconds[name] = median(lambda: drain(found[name](spark, SF_DIR)))
    for name in STREAMS:
        seconds[name] = timed(lambda: drain(found[name](spark, SF_DIR)))

    month = work_dir(spark, "month")
    seconds["append_month"] = timed(
        lambda: append_trades(normalize_trades(month_of_trades(spark, MONTH_ROWS)), month)
    )
    few = normalize_trades(event_trades(spark, SF_DIR, zoned=True).limit(10_000)).cache()
    few.count()
    target = work_dir(spark, "append")
    seconds["append_10000"] = median(lambda: append_trades(few, target))

    table = read_trades(spark, month)
    query = HistoryQuery(duration=30 * 24 * 60)
    span = TimeRange(datetime(2024, 1, 1), datetime(2024, 1, 31))
    seconds["month_newest_1000"] = median(
        lambda: history(table, query, datetime(2024, 1, 31)).collect()
    )
    seconds["month_range_all"] = median(lambda: drain(history(table, span=span, limit=MONTH_ROWS)))
    seconds["month_candles_minute"] = median(
        lambda: drain(candle_report(candles(table, "1 minute")))
    )
    events = event_trades(spark, SF_DIR).count()
    streamed, batches = candle_stream_run(spark)
    print(
        json.dumps(
            {
                "metric": "total time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "stream_rows_per_sec": round(events / streamed),
                "micro_batch_ms": {
                    "batches": len(batches),
                    "p50": batches[len(batches) // 2],
                    "p95": batches[len(batches) * 95 // 100],
                },
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
