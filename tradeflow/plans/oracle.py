"""The registered queries as plain SQL, to be run by another engine."""

from __future__ import annotations

_EVENTS = """
    SELECT ts AS event_time, event_id, upper(event_type) AS ticker, value AS price,
           CAST(props->>'$.k' AS BIGINT) + 1 AS volume,
           CASE WHEN user_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS trade_type,
           'T' || CAST(event_id AS VARCHAR) AS trade_id,
           CASE user_id % 3 WHEN 0 THEN 'NASDAQ' WHEN 1 THEN 'NYSE' ELSE 'AMEX' END AS market_code,
           'USD' AS currency_code
    FROM events
"""

_LINES = """
    SELECT l_shipdate AS event_time, 'P' || CAST(l_partkey % 25 AS VARCHAR) AS ticker,
           l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS volume,
           CASE WHEN l_linestatus = 'F' THEN 'BUY' ELSE 'SELL' END AS trade_type,
           'T' || CAST(l_orderkey AS VARCHAR) AS trade_id, l_returnflag AS market_code,
           'USD' AS currency_code
    FROM lineitem
"""

_SUBSCRIPTIONS = """
    SELECT 'S' || CAST(c_custkey AS VARCHAR) AS sub_id,
           (['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW', 'NOSUCH'])[(c_custkey + shift) % 6 + 1]
               AS ticker,
           CAST(CASE WHEN shift = 1 THEN 5 ELSE c_custkey % 62 END AS INTEGER) AS tick,
           CASE WHEN shift = 1 THEN TIMESTAMP '2023-12-01' ELSE TIMESTAMP '2023-12-02' END
               AS updated_at
    FROM customer, (VALUES (0), (1)) AS shifts(shift)
"""

_REQUESTS = """
    SELECT sub_id, ticker, tick FROM (
        SELECT *, row_number() OVER (PARTITION BY sub_id ORDER BY updated_at DESC) AS place
        FROM subs WHERE tick BETWEEN 1 AND 60
    ) WHERE place = 1
"""


def _trades(body: str, **more: str) -> str:
    parts = {"trades": _EVENTS, **more}
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in parts.items()) + body


def _lines(body: str) -> str:
    return f"WITH trades AS ({_LINES}) {body}"


def _subs(body: str, **more: str) -> str:
    return _trades(body, subs=_SUBSCRIPTIONS, requests=_REQUESTS, **more)


def _bucket(time: str, seconds: int) -> str:
    """Epoch-aligned bucket start, by whole-second arithmetic."""
    second = f"CAST(floor(epoch_us({time}) / 1000000.0) AS BIGINT)"
    return f"make_timestamp(({second} - {second} % {seconds}) * 1000000)"


def _tick_candles(seconds: int) -> str:
    return (
        f" SELECT ticker, {_bucket('event_time', seconds)} AS bucket_start, max(price) AS high,"
        " min(price) AS low, count(*) AS trades FROM trades"
        " GROUP BY ticker, bucket_start"
    )


def _candles(unit: str) -> str:
    return _trades(
        f"""
        SELECT ticker, CAST(date_trunc('{unit}', event_time) AS TIMESTAMP) AS bucket_start,
               arg_min(price, (event_time, event_id)) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, (event_time, event_id)) AS close,
               CAST(sum(volume) AS BIGINT) AS volume, count(*) AS trades,
               CAST(sum(CAST(price AS DECIMAL(10,2)) * volume) AS DOUBLE) AS notional,
               round(CAST(sum(CAST(price AS DECIMAL(10,2)) * volume) AS DOUBLE) / sum(volume), 6)
                   AS vwap
        FROM trades GROUP BY ticker, date_trunc('{unit}', event_time)
        """
    )


# A tenth of the trades comes last; what the earlier ones had closed by then is late.
_MARK = "SELECT max(event_time) - INTERVAL 12 HOUR FROM trades"
_LATE = f"event_id % 10 = 0 AND event_time < ({_MARK} WHERE event_id % 10 <> 0)"


def _zscore(closed: str = "", source: str = "trades") -> str:
    frame = "(PARTITION BY ticker ORDER BY event_time, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
    return _trades(
        f"""
        SELECT 'anomaly' AS event_type, event_time, ticker, 'price_zscore' AS rule,
               round((price - mean) / deviation, 6) AS score, round(price, 6) AS price,
               round(mean, 6) AS mean, round(deviation, 6) AS deviation
        FROM (
            SELECT *, count(*) OVER {frame} AS n, avg(price) OVER {frame} AS mean,
                   stddev_samp(price) OVER {frame} AS deviation
            FROM {source}
        )
        WHERE n = 20 AND deviation > 0 AND abs((price - mean) / deviation) >= 3 {closed}
        """
    )


def _jump(closed: str = "") -> str:
    return _trades(
        f"""
        SELECT 'anomaly' AS event_type, event_time, ticker, 'price_jump' AS rule,
               round(price / previous - 1, 6) AS score, round(price, 6) AS price,
               round(previous, 6) AS previous
        FROM (
            SELECT *, lag(price) OVER (PARTITION BY ticker ORDER BY event_time, event_id) AS previous
            FROM trades
        )
        WHERE abs(price / nullif(previous, 0) - 1) >= 5 {closed}
        """
    )


def _spike(closed: str = "") -> str:
    frame = "(PARTITION BY ticker ORDER BY bucket_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    return _trades(
        f"""
        SELECT 'anomaly' AS event_type, bucket_start AS event_time, ticker,
               'volume_spike' AS rule, round(volume / mean, 6) AS score,
               CAST(volume AS DOUBLE) AS volume, round(mean, 6) AS mean
        FROM (
            SELECT *, count(*) OVER {frame} AS n, avg(volume) OVER {frame} AS mean
            FROM (
                SELECT ticker, {_bucket('event_time', 3600)} AS bucket_start,
                       CAST(sum(volume) AS BIGINT) AS volume
                FROM trades GROUP BY ALL
            )
        )
        WHERE n = 5 AND volume >= 3 * mean {closed}
        """
    )


_HOURS = (
    f"SELECT ticker, {_bucket('event_time', 3600)} AS bucket_start, count(*) AS trades,"
    " max(price) AS high, min(price) AS low FROM trades GROUP BY ticker, bucket_start"
)


def _burst(closed: str = "") -> str:
    return _trades(
        f"""
        SELECT 'anomaly' AS event_type, bucket_start AS event_time, ticker, 'burst' AS rule,
               CAST(trades AS DOUBLE) AS score, CAST(trades AS DOUBLE) AS trades,
               CAST(5 AS DOUBLE) AS "limit"
        FROM hours WHERE trades > 5 {closed}
        """,
        hours=_HOURS,
    )


def _range(closed: str = "") -> str:
    return _trades(
        f"""
        SELECT 'anomaly' AS event_type, bucket_start AS event_time, ticker, 'range' AS rule,
               round((high - low) / low, 6) AS score, round(high, 6) AS high, round(low, 6) AS low
        FROM hours WHERE (high - low) / nullif(low, 0) >= 50 {closed}
        """,
        hours=_HOURS,
    )


_ORDERS_LEFT = """
    SELECT o_orderdate AS event_time, CAST(o_orderkey AS VARCHAR) AS event_id,
           'O' || o_orderstatus AS ticker,
           CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 1
                     ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DOUBLE) AS price,
           o_custkey + 1 AS volume,
           CASE WHEN o_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS trade_type,
           'T' || CAST(o_custkey AS VARCHAR) AS trade_id, 'NYSE' AS market_code,
           'USD' AS currency_code
    FROM orders WHERE o_orderkey % 5 <> 0
"""

_ORDERS_LEFT_SIGNED = _ORDERS_LEFT.replace(
    "CAST(CASE WHEN o_orderkey % 3 = 0",
    "CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE 1 END * CAST(CASE WHEN o_orderkey % 3 = 0",
)


def _arrivals(rule: str) -> str:
    return (
        f"SELECT * FROM (SELECT {_bucket('event_time', 600)} AS bucket_start, count(*) AS n,"
        f" max(event_time) AS newest FROM trades WHERE {rule} GROUP BY bucket_start)"
    )


def _health(counts: bool, arrived: str) -> str:
    spanned = "SELECT bucket_start FROM arrived"
    if counts:
        spanned += " UNION ALL SELECT bucket_start FROM refusals"
    counted = """
        , (SELECT count(*) FROM hours WHERE trades > 5 AND hours.bucket_start = b.bucket_start)
            AS anomalies, coalesce(refused, 0) AS rejected
    """
    return _trades(
        f"""
        SELECT b.bucket_start, coalesce(n, 0) AS "rows", newest,
               (epoch_us(b.bucket_start + INTERVAL 10 MINUTE) - epoch_us(newest)) / 1000000.0
                   AS lag_seconds,
               CASE WHEN newest IS NULL AND {'refused > 0' if counts else 'false'} THEN 'failed'
                    WHEN newest IS NULL THEN 'none'
                    WHEN newest < b.bucket_start + INTERVAL 5 MINUTE THEN 'delayed'
                    ELSE 'ok' END AS status {counted if counts else ''}
        FROM (
            SELECT unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 10 MINUTE))
                AS bucket_start FROM ({spanned})
        ) AS b
        LEFT JOIN arrived ON arrived.bucket_start = b.bucket_start
        LEFT JOIN refusals ON refusals.bucket_start = b.bucket_start
        """,
        arrived=arrived,
        refusals=f"SELECT {_bucket('event_time', 600)} AS bucket_start, count(*) AS refused"
        " FROM trades WHERE price > 100 GROUP BY bucket_start",
        hours=_HOURS,
    )


def _closed(end: str, delay: str = "10 MINUTE") -> str:
    return f"{end} <= (SELECT max(event_time) - INTERVAL {delay} FROM trades)"


_HOUR_CLOSED = "AND " + _closed("bucket_start + INTERVAL 1 HOUR")


def oracle_sql() -> dict[str, str]:
    everything = (
        "event_time, event_id, ticker, price, volume, trade_type, trade_id, market_code, currency_code"
    )
    newest = "ORDER BY event_time DESC, event_id DESC LIMIT"
    latest = """
        SELECT ticker, arg_max(price, (event_time, event_id)) AS price,
               max(event_time) AS event_time, arg_max(event_id, (event_time, event_id)) AS event_id
        FROM trades GROUP BY ticker
    """
    return {
        "history_filter": _trades(
            f" SELECT {everything} FROM trades WHERE event_time >= TIMESTAMP '2024-01-11'"
            f" AND ticker = 'CLICK' AND trade_type = 'BUY' AND market_code = 'NYSE' {newest} 1000"
        ),
        "history_merged": _trades(f" SELECT {everything} FROM trades {newest} 1000"),
        "history_range": _trades(
            f" SELECT {everything} FROM trades WHERE event_time >= TIMESTAMP '2024-01-10'"
            " AND event_time < TIMESTAMP '2024-01-12'"
        ),
        "history_page": _trades(
            f" SELECT {everything} FROM trades WHERE ticker = 'VIEW' {newest} 100 OFFSET 100"
        ),
        "history_summary": _trades(
            """
            SELECT least(count(*), 1000) AS "count", count(*) AS total_count,
                   min(event_time) AS first_time, max(event_time) AS last_time,
                   min(price) AS min_price, max(price) AS max_price,
                   CAST(sum(volume) AS BIGINT) AS total_volume,
                   CAST(28800 AS INTEGER) AS duration, CAST(NULL AS VARCHAR) AS ticker,
                   'SELL' AS trade_type, CAST(NULL AS VARCHAR) AS market_code
            FROM trades WHERE event_time >= TIMESTAMP '2024-01-11' AND trade_type = 'SELL'
            """
        ),
        "preview": "SELECT least(10, count(*)) AS shown, least(10, count(*)) AS found FROM events",
        "history_stored": _trades(
            f" SELECT event_time, CAST(event_id AS VARCHAR) AS event_id, ticker, price, volume,"
            " trade_type, trade_id, market_code, currency_code FROM trades"
            " WHERE event_time >= TIMESTAMP '2024-01-10 06:00:00'"
            " AND event_time < TIMESTAMP '2024-01-12 18:00:00' AND market_code = 'AMEX'"
            " ORDER BY event_time DESC, trades.event_id DESC LIMIT 150"
        ),
        "history_newest_stored": _trades(
            " SELECT event_time, CAST(event_id AS VARCHAR) AS event_id, ticker, price, volume,"
            " trade_type, trade_id, market_code, currency_code FROM trades"
            " ORDER BY event_time DESC, trades.event_id DESC LIMIT 150"
        ),
        "append_retry": _trades(
            " SELECT event_id % 2 AS batch_id, CAST(event_time AS DATE) AS event_date,"
            " count(*) AS trades, CAST(sum(volume) AS BIGINT) AS volume FROM trades GROUP BY 1, 2"
        ),
        "export_json": _trades(
            """
            SELECT '{"event_time":"' || strftime(event_time, '%Y-%m-%dT%H:%M:%S')
                   || CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN ''
                           ELSE strftime(event_time, '.%f') END
                   || '+00:00","event_id":' || event_id || ',"ticker":"' || ticker
                   || '","price":"' || CAST(price AS DECIMAL(10,2)) || '","volume":' || volume
                   || ',"trade_type":"' || trade_type || '","trade_id":"' || trade_id
                   || '","market_code":"' || market_code || '","currency_code":"'
                   || currency_code || '"}' AS record
            FROM trades
            """
        ),
        "quality_gate": _lines(
            "SELECT CASE WHEN price > 10000 THEN 'price' ELSE '' END AS violations,"
            " count(*) AS trades FROM trades GROUP BY 1"
        ),
        "quality_gate_all": _trades(
            """
            SELECT event_id AS number, concat_ws(',',
                CASE WHEN k = 0 THEN 'event_time' END, CASE WHEN k = 1 THEN 'event_id' END,
                CASE WHEN k IN (2, 10) THEN 'ticker' END,
                CASE WHEN k IN (3, 4) OR price <= 0 OR price > 10000 THEN 'price' END,
                CASE WHEN k IN (5, 6) OR volume NOT BETWEEN 1 AND 1000000 THEN 'volume' END,
                CASE WHEN k = 7 THEN 'trade_type' END, CASE WHEN k = 8 THEN 'trade_id' END,
                CASE WHEN k = 9 THEN 'market_code' END, CASE WHEN k = 10 THEN 'currency_code' END
            ) AS violations
            FROM (SELECT *, event_id % 12 AS k FROM trades)
            """
        ),
        "normalize_rounding": _trades(
            """
            SELECT trade_id, round_even(floor(price) + CASE WHEN k % 2 = 0 THEN k / 16.0::DOUBLE
                                        ELSE k / 500.0::DOUBLE END, 2) AS price
            FROM (SELECT *, event_id % 16 AS k FROM trades)
            """
        ),
        "check_ranges": """
            SELECT l_orderkey, l_linenumber, concat_ws(',',
                CASE WHEN l_orderkey % 60 <= 15 THEN 'end' END,
                CASE WHEN l_orderkey % 60 > 45 THEN 'length' END) AS violations
            FROM lineitem
        """,
        "quality_valid": _lines("SELECT * FROM trades WHERE price <= 10000"),
        "normalize": _trades(f" SELECT {everything} FROM trades"),
        "check_requests": """
            SELECT *, concat_ws(',',
                CASE WHEN duration < 1 THEN 'duration' END,
                CASE WHEN NOT regexp_full_match(ticker, '[A-Z]+') THEN 'ticker' END,
                CASE WHEN trade_type NOT IN ('BUY', 'SELL') THEN 'trade_type' END) AS violations
            FROM (
                SELECT o_orderkey AS request_id,
                       CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 50 END AS duration,
                       CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderstatus)
                            WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus END AS ticker,
                       CASE o_orderkey % 3 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' ELSE 'HOLD' END
                            AS trade_type,
                       CASE WHEN o_orderkey % 2 = 0 THEN 'NYSE' END AS market_code
                FROM orders
            )
        """,
        "check_subscriptions": f"""
            SELECT *, CASE WHEN tick BETWEEN 1 AND 60 THEN '' ELSE 'tick' END AS violations
            FROM ({_SUBSCRIPTIONS})
        """,
        "latest_price": _trades(latest),
        "latest_for_subscriptions": _subs(
            " SELECT sub_id, 'candle_tick' AS type, requests.ticker, price AS high, price AS low,"
            " tick AS current_tick FROM requests LEFT JOIN prices ON prices.ticker = requests.ticker",
            prices=latest,
        ),
        "tick_candles_60s": _trades(_tick_candles(60)),
        "tick_candles_7s": _trades(_tick_candles(7)),
        "tick_messages": _trades(
            " SELECT bucket_start, 'candle_tick' AS type, ticker, high, low, 5 AS current_tick"
            " FROM candles",
            candles=_tick_candles(5),
        ),
        "candles_minute": _candles("minute"),
        "candles_hour": _candles("hour"),
        "candles_day": _candles("day"),
        "candles_line_day": _lines(
            "SELECT ticker, event_time AS bucket_start, max(price) AS high, min(price) AS low,"
            " count(*) AS trades FROM trades GROUP BY 1, 2"
        ),
        "candles_rollup": _candles("day"),
        "stream_rollup": "SELECT * FROM (" + _candles("day") + ") AS days WHERE bucket_start"
        " + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)",
        "candle_gaps": _trades(
            """
            SELECT b.ticker, b.bucket_start, high, low, trades
            FROM (
                SELECT ticker, unnest(generate_series(min(bucket_start), max(bucket_start),
                                                      INTERVAL 10 MINUTE)) AS bucket_start
                FROM found GROUP BY ticker
            ) AS b
            LEFT JOIN found ON found.ticker = b.ticker AND found.bucket_start = b.bucket_start
            """,
            found=_tick_candles(600),
        ),
        "candle_gap_spans": _trades(
            """
            SELECT ticker, bucket_start + INTERVAL 10 MINUTE AS gap_start,
                   next - INTERVAL 10 MINUTE AS gap_end,
                   CAST((epoch(next) - epoch(bucket_start)) / 600 - 1 AS BIGINT) AS buckets
            FROM (
                SELECT ticker, bucket_start,
                       lead(bucket_start) OVER (PARTITION BY ticker ORDER BY bucket_start) AS next
                FROM found
            )
            WHERE next > bucket_start + INTERVAL 10 MINUTE
            """,
            found=_tick_candles(600),
        ),
        "anomaly_zscore": _zscore(),
        "anomaly_zscore_split": _zscore(),
        "anomaly_null_ticker": _zscore(
            source="(SELECT * REPLACE (nullif(ticker, 'CLICK') AS ticker) FROM trades)"
        ),
        "anomaly_jump": _jump(),
        "anomaly_jump_split": _jump(),
        "anomaly_volume": _spike(),
        "anomaly_burst": _burst(),
        "anomaly_range": _range(),
        "anomaly_all": " UNION ALL ".join(
            f"SELECT event_type, event_time, ticker, rule, round(score, 6) AS score FROM ({rule})"
            for rule in (_zscore(), _jump(), _spike(), _burst(), _range())
        ),
        "anomaly_messages": _trades(
            """
            SELECT ticker,
                   'event: anomaly' || chr(10) || 'data: {"event_type":"anomaly","event_time":"'
                   || strftime(bucket_start, '%Y-%m-%dT%H:%M:%S') || '+00:00","ticker":"' || ticker
                   || '","rule":"burst","score":' || trades || '.0,"evidence":{"trades":' || trades
                   || '.0,"limit":5.0}}' || chr(10) || chr(10) AS "value"
            FROM hours
            WHERE trades > 5 AND ticker IN ('CLICK', 'VIEW')
              AND bucket_start >= TIMESTAMP '2024-01-05' AND bucket_start < TIMESTAMP '2024-01-25'
            """,
            hours=_HOURS,
        ),
        "stream_health": _health(True, _arrivals("price <= 100")),
        "changes_current": _ORDERS_LEFT,
        "changes_decimal": _ORDERS_LEFT_SIGNED,
        "changes_rejected": """
            SELECT CASE o_orderkey % 4 WHEN 1 THEN 'no time of change' WHEN 3 THEN 'null value'
                   ELSE 'no such operation' END AS problem,
                   CAST(sum(1 + CAST(o_orderkey % 3 = 0 AS INTEGER)
                            + CAST(o_orderkey % 6 = 0 AS INTEGER)
                            + CAST(o_orderkey % 5 = 0 AS INTEGER)) AS BIGINT) AS messages
            FROM orders GROUP BY 1
        """,
        "changes_bootstrap": _ORDERS_LEFT,
        "copies_removed": _trades(f" SELECT {everything} FROM trades"),
        "stream_candles": _trades(
            " SELECT * FROM candles WHERE " + _closed("bucket_start + INTERVAL 1 MINUTE"),
            candles=_tick_candles(60),
        ),
        "stream_dedup": _trades(f" SELECT {everything} FROM trades"),
        "stream_dedup_stored": _trades(f" SELECT {everything} FROM trades"),
        "stream_health_live": _trades(
            f"""
            SELECT b.bucket_start, coalesce(n, 0) AS "rows", newest,
                   (epoch_us(b.bucket_start + INTERVAL 10 MINUTE) - epoch_us(newest)) / 1000000.0
                       AS lag_seconds, coalesce(refused, 0) AS rejected,
                   CASE WHEN newest IS NULL AND refused > 0 THEN 'failed'
                        WHEN newest IS NULL THEN 'none'
                        WHEN newest < b.bucket_start + INTERVAL 5 MINUTE THEN 'delayed'
                        ELSE 'ok' END AS status
            FROM (
                SELECT unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL 10 MINUTE))
                    AS bucket_start FROM windows WHERE n > 0 OR refused > 0
            ) AS b
            LEFT JOIN windows ON windows.bucket_start = b.bucket_start
            """,
            windows=f"SELECT * FROM (SELECT {_bucket('event_time', 600)} AS bucket_start,"
            " count(*) FILTER (WHERE price <= 100) AS n,"
            " max(event_time) FILTER (WHERE price <= 100) AS newest,"
            " count(*) FILTER (WHERE price > 100) AS refused FROM trades GROUP BY bucket_start)"
            " WHERE " + _closed("bucket_start + INTERVAL 10 MINUTE"),
        ),
        "stream_subscriptions": _subs(
            f"""
            SELECT requests.ticker, tick,
                   make_timestamp((second - second % tick + tick) * 1000000) AS bucket_end,
                   count(DISTINCT sub_id) AS subscribers, max(price) AS high, min(price) AS low,
                   count(DISTINCT event_id) AS trades
            FROM requests JOIN seconds ON seconds.ticker = requests.ticker
            GROUP BY 1, 2, 3
            """,
            seconds="SELECT *, CAST(floor(epoch_us(event_time) / 1000000.0) AS BIGINT) AS second"
            " FROM trades WHERE "
            + _closed("date_trunc('second', event_time) + INTERVAL 1 SECOND"),
        ),
        "stream_latest": _trades(
            " SELECT ticker, price, event_time, CAST(event_id AS VARCHAR) AS event_id FROM prices",
            prices=latest,
        ),
        "stream_sampler": _subs(
            """
            SELECT sub_id, make_timestamp(s * 1000000) AS due, 'candle_tick' AS type,
                   requests.ticker, price AS high, price AS low, tick AS current_tick
            FROM requests JOIN (SELECT unnest(generate_series(
                    CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT),
                    CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) + 59)) AS s) AS clock
                ON s % tick = 0
            LEFT JOIN prices ON prices.ticker = requests.ticker
            """,
            prices=latest,
        ),
        "stream_changes_current": _ORDERS_LEFT,
        "stream_zscore": _zscore("AND event_time < (SELECT max(event_time) - INTERVAL 12 HOUR FROM trades)"),
        "stream_late": _zscore(f"AND event_time < ({_MARK})", f"(SELECT * FROM trades WHERE NOT ({_LATE}))"),
        "stream_late_rows": _trades(
            f"SELECT ticker, count(*) AS late FROM trades WHERE {_LATE} GROUP BY ticker"
        ),
        "stream_jump": _jump("AND event_time < (SELECT max(event_time) - INTERVAL 12 HOUR FROM trades)"),
        "stream_volume": _spike(_HOUR_CLOSED),
        "stream_burst": _burst(_HOUR_CLOSED),
        "stream_range": _range(_HOUR_CLOSED),
        "stream_arrivals": _health(
            False, _arrivals("true") + " WHERE " + _closed("bucket_start + INTERVAL 10 MINUTE")
        ),
    }
