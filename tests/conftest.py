import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from tradeflow.schema import TRADE_COLUMNS, TRADE_RAW  # noqa: E402
from tradeflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


START = datetime(2024, 1, 1)


def trade(number: int, seconds: float, price=10.0, ticker="AAPL", volume=1, **more):
    """One raw trade; ids look like UUIDs and sort by number."""
    row = {
        "event_time": START + timedelta(seconds=seconds),
        "event_id": f"{number:08x}-0000-0000-0000-000000000000",
        "ticker": ticker,
        "price": price,
        "volume": volume,
        "trade_type": "BUY",
        "trade_id": f"{number:08x}-1111-1111-1111-111111111111",
        "market_code": "NASDAQ",
        "currency_code": "USD",
    }
    row.update(more)
    return tuple(row[name] for name in TRADE_COLUMNS)


@pytest.fixture
def make(spark):
    def build(rows):
        return spark.createDataFrame(rows, TRADE_RAW)

    return build


@pytest.fixture
def feed_files(tmp_path):
    """Writes trades as numbered parquet files, to be streamed one per micro-batch."""
    import pandas as pd

    folder = tmp_path / "feed"
    folder.mkdir()

    def write(number: int, rows) -> str:
        frame = pd.DataFrame(rows, columns=TRADE_COLUMNS)
        frame["event_time"] = frame["event_time"].astype("datetime64[us]").dt.tz_localize("UTC")
        frame.to_parquet(folder / f"{number:04d}.parquet", index=False)
        return str(folder)

    return write


@pytest.fixture
def stream_of(spark):
    def build(folder: str):
        reader = spark.readStream.schema(TRADE_RAW).option("maxFilesPerTrigger", 1)
        return reader.parquet(folder)

    return build
