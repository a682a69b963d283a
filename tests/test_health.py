from datetime import datetime, timedelta

from conftest import START, trade
from tradeflow.operators.health import arrivals, health


def _statuses(good, **more):
    rows = health(arrivals(good, "1 hour"), "1 hour", **more).orderBy("bucket_start").collect()
    return [(r["status"], r["rejected"]) for r in rows]


def test_rejected_rows_outside_the_good_ones_are_counted(make):
    good = make([trade(0, 5400)])
    bad = make([trade(1, 60), trade(2, 3 * 3600)])
    assert _statuses(good, rejected=bad, slow="1 hour") == [("failed", 1), ("ok", 0), ("none", 0), ("failed", 1)]


def test_only_rejected_rows_mean_failed(make):
    assert _statuses(make([]), rejected=make([trade(1, 60)])) == [("failed", 1)]


def test_silence_up_to_now_is_seen(make):
    good = make([trade(0, 3599)])
    seen = _statuses(good, start=START - timedelta(hours=1), as_of=datetime(2024, 1, 1, 2, 30))
    assert [s for s, _ in seen] == ["none", "ok", "none", "none"]
