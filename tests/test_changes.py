import json
import random

from conftest import trade
from tradeflow.operators.changes import apply_changes, bootstrap, without_copies
from tradeflow.schema import TRADE_COLUMNS
from tradeflow.sources import parse_changes, split_changes


def _image(number, price="10.5"):
    row = dict(zip(TRADE_COLUMNS, trade(number, number)))
    return {**row, "event_time": row["event_time"].isoformat() + "Z", "price": price}


def _event(op, at, before=None, after=None):
    return json.dumps({"op": op, "before": before, "after": after, "ts_ms": at})


def _parse(spark, messages):
    return parse_changes(spark.createDataFrame([(m,) for m in messages], "value string"))


def _current(spark, messages):
    usable, _ = split_changes(_parse(spark, messages))
    return {r["event_id"][:8]: r["price"] for r in apply_changes(usable).collect()}


def test_order_of_arrival_does_not_matter(spark):
    messages = [
        _event("c", 1, None, _image(1)),
        _event("c", 1, None, _image(2)),
        _event("u", 2, _image(2), _image(2, 11)),
        _event("u", 2, _image(2), _image(2, 11)),
        _event("c", 1, None, _image(3)),
        _event("d", 5, _image(3), None),
        _event("r", 1, None, _image(4)),
        _event("u", 1, _image(4), _image(4, "12.25")),
    ]
    wanted = {"00000001": 10.5, "00000002": 11.0, "00000004": 12.25}
    for seed in range(4):
        random.Random(seed).shuffle(messages)
        assert _current(spark, messages) == wanted


def test_times_as_text_and_as_microseconds(spark):
    text, micros = _image(1), _image(2)
    micros["event_time"] = 1704067202000000
    usable, _ = split_changes(_parse(spark, [_event("c", 1, None, i) for i in (text, micros)]))
    times = [str(r["event_time"]) for r in apply_changes(usable).orderBy("event_id").collect()]
    assert times == ["2024-01-01 00:00:01", "2024-01-01 00:00:02"]


def test_unusable_messages_are_kept_with_a_reason(spark):
    messages = [
        None,
        "{not json",
        _event("x", 1, None, _image(1)),
        _event("c", None, None, _image(1)),
        _event("c", 1, _image(1), None),
        _event("d", 1, None, None),
        _event("c", 1, None, _image(1)),
    ]
    usable, rejected = split_changes(_parse(spark, messages))
    assert usable.count() == 1
    assert sorted(r["problem"] for r in rejected.collect()) == [
        "no event id",
        "no new row",
        "no such operation",
        "no such operation",
        "no time of change",
        "null value",
    ]
    assert {r["value"] for r in rejected.collect()} == set(messages[:-1])


def test_position_orders_changes_of_the_same_time(spark):
    rows = [(_event("u", 1, _image(1), _image(1, 20 + n)), n) for n in (3, 1, 2)]
    parsed = parse_changes(spark.createDataFrame(rows, "value string, position long"))
    assert apply_changes(split_changes(parsed)[0]).first()["price"] == 23.0


def test_bootstrap_adds_the_rows_before_the_feed(spark, make):
    table = make([trade(n, n, 10.5) for n in range(4)])
    later = [
        _event("u", 9, _image(1), _image(1, 30)),
        _event("d", 9, _image(2), None),
        _event("c", 9, None, _image(7, 70)),
    ]
    usable, _ = split_changes(_parse(spark, later))
    got = {int(r["event_id"][:8], 16): r["price"] for r in bootstrap(table, usable).collect()}
    assert got == {0: 10.5, 1: 30.0, 3: 10.5, 7: 70.0}


def test_copies_collapse_before_the_shuffle(make):
    rows = [trade(1, 1)] * 3000 + [trade(2, 2)]
    df = without_copies(make(rows).repartition(3))
    assert df.columns == TRADE_COLUMNS and df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_unreadable_values_are_rejected_by_name(spark):
    damaged = [{"price": "AbC="}, {"volume": "x"}, {"event_time": "nonsense"}, {"price": None}]
    messages = [_event("c", 1, None, {**_image(k), **change}) for k, change in enumerate(damaged)]
    usable, rejected = split_changes(_parse(spark, messages))
    found = sorted(r["problem"] for r in rejected.collect())
    assert found == ["unreadable event_time", "unreadable price", "unreadable volume"]
    assert [r["event_id"][:8] for r in usable.collect()] == ["00000003"]


def test_changes_of_one_moment_have_one_outcome(spark):
    ties = [_event("u", 7, None, _image(1, price)) for price in ("1.0", "2.0", "3.0")]
    found = {str(_current(spark, random.Random(seed).sample(ties, 3))) for seed in range(6)}
    assert len(found) == 1
    placed = [json.loads(m) | {"source": {"lsn": at}} for m, at in zip(ties, (5, 9, 7))]
    assert _current(spark, [json.dumps(m) for m in placed]) == {"00000001": 2.0}


def _bytes64(unscaled, width=None):
    import base64

    width = width or max(1, (unscaled.bit_length() + 8) // 8)
    return base64.b64encode(unscaled.to_bytes(width, "big", signed=True)).decode()


def test_binary_decimal_reads_twos_complement_of_any_width(spark):
    from decimal import Decimal, localcontext

    from pyspark.sql import functions as F

    from tradeflow.functions import binary_decimal

    rng = random.Random(3)
    numbers = [0, 1, -1, 127, 128, -128, -129, 10**37, -(10**38 - 1), 10**38 - 1, 2**127 - 1, -(2**127)]
    numbers += [rng.randrange(-(2**126), 2**126) // rng.choice([1, 10**12, 10**30]) for _ in range(60)]
    rows = [(_bytes64(n), n) for n in numbers] + [(_bytes64(n, 16), n) for n in numbers[:8]]
    rows += [("not base64!", None), ("", None), (None, None), (_bytes64(1, 17), None)]
    frame = spark.createDataFrame([(text, None if n is None else str(n)) for text, n in rows], "t string, n string")
    for scale in (0, 2, 9):
        got = frame.select("n", binary_decimal(F.col("t"), scale).alias("d")).collect()
        with localcontext() as exact:
            exact.prec = 100
            for row in got:
                fits = row.n is not None and abs(int(row.n)) < 10**38
                assert row.d == (Decimal(int(row.n)).scaleb(-scale) if fits else None), row


def test_binary_prices_are_read_and_bad_bytes_rejected(spark):
    messages = [
        _event("c", 1, None, _image(1, _bytes64(-1050))),
        _event("c", 1, None, _image(2, _bytes64(1225, 16))),
        _event("c", 1, None, _image(3, "%%%")),
        _event("c", 1, None, _image(4, _bytes64(10**40))),
    ]
    frame = spark.createDataFrame([(m,) for m in messages], "value string")
    usable, rejected = split_changes(parse_changes(frame, {"price": 2}))
    assert {r["event_id"][:8]: r["price"] for r in apply_changes(usable).collect()} == {
        "00000001": -10.5,
        "00000002": 12.25,
    }
    assert sorted(r["problem"] for r in rejected.collect()) == ["unreadable price"] * 2
