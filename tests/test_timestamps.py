"""Instants of mixed notations, against the zone database by brute force."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from inkglass.operators.timestamps import to_instants

DEVICES = [(1, "Europe/Paris"), (2, None), (3, "America/New_York"), (4, "No/Zone"), (5, "Asia/Kathmandu")]
CASES = [
    ("2024-03-01T10:00:00", 1, "2024-03-01T09:00:00.000000Z"), ("2024:03:01 10:00:00.25", 1, "2024-03-01T09:00:00.250000Z"), ("20240301T100000Z", 2, "2024-03-01T10:00:00.000000Z"), ("2024-03-31T02:30:00", 1, None), ("2024-10-27 02:30:00", 1, None),
    ("03/14/2024 1:05:00 pm", 3, "2024-03-14T17:05:00.000000Z"), ("03/04/2024 13:05", 3, None), ("04/04/2024 13:05", 3, "2024-04-04T17:05:00.000000Z"), ("1. März 2024, 10:00 Uhr", 5, "2024-03-01T04:15:00.000000Z"), ("1 mai 2024 à 10h05", 1, "2024-05-01T08:05:00.000000Z"),
    ("1700000000", 2, "2023-11-14T22:13:20.000000Z"), ("1700000000.5", 2, "2023-11-14T22:13:20.500000Z"), ("1700000000123", None, "2023-11-14T22:13:20.123000Z"), ("1700000000123456", 2, "2023-11-14T22:13:20.123456Z"), ("12345", 1, None), ("2024-02-30 10:00:00", 1, None), ("2024-01-01", 1, None),
    ("25:00", 1, None), ("2024-01-01 24:00:00", 1, None), ("", 1, None), (None, 1, None), ("2024-01-01 10:00:00", 2, None), ("2024-01-01 10:00:00", 4, None), ("2024-01-01 10:00:00", 99, None), ("TZID=Europe/Berlin:20240701T120000", 3, "2024-07-01T10:00:00.000000Z"), ("Mon, 01 Jan 2024 10:00:00 -0500", 1, "2024-01-01T15:00:00.000000Z"),
    ("01.02.2024 10:00:00 (UTC+5:45)", 1, "2024-02-01T04:15:00.000000Z"), ("2024-01-01 10:00:00 CEST", 3, "2024-01-01T08:00:00.000000Z"), ("Thu Feb  1 10:00:00 2024", 1, "2024-02-01T09:00:00.000000Z"), ("\tIMG_20240201_100000.jpg ", 1, "2024-02-01T09:00:00.000000Z"), ("Recording 1 Feb 2024 1000.m4a", 1, "2024-02-01T09:00:00.000000Z"),
    ("12/12/2024 12:00:00 am", 2, None), ("2024-01-01T10:00:00.1234567+01:00", 2, "2024-01-01T09:00:00.123456Z"), ("2024-01-01 13:00 PM", 1, None), ("x" * 20000, 1, None),
]


def run(spark, rows):
    offers = spark.createDataFrame([(i, t, d, "clash") for i, (t, d) in enumerate(rows)], "offer_id long, date_text string, device_id int, zone string")
    return {r.offer_id: r.utc for r in to_instants(offers.union(offers), spark.createDataFrame(DEVICES, "device_id int, tz_name string")).collect()}


def test_cases(spark):
    got = run(spark, [(t, d) for t, d, _ in CASES])
    assert {k: (got.get(k), CASES[k][0]) for k in range(len(CASES)) if got.get(k) != CASES[k][2]} == {}


@pytest.mark.parametrize("zone_id", [1, 3, 5])
def test_against_zone_database(spark, zone_id):
    zone = ZoneInfo(dict(DEVICES)[zone_id])
    base = datetime(2021, 1, 1)
    walls = [base + timedelta(minutes=1471 * k + k % 60) for k in range(1200)] + [datetime(2024, 3, 10, h, m) for h in range(5) for m in (0, 30)] + [datetime(2024, 11, 3, h, m) for h in range(5) for m in (0, 30)]
    got = run(spark, [(w.strftime("%Y-%m-%d %H:%M:%S"), zone_id) for w in walls])
    for k, w in enumerate(walls):
        instants = {(w.replace(tzinfo=zone, fold=f)).astimezone(timezone.utc) for f in (0, 1)}
        real = {i for i in instants if i.astimezone(zone).replace(tzinfo=None) == w}
        want = real.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(real) == 1 else None
        assert got.get(k) == want, w


def test_empty(spark):
    offers = spark.createDataFrame([], "offer_id long, date_text string, device_id int")
    assert to_instants(offers, spark.createDataFrame([], "device_id int, tz_name string")).count() == 0
