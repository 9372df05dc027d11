from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from gistmap.functions.timestamps import found_stamps, normalise_stamps, utc_micros

CASES = [
    ("2024-01-01T00:00:00Z", None, None, "2024-01-01T00:00:00.000000Z"),
    ("2024-01-01T05:30:00+05:30", None, None, "2024-01-01T00:00:00.000000Z"),
    ("2024-01-01T05:30:00.123456789+05", None, None, "2024-01-01T00:30:00.123456Z"),
    ("20240101T000000Z", None, None, "2024-01-01T00:00:00.000000Z"),
    ("2022-W02-3T07:40:30Z", None, None, "2022-01-12T07:40:30.000000Z"),
    ("2020-W53-7T00:00:00Z", None, None, "2021-01-03T00:00:00.000000Z"),
    ("2021-W53-1T00:00:00Z", None, None, ""),
    ("1656035091", "Asia/Tokyo", None, "2022-06-24T01:44:51.000000Z"),
    ("1656035091.5", None, None, "2022-06-24T01:44:51.500000Z"),
    ("1656035091123", None, None, "2022-06-24T01:44:51.123000Z"),
    ("1656035091123456", None, None, "2022-06-24T01:44:51.123456Z"),
    ("3/4/2024, 1:42:20 PM", "UTC", "en-US", "2024-03-04T13:42:20.000000Z"),
    ("03/04/2024 13:42:20", "UTC", "en-GB", "2024-04-03T13:42:20.000000Z"),
    ("03/23/2024 13:42:20", "UTC", "en-GB", ""),
    ("26.03.2023 03:20", "Europe/Berlin", None, "2023-03-26T01:20:00.000000Z"),
    ("Fri, 14 Apr 2023 14:11:58 +0530", None, None, "2023-04-14T08:41:58.000000Z"),
    ("5 dic 2023 00:20:33", "UTC", None, "2023-12-05T00:20:33.000000Z"),
    ("13. März 2023 um 06:59 Uhr", "UTC", None, "2023-03-13T06:59:00.000000Z"),
    ("Feb 21, 2025, 5:43:14\u202fAM JST", None, None, "2025-02-20T20:43:14.000000Z"),
    ("Jan 24, 2024, 10:26:33 PM CET", None, None, "2024-01-24T21:26:33.000000Z"),
    ("Nov 18, 2023 12:16 am", "UTC", None, "2023-11-18T00:16:00.000000Z"),
    ("2024-07-28 05:08:37 Europe/Madrid", None, None, "2024-07-28T03:08:37.000000Z"),
    # twice: the first; skipped: the offset before the change
    ("2023-10-29T02:30:00", "Europe/Berlin", None, "2023-10-29T00:30:00.000000Z"),
    ("2023-03-26T02:30:00", "Europe/Berlin", None, "2023-03-26T01:30:00.000000Z"),
    ("2023-02-30 10:00:00", None, None, ""),
    ("25:61", None, None, ""),
    ("0000-00-00 00:00:00", None, None, ""),
    ("   ", None, None, ""),
    ("yesterday at 5pm", None, None, ""),
    ("9" * 19 + "99", None, None, ""),
    (None, "UTC", None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, stamp string, zone string, loc string, want string")
    rows = normalise_stamps(df, "stamp", zone="zone", locale="loc").collect()
    assert [(r.stamp, r.utc) for r in rows if r.utc != r.want] == []


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_local_times_against_the_zone_database(spark, zone):
    tz = ZoneInfo(zone)
    locals_ = [datetime(2023, m, d, h, 15) for m in (3, 4, 10, 11) for d in (1, 12, 26, 29) for h in (1, 2, 3)]

    def want(t):
        # fold 0 is the first pass of a repeated hour, and the offset before the change in a gap
        return int((t.replace(tzinfo=tz, fold=0).astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))

    df = spark.createDataFrame([(t.strftime("%Y-%m-%dT%H:%M:%S"), want(t), zone) for t in locals_], "stamp string, want bigint, zone string")
    rows = utc_micros(df, "stamp", "zone", None, "got").collect()
    assert [r.stamp for r in rows if r.got != r.want] == []


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00", "x", 1)], "stamp string, utc_old string, y int")
    assert normalise_stamps(df, "stamp").columns == ["stamp", "utc_old", "y", "utc"]
    assert normalise_stamps(df.limit(0), "stamp").count() == 0


def test_found_leaves_target_notation(spark):
    c = spark.createDataFrame([(1, "2024-01-01T00:00:00Z", None, None), (2, "2024-13-01T00:00:00Z", None, None), (3, None, None, None), (4, "1656035091", None, None)], "export_id bigint, timestamp string, account_zone string, locale string")
    e = spark.createDataFrame([], "entry_id bigint, time string, account_zone string, locale string")
    assert {(r.row_id, r.utc) for r in found_stamps(c, e).collect()} == {(2, ""), (4, "2022-06-24T01:44:51.000000Z")}
