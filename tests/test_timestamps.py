from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from veridex.functions.timestamps import with_utc_micros

NY, BERLIN = "America/New_York", "Europe/Berlin"


def us(*a, tz="UTC", fold=0, extra=0):
    t = datetime(*a, tzinfo=ZoneInfo(tz), fold=fold)
    return int((t.astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 1_000_000 + extra


CASES = [
    ("April 10, 2008", NY, "MDY", us(2008, 4, 10)),
    ("APRIL 5 2008", NY, "MDY", us(2008, 4, 5)),
    (" \tSep 9, 2013\n", NY, "MDY", us(2013, 9, 9)),
    (" 1 April 2010, 15:07", NY, "MDY", us(2010, 4, 1, 15, 7, tz=NY)),
    ("2012-05-06", NY, "MDY", us(2012, 5, 6)),
    ("2012-05-06T07:08", NY, "MDY", us(2012, 5, 6, 7, 8, tz=NY)),
    ("2012-05-06 07:08:09", BERLIN, "DMY", us(2012, 5, 6, 7, 8, 9, tz=BERLIN)),
    ("2012-05-06T07:08:09Z", NY, "MDY", us(2012, 5, 6, 7, 8, 9)),
    ("2012-05-06T07:08:09.123456789Z", NY, "MDY", us(2012, 5, 6, 7, 8, 9, extra=123456)),
    ("2012-05-06T07:08:09.5-05:00", BERLIN, "DMY", us(2012, 5, 6, 12, 8, 9, extra=500000)),
    ("2012-05-06 07:08:09+0530", NY, "MDY", us(2012, 5, 6, 1, 38, 9)),
    ("2012-05-06 07:08:09-05", NY, "MDY", us(2012, 5, 6, 12, 8, 9)),
    ("2012-01-06T07:08:09+01:00[Europe/Berlin]", NY, "MDY", us(2012, 1, 6, 6, 8, 9)),
    ("20120506T070809Z", NY, "MDY", us(2012, 5, 6, 7, 8, 9)),
    ("1336288089", NY, "MDY", 1336288089 * 10**6),
    ("1336288089123", NY, "MDY", 1336288089123 * 10**3),
    ("1336288089123456", NY, "MDY", 1336288089123456),
    ("03/04/2012", NY, "MDY", us(2012, 3, 4)),
    ("03/04/2012", BERLIN, "DMY", us(2012, 4, 3)),
    ("2012/04/03 10:20", "Asia/Tokyo", "YMD", us(2012, 4, 3, 1, 20)),
    ("3/4/12", NY, "MDY", us(2012, 3, 4)),
    ("03/04/2012 12:05 AM", NY, "MDY", us(2012, 3, 4, 0, 5, tz=NY)),
    ("03/04/2012 12:05 PM", NY, "MDY", us(2012, 3, 4, 12, 5, tz=NY)),
    ("1-2-2013 8:16", NY, "MDY", us(2013, 1, 2, 8, 16, tz=NY)),
    ("01.02.2012 05:38", BERLIN, "DMY", us(2012, 2, 1, 5, 38, tz=BERLIN)),
    ("1. März 2014 19:27 Uhr", BERLIN, "DMY", us(2014, 3, 1, 19, 27, tz=BERLIN)),
    ("10 mars 2010 à 15:19", "Europe/Paris", "DMY", us(2010, 3, 10, 15, 19, tz="Europe/Paris")),
    ("5 août 2013 1h25", "Europe/Paris", "DMY", us(2013, 8, 5, 1, 25, tz="Europe/Paris")),
    ("Sun, 01 Apr 2012 07:00:12 -0400", BERLIN, "DMY", us(2012, 4, 1, 11, 0, 12)),
    ("April 13, 2008 2:06:07 AM EDT", NY, "MDY", us(2008, 4, 13, 6, 6, 7)),
    ("November 4, 2012 1:30:00 AM EST", NY, "MDY", us(2012, 11, 4, 6, 30)),  # the letters tell which of the two
    ("2012-11-04 01:30:00", NY, "MDY", us(2012, 11, 4, 5, 30)),  # twice: the earlier
    ("2012-03-11 02:30:00", NY, "MDY", us(2012, 3, 11, 7, 30)),  # skipped: shifted forward
    ("April 1, 2010 12:34:19 AM EST", "Australia/Sydney", "DMY", us(2010, 3, 31, 14, 34, 19)),  # letters of the site's zone
    ("2012-05-06 07:08:09", None, None, us(2012, 5, 6, 7, 8, 9)),
]
BAD = [None, "", "  ", "yesterday", "TBD", "-", "12:45", "March 2010", "0000-00-00", "2013-02-29", "2011-13-04", "31/11/2011 09:15", "February 30, 2012", "2012-04-31T10:00:00Z", "2012-05-06T25:00", "03/04/2012 13:05 PM", "x" * 100_000, "2012-05-06 07:08:09 QQQ", "\0|\\|$1"]


def test_notations(spark):
    rows = [(i, t, z, o) for i, (t, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, date string, tz string, ord string")
    got = {r.i: r.utc for r in with_utc_micros(df, "date", "tz", "ord", "utc").collect()}
    assert {CASES[i][0]: v for i, v in got.items()} == {c[0]: c[3] for c in CASES} or [(c[0], got[i], c[3]) for i, c in enumerate(CASES) if got[i] != c[3]] == []


def test_bad_values_are_null(spark):
    df = spark.createDataFrame([(t, NY, "MDY") for t in BAD], "date string, tz string, ord string")
    assert [r for r in with_utc_micros(df, "date", "tz", "ord", "utc").collect() if r.utc is not None] == []


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_session_zone_does_not_matter(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([("2012-05-06 07:08:09", NY, "MDY")], "date string, tz string, ord string")
        assert with_utc_micros(df, "date", "tz", "ord", "utc").first().utc == us(2012, 5, 6, 7, 8, 9, tz=NY)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_clashing_columns_repeats_and_empty(spark):
    df = spark.createDataFrame([("2012-05-06", NY, "MDY", 1, 2, 3)] * 2, "date string, tz string, order string, p int, row int, utc int")
    out = with_utc_micros(df, "date", "tz", "order", "utc")
    assert out.columns == ["date", "tz", "order", "p", "row", "utc"] and out.count() == 2
    assert out.where("p = 1 and row = 2").first().utc == us(2012, 5, 6)
    assert with_utc_micros(df.limit(0), "date", "tz", "order", "utc").count() == 0
