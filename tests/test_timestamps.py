import datetime as dt
import random
from zoneinfo import ZoneInfo, available_timezones

from labelloom.operators.timestamps import normalize_timestamps, zone_intervals

UTC = dt.timezone.utc


def at(*parts, **kw):
    return int(dt.datetime(*parts, tzinfo=UTC).timestamp()) - kw.get("off", 0)


CASES = [
    ("2024-03-05T06:07:08Z", None, None, at(2024, 3, 5, 6, 7, 8), "exact"),
    ("2024-03-05T06:07:08.123456", None, None, at(2024, 3, 5, 6, 7, 8), "resolved"),
    ("2024-03-05 06:07:08 -05:00", "Asia/Tokyo", None, at(2024, 3, 5, 11, 7, 8), "exact"),
    ("20240305060708+0530", None, None, at(2024, 3, 5, 0, 37, 8), "exact"),
    ("202403050607", "America/New_York", None, at(2024, 3, 5, 11, 7), "resolved"),
    ("20240305", "Asia/Kolkata", None, at(2024, 3, 4, 18, 30), "resolved"),
    ("1709618828", None, None, 1709618828, "exact"),
    ("1709618828999", None, None, 1709618828, "exact"),
    ("03/05/2024", None, "us_portal", at(2024, 3, 5), "resolved"),
    ("03/05/2024", None, "other", at(2024, 5, 3), "resolved"),
    ("31/05/2024", None, "us_portal", None, "unreadable"),
    ("3/5/2024 12:07:08 AM", None, "us_portal", at(2024, 3, 5, 0, 7, 8), "resolved"),
    ("3/5/2024 12:07 pm", None, "us_portal", at(2024, 3, 5, 12, 7), "resolved"),
    ("05.03.2024 06:07:08", "Europe/Berlin", "x", at(2024, 3, 5, 5, 7, 8), "resolved"),
    ("5 March 2024", None, None, at(2024, 3, 5), "resolved"),
    ("Tue, 05 Mar 2024 06:07:08 GMT", "Asia/Tokyo", None, at(2024, 3, 5, 6, 7, 8), "exact"),
    ("March 5, 2024 1:00:00 PM", None, None, at(2024, 3, 5, 13), "resolved"),
    ("05-Mar-2024", None, None, at(2024, 3, 5), "resolved"),
    ("2024-03-05 06:07:08 America/Chicago", "Asia/Tokyo", None, at(2024, 3, 5, 12, 7, 8), "resolved"),
    ("2023-11-05 01:30:00", "America/New_York", None, at(2023, 11, 5, 5, 30), "ambiguous"),
    ("2023-11-05 01:30:00 EST", "America/New_York", None, at(2023, 11, 5, 6, 30), "ambiguous"),
    ("2023-11-05 01:30:00 EDT", "America/New_York", None, at(2023, 11, 5, 5, 30), "ambiguous"),
    ("2023-03-12 02:30:00", "America/New_York", None, at(2023, 3, 12, 7, 30), "skipped"),
    ("2024-02-29", None, None, at(2024, 2, 29), "resolved"),
    ("2023-02-29", None, None, None, "unreadable"),
    ("2024-00-10", None, None, None, "unreadable"),
    ("00000000", None, None, None, "unreadable"),
    ("2024-01-01 24:00:00", None, None, None, "unreadable"),
    ("2024-01-01 10:00:00", "Nowhere/Land", None, None, "unknown_zone"),
    ("2024-01-01 10:00:00", " ", None, at(2024, 1, 1, 10), "resolved"),
    ("pending", None, None, None, "unreadable"),
    ("", None, None, None, "unreadable"),
    (None, None, None, None, "unreadable"),
    ("9" * 100_000, None, None, None, "unreadable"),
    ("2024-01-01 10:00 " + "a/" * 50_000, None, None, None, "unreadable"),
    (" \t" * 50_000 + "2024-03-05" + "\u00a0\n" * 300 + "06:07", None, None, at(2024, 3, 5, 6, 7), "resolved"),
    ("1709618828123456789", None, None, 1709618828, "exact"),
    ("2065-07-01 12:00", "America/New_York", None, at(2065, 7, 1, 16), "resolved"),
    ("1950-07-01 12:00", "America/New_York", None, at(1950, 7, 1, 16), "resolved"),
    ("1850-07-01 12:00", "Europe/Amsterdam", None, None, "resolved"),
    ("2024-01-05 10:00 EST", None, None, at(2024, 1, 5, 15), "resolved"),
    ("2024-01-05 10:00 PDT", None, None, at(2024, 1, 5, 17), "resolved"),
    ("Jan 5, 2024 10:00 am CET", None, None, at(2024, 1, 5, 9), "resolved"),
    ("2024-01-05 10:00 MSK", "America/New_York", None, at(2024, 1, 5, 7), "resolved"),
    ("2024-01-05 10:00 IST", None, None, None, "ambiguous_zone"),
    ("2024-01-05 10:00 IST", "Asia/Kolkata", None, at(2024, 1, 5, 4, 30), "resolved"),
    ("2024-01-05 10:00 XYZ", "America/New_York", None, None, "unknown_zone"),
    ("2024-01-05 10:00 (EST)", "Nowhere/Land", None, at(2024, 1, 5, 15), "resolved"),
]


def test_cases(spark):
    rows = [(i, t, z, f, "kept") for i, (t, z, f, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, t string, z string, f string, zone_key string")
    got = {r.i: r for r in normalize_timestamps(df, "t", "z", "f").collect()}
    assert len(got) == len(CASES)
    for i, (t, z, f, want, status) in enumerate(CASES):
        if t and t.startswith("1850"):
            want = int(dt.datetime(1850, 7, 1, 12, tzinfo=ZoneInfo(z)).timestamp())
        assert (got[i].epoch_s, got[i].epoch_s_status, got[i].zone_key) == (want, status, "kept"), (t, z, f)


def test_nanoseconds(spark):
    cases = {"2024-03-05T06:07:08.123456": 123456000, "2024-03-05 06:07:08,5 +01:00": 500000000, "20240305060708.1234567891234": 123456789, "1709618828999": 999000000, "1709618828123456": 123456000, "1709618828123456789": 123456789, "2024-03-05": 0, "2024-03-05 6:07:08.25 pm": 250000000, "x": None, None: None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.epoch_s_nanos for r in normalize_timestamps(df, "t").collect()} == cases


def test_every_year(spark):
    """Years far from today against the zones' own rules, some about each change of the year."""
    pick = random.Random(3)
    zones = sorted(available_timezones())
    rows = []
    for i in range(6000):
        year = pick.choice([pick.randrange(1, 1970), pick.randrange(2037, 2200), pick.randrange(2200, 9999)])
        moment = dt.datetime(year, 1, 1) + dt.timedelta(seconds=pick.randrange(365 * 86400)) if i % 4 else dt.datetime(year, pick.choice([1, 12]), pick.choice([1, 2, 30, 31]), pick.randrange(24))
        rows.append((i, moment.isoformat(" "), pick.choice(zones)))
    got = {r.i: r for r in normalize_timestamps(spark.createDataFrame(rows, "i int, t string, z string"), "t", "z").collect()}
    for i, t, z in rows:
        local = dt.datetime.fromisoformat(t)
        want = (local - local.replace(tzinfo=ZoneInfo(z)).utcoffset() - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1)
        assert got[i].epoch_s == want, (t, z, got[i])


def test_no_zone_changes_before_the_first_year_nor_off_its_rule_in_the_last():
    from labelloom.operators import timestamps as T

    for zone in available_timezones():
        listed, _ = T.listed_changes(T.zone_file(zone))
        assert all(at(T.FIRST_YEAR, 1, 1) < m < at(T.LAST_YEAR - 28, 1, 1) for m in listed if m > -(2**59)), zone


def test_against_zone_rules(spark):
    pick = random.Random(7)
    zones = ["America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Kolkata", "Africa/Casablanca", "America/St_Johns", "Pacific/Apia", "UTC"]
    rows = []
    for i in range(4000):
        moment = dt.datetime(1972, 1, 1) + dt.timedelta(seconds=pick.randrange(80 * 365 * 86400))
        rows.append((i, str(moment), pick.choice(zones)))
    got = {r.i: r.epoch_s for r in normalize_timestamps(spark.createDataFrame(rows, "i int, t string, z string"), "t", "z").collect()}
    for i, t, z in rows:
        local = dt.datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z))
        assert got[i] == int(local.timestamp()), (t, z)


def test_repeated_and_empty(spark):
    df = spark.createDataFrame([("2024-01-01",)] * 3, "t string")
    assert [r.epoch_s for r in normalize_timestamps(df, "t").collect()] == [at(2024, 1, 1)] * 3
    assert normalize_timestamps(df.limit(0), "t").count() == 0


def test_every_zone():
    step = 5 * 86400
    for zone in available_timezones():
        tz, rows = ZoneInfo(zone), iter(zone_intervals(zone))
        row = next(rows)
        for moment in range(at(1900, 1, 1), at(2131, 1, 1), step):
            while moment >= row[1]:
                before, row = row, next(rows)
                for s, r in ((row[0] - 1, before), (row[0], row)):
                    assert dt.datetime.fromtimestamp(s, tz).utcoffset().total_seconds() == r[2], (zone, s)
            assert dt.datetime.fromtimestamp(moment, tz).utcoffset().total_seconds() == row[2], (zone, moment)


def test_short_intervals(spark):
    cases = [("2010-09-20 12:00:00", "Africa/Cairo", "resolved"), ("2000-10-10 12:00:00", "America/Recife", "resolved"), ("2010-09-09 23:30:00", "Africa/Cairo", "resolved"), ("2010-09-10 00:30:00", "Africa/Cairo", "skipped")]
    got = {(r.t, r.z): r for r in normalize_timestamps(spark.createDataFrame([c[:2] for c in cases], "t string, z string"), "t", "z").collect()}
    for t, z, status in cases:
        r = got[t, z]
        assert (r.epoch_s, r.epoch_s_status) == (int(dt.datetime.fromisoformat(t).replace(tzinfo=ZoneInfo(z)).timestamp()), status), (t, z)
