"""Timestamps written in many formats and zones, brought to UTC seconds.

The text is read into a local wall-clock time by ordered patterns; local times
are then joined to zone-offset intervals exploded by zone and years. Two
matching intervals mean an ambiguous hour, none a skipped hour, one gives the
offset directly. An abbreviation that the row's own zone doesn't carry is
joined to the intervals of all zones that carry it.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from datetime import datetime, timezone
from functools import lru_cache
from importlib import resources
from io import BytesIO
from itertools import pairwise
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years with exploded intervals, and how many of them share a row. No zone changes before
#: the first. A later year is read as one of the last 28, which hold every calendar (weekday
#: of 1 January, leap or not) once and lie behind the last change that isn't by rule.
FIRST_YEAR, LAST_YEAR, ROW_YEARS = 1832, 2131, 4

# Date and time patterns, tried in this order.
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([ap]\.?m\.?(?![a-z]))?"
TAIL = r"\s*(z|[a-z][a-z_]*(?:/[a-z0-9_+-]+){1,3}|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?(?:\s*\[[a-z0-9_/+-]+\])?|\(?[a-z]{2,5}\)?)?"
MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?" + TAIL + "$"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:(?:t|\s+)" + TIME + ")?" + TAIL + "$"
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:(?:t|,?\s+)" + TIME + ")?" + TAIL + "$"
DAY_MONTH = "^" + WEEKDAY + r"(\d{1,2})(?:st|nd|rd|th)?[-\s./]*" + MONTH + r"[-\s,./]*(\d{4})(?:(?:t|,?\s+)" + TIME + ")?" + TAIL + "$"
MONTH_DAY = "^" + WEEKDAY + MONTH + r"[-\s./]*(\d{1,2})(?:st|nd|rd|th)?[-\s,./]+(\d{4})(?:(?:t|,?\s+)" + TIME + ")?" + TAIL + "$"
MONTH_NAMES = "janfebmaraprmayjunjulaugsepoctnovdec"

INTERVAL = pa.struct([("from_l", pa.int64()), ("to_l", pa.int64()), ("offset_s", pa.int32()), ("abbr", pa.string())])


def zone_file(zone: str) -> bytes:
    """The zone's TZif file, from where ``zoneinfo`` reads it."""
    for folder in TZPATH:
        if (path := Path(folder, zone)).is_file():
            return path.read_bytes()
    return resources.files("tzdata").joinpath("zoneinfo", zone).read_bytes()


def listed_changes(data: bytes) -> tuple[list[int], bool]:
    """The transitions that a TZif file lists, in UTC seconds, and whether its rule for later years changes the offset."""
    head = struct.Struct(">4sc15x6l")
    _, version, isut, isstd, leap, times, types, chars = head.unpack_from(data)
    at, width = head.size, 4
    if version >= b"2":
        at += times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        _, _, isut, isstd, leap, times, types, chars = head.unpack_from(data, at)
        at, width = at + head.size, 8
    listed = list(struct.unpack_from(f">{times}{'q' if width == 8 else 'l'}", data, at))
    rule = data[at + times * (width + 1) + types * 6 + chars + leap * (width + 4) + isstd + isut :]
    return listed, b"," in rule


def zone_intervals(zone: str) -> list[tuple[int, int, int, str]]:
    """(start, end, offset, abbreviation) of a zone, start and end in UTC seconds.

    Changes are those that the zone's file lists; where its rule goes on after
    them, they are found by bisection between weekly probes (a rule changes
    twice a year).
    """
    return _intervals(zone_file(zone))


def _moment(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=timezone.utc).timestamp())


@lru_cache(maxsize=1024)
def _intervals(data: bytes) -> list[tuple[int, int, int, str]]:
    tz, step = ZoneInfo.from_file(BytesIO(data)), 7 * 86400

    def state(s: int) -> tuple[int, str]:
        at = datetime.fromtimestamp(s, tz)
        return int(at.utcoffset().total_seconds()), at.tzname() or ""

    first, last = _moment(FIRST_YEAR - 1), _moment(LAST_YEAR + 2)
    listed, goes_on = listed_changes(data)
    edges, states = [-(2**61)], [state(first)]
    for moment in listed:
        if first < moment < last and (new := state(moment)) != states[-1]:
            edges.append(moment)
            states.append(new)
    moment = max([first, *listed])
    while goes_on and moment < last:
        if state(moment + step) != states[-1]:
            low, high = moment, moment + step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if state(middle) == states[-1] else (low, middle)
            edges.append(moment := high)
            states.append(state(moment))
        else:
            moment += step
    return [(a, b, *s) for (a, b), s in zip(pairwise([*edges, 2**61]), states, strict=True)]


@lru_cache(maxsize=4)
def _exploded(zones: tuple[str, ...] | None) -> tuple[pa.Table, pa.Table]:
    """The rows of zones and those of abbreviations, each by ROW_YEARS years."""
    years = range(FIRST_YEAR, LAST_YEAR + 1, ROW_YEARS)
    spans = [(-(2**62) if y == FIRST_YEAR else _moment(y) - 2 * 86400, _moment(y + ROW_YEARS) + 2 * 86400) for y in years]
    by_file: dict[bytes, list] = {}
    names, found = [], []
    carried: dict[tuple[str, int], dict] = {}
    for zone in sorted(zones or available_timezones()):
        data = zone_file(zone)
        if data not in by_file:
            rows = [(a + o, b + o, o, n) for a, b, o, n in _intervals(data)]
            starts, ends = [r[0] for r in rows], [r[1] for r in rows]
            by_file[data] = [rows[bisect_right(ends, low) : bisect_left(starts, high)] for low, high in spans]
            for year, part in zip(years, by_file[data], strict=True):
                for r in part:
                    if r[3].isalpha() and r[3] != "LMT":
                        carried.setdefault((r[3], year), {})[r[:3]] = None
        names.append(zone.lower())
        found.append(by_file[data])
    table = lambda key, keys, at, lists: pa.table({key: keys, f"{key}_years": pa.array(at, pa.int32()), f"{key}_intervals": pa.array(lists, pa.list_(INTERVAL))})
    entry = lambda r, n: dict(zip(("from_l", "to_l", "offset_s", "abbr"), (*r[:3], n), strict=True))
    own = table("zone", [n for n in names for _ in years], [y for _ in names for y in years], [[entry(r, r[3]) for r in part] for parts in found for part in parts])
    return own, table("abbr", [k[0] for k in carried], [k[1] for k in carried], [[entry(r, k[0]) for r in v] for k, v in carried.items()])


def interval_table(spark: SparkSession, zones: tuple[str, ...] | None = None) -> DataFrame:
    """One row per zone and ROW_YEARS local years with the offset intervals that touch them.

    Its size is fixed by the zone database (some 600 zones and 75 rows each),
    not by the data, so it may be broadcast.
    """
    return spark.createDataFrame(_exploded(zones)[0])


def abbreviation_table(spark: SparkSession, zones: tuple[str, ...] | None = None) -> DataFrame:
    """As ``interval_table`` by abbreviation, over all zones that carry it; some 200 abbreviations."""
    return spark.createDataFrame(_exploded(zones)[1])


def _days(y: str, m: str, d: str) -> str:
    """Days since 1970-01-01 by integer arithmetic; never raises on odd input."""
    yy = f"({y} - if({m} <= 2, 1, 0))"
    yoe = f"({yy} - ({yy} div 400) * 400)"
    doy = f"((153 * ({m} + if({m} > 2, -3, 9)) + 2) div 5 + {d} - 1)"
    return f"(({yy} div 400) * 146097 + {yoe} * 365 + {yoe} div 4 - {yoe} div 100 + {doy} - 719468)"


def _parts(text: Column, month_first: Column) -> Column:
    """``Y|M|D|h|m|s|fraction|am or pm|zone`` of a text, or null."""
    rest = "|$4|$5|$6|$7|$8|$9"
    return (
        F.when(text.rlike(YEAR_FIRST), F.regexp_replace(text, YEAR_FIRST, "$1|$2|$3" + rest))
        .when(text.rlike(COMPACT), F.regexp_replace(text, COMPACT, "$1|$2|$3|$4|$5|$6|$7||$8"))
        .when(text.rlike(YEAR_LAST), F.when(month_first, F.regexp_replace(text, YEAR_LAST, "$3|$1|$2" + rest)).otherwise(F.regexp_replace(text, YEAR_LAST, "$3|$2|$1" + rest)))
        .when(text.rlike(DAY_MONTH), F.regexp_replace(text, DAY_MONTH, "$3|$2|$1" + rest))
        .when(text.rlike(MONTH_DAY), F.regexp_replace(text, MONTH_DAY, "$3|$1|$2" + rest))
    )


def _table_years() -> tuple[str, str]:
    """SQL of the table's year for ``__ts_y``, and of the seconds from that year to the other."""
    same: dict[int, int] = {}
    for year in range(LAST_YEAR - 27, LAST_YEAR + 1):
        days = _moment(year) // 86400
        same[days % 7 * 2 + (_moment(year + 1) // 86400 - days == 366)] = year
    leap = "int((__ts_y % 4 = 0 and __ts_y % 100 <> 0) or __ts_y % 400 = 0)"
    start = _days("__ts_y", "1", "1")
    pick = lambda values: f"get(array({', '.join(str(v) for v in values)}), int(pmod({start}, 7)) * 2 + {leap})"
    years = [same[i] for i in range(14)]
    first = pick([f"{_moment(y) // 86400}L" for y in years])
    return f"case when __ts_y > {LAST_YEAR} then {pick(years)} else greatest({FIRST_YEAR}, __ts_y) end", f"case when __ts_y > {LAST_YEAR} then 86400L * ({start} - {first}) else 0L end"


def normalize_timestamps(
    df: DataFrame,
    text: str,
    zone: str | None = None,
    feed: str | None = None,
    month_first_feeds: tuple[str, ...] = ("us_portal",),
    out: str = "epoch_s",
    zones: tuple[str, ...] | None = None,
) -> DataFrame:
    """``df`` with UTC seconds in ``out``, the nanoseconds beyond in ``{out}_nanos``, and ``{out}_status``.

    ``text`` is the written time, ``zone`` the column with the region of values
    that name none (null or blank: UTC), ``feed`` the column that decides
    whether all-number dates that end in the year are month-first.

    Status is ``exact`` (the value carries its offset or is a count since 1970
    in seconds, milli-, micro- or nanoseconds), ``resolved`` (one interval),
    ``ambiguous`` (an hour that occurs twice; the first unless an abbreviation
    marks it), ``skipped`` (read with the offset before the change),
    ``ambiguous_zone`` (an abbreviation that the row's zone doesn't carry and
    that means several offsets), ``unknown_zone`` (a region or abbreviation of
    no zone) or ``unreadable``; the last three have a null ``out``. An
    abbreviation that only other zones carry counts if all mean one offset.
    Null and blank texts, impossible dates and any other text are unreadable;
    white space doesn't matter, however much. Digits of a fraction beyond the
    ninth are cut. Any year from 1 to 9999 is read by the zone's own changes
    and rule. Rows are neither dropped nor added; other columns pass through
    untouched, working columns have names that start with ``__ts_``.
    """
    spark = df.sparkSession
    raw = F.trim(F.regexp_replace(F.lower(F.col(text)), r"(?U)\s+", " "))
    own = F.lower(F.trim(F.col(zone))) if zone else F.lit(None).cast("string")
    first = F.coalesce(F.col(feed).isin(*month_first_feeds), F.lit(False)) if feed else F.lit(False)
    df = df.withColumns({"__ts_raw": raw, "__ts_zone": F.when(F.length(own) > 0, own).otherwise("utc")})
    df = df.withColumn("__ts_p", F.split(_parts(F.col("__ts_raw"), first), r"\|"))
    month = f"if(__ts_p[1] rlike '^[0-9]', try_cast(__ts_p[1] as int), (instr('{MONTH_NAMES}', left(__ts_p[1], 3)) + 2) div 3)"
    df = df.selectExpr(
        "*",
        "try_cast(__ts_p[0] as int) __ts_y",
        f"cast({month} as int) __ts_m",
        "try_cast(__ts_p[2] as int) __ts_d",
        "coalesce(try_cast(__ts_p[3] as int), 0) __ts_h",
        "coalesce(try_cast(__ts_p[4] as int), 0) __ts_n",
        "coalesce(try_cast(__ts_p[5] as int), 0) __ts_s",
        "coalesce(try_cast(rpad(left(__ts_p[6], 9), 9, '0') as int), 0) __ts_f",
        "left(__ts_p[7], 1) __ts_ap",
        r"regexp_replace(__ts_p[8], '[()]', '') __ts_tail",
    )
    leap = "((__ts_y % 4 = 0 and __ts_y % 100 <> 0) or __ts_y % 400 = 0)"
    hour = "case when __ts_ap = 'p' and __ts_h < 12 then __ts_h + 12 when __ts_ap = 'a' and __ts_h = 12 then 0 else __ts_h end"
    valid = (
        f"__ts_y >= 1 and __ts_m between 1 and 12 and __ts_d between 1 and case when __ts_m = 2 then if({leap}, 29, 28) when __ts_m in (4, 6, 9, 11) then 30 else 31 end"
        " and __ts_h between if(__ts_ap in ('a', 'p'), 1, 0) and if(__ts_ap in ('a', 'p'), 12, 23) and __ts_n < 60 and __ts_s < 60"
    )
    offset = r"""case when __ts_tail in ('z', 'utc', 'gmt', 'ut') then 0
        when __ts_tail rlike '^(utc|gmt)? ?[+-][0-9]{1,2}(:?[0-9]{2})?( ?\\[.*)?$' then
            if(__ts_tail like '%-%' and regexp_extract(__ts_tail, '([+-])[0-9]', 1) = '-', -1, 1)
            * (3600 * int(regexp_extract(__ts_tail, '[+-]([0-9]{1,2})', 1)) + 60 * coalesce(int(nullif(regexp_extract(__ts_tail, '[+-][0-9]{1,2}:?([0-9]{2})', 1), '')), 0)) end"""
    count = "case when __ts_raw rlike '^[0-9]{10}$' then decimal(__ts_raw) * 1000000000 when __ts_raw rlike '^[0-9]{13}$' then decimal(__ts_raw) * 1000000 when __ts_raw rlike '^[0-9]{16}$' then decimal(__ts_raw) * 1000 when __ts_raw rlike '^[0-9]{19}$' then cast(__ts_raw as decimal(20, 0)) end"
    year, shift = _table_years()
    df = df.selectExpr(
        "*",
        f"case when {valid} then 86400L * {_days('__ts_y', '__ts_m', '__ts_d')} + 3600L * {hour} + 60L * __ts_n + __ts_s end __ts_local",
        f"{offset} __ts_off",
        f"{count.replace('decimal(__ts_raw)', 'cast(__ts_raw as decimal(20, 0))')} __ts_count",
        "case when __ts_tail rlike '/' and not __ts_tail rlike '^(utc|gmt)? ?[+-]' then __ts_tail else __ts_zone end __ts_key",
        "case when __ts_tail rlike '^[a-z]{2,5}$' and __ts_tail not in ('utc', 'gmt', 'ut') then upper(__ts_tail) end __ts_abbr",
        f"{shift} __ts_shift",
        f"{year} __ts_ty",
    ).withColumn("__ts_year", F.expr(f"int(__ts_ty - pmod(__ts_ty - {FIRST_YEAR}, {ROW_YEARS}))"))
    own_rows = interval_table(spark, zones).toDF("__ts_zk", "__ts_zy", "__ts_iv")
    df = df.join(F.broadcast(own_rows), (F.col("__ts_key") == F.col("__ts_zk")) & (F.col("__ts_year") == F.col("__ts_zy")), "left")
    df = df.withColumn("__ts_at", F.expr("__ts_local - __ts_shift"))
    df = df.withColumn("__ts_hit", F.expr("filter(__ts_iv, i -> __ts_at >= i.from_l and __ts_at < i.to_l)"))
    # the interval with the abbreviation that holds the time or is nearest to it
    marked = "array_min(transform(filter(__ts_iv, i -> i.abbr = __ts_abbr), i -> struct(greatest(i.from_l - __ts_at, __ts_at - i.to_l + 1, 0L) as d, i.offset_s as o))).o"
    df = df.withColumn("__ts_marked", F.expr(f"case when __ts_abbr is not null then {marked} end"))
    foreign = F.when(F.col("__ts_off").isNull() & F.col("__ts_marked").isNull(), F.col("__ts_abbr"))
    others = abbreviation_table(spark, zones).toDF("__ts_ak", "__ts_ay", "__ts_aiv")
    df = df.withColumn("__ts_foreign", foreign)
    df = df.join(F.broadcast(others), (F.col("__ts_foreign") == F.col("__ts_ak")) & (F.col("__ts_year") == F.col("__ts_ay")), "left")
    world = "transform(filter(__ts_aiv, i -> __ts_at >= i.from_l and __ts_at < i.to_l), i -> i.offset_s)"
    df = df.withColumn("__ts_world", F.expr(f"case when __ts_foreign is not null then array_distinct(if(size({world}) > 0, {world}, transform(__ts_aiv, i -> i.offset_s))) end"))
    before = "array_max(transform(filter(__ts_iv, i -> i.to_l <= __ts_at), i -> struct(i.to_l as k, i.offset_s as o))).o"
    chosen = f"case when __ts_off is not null then __ts_off when __ts_foreign is not null then if(size(__ts_world) = 1, __ts_world[0], null) else coalesce(__ts_marked, get(__ts_hit, 0).offset_s, {before}) end"
    df = df.withColumn("__ts_out", F.expr(f"coalesce(__ts_count div 1000000000, __ts_local - {chosen})"))
    df = df.withColumns(
        {
            out: F.col("__ts_out"),
            f"{out}_nanos": F.expr("case when __ts_out is not null then int(coalesce(__ts_count % 1000000000, __ts_f)) end"),
            f"{out}_status": F.expr(
                "case when __ts_count is not null then 'exact' when __ts_local is null then 'unreadable' when __ts_off is not null then 'exact'"
                " when size(__ts_world) > 1 then 'ambiguous_zone' when size(__ts_world) = 1 then 'resolved' when __ts_foreign is not null or __ts_iv is null then 'unknown_zone'"
                " when size(__ts_hit) > 1 then 'ambiguous' when size(__ts_hit) = 0 then 'skipped' else 'resolved' end"
            ),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("__ts_")])
