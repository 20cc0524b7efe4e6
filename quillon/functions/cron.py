"""Cron expressions: parsed by a grammar into sets, expanded over a calendar, resolved through time zones.

Day fields follow the Vixie rule: if both are restricted, either may match. A
wall-clock time that a zone skips fires when the gap ends; one that it repeats
fires at its first occurrence. No zone, or an empty one, means UTC; ``Local`` and names that are
not known are errors of the row that has them.

Two ways to fire times agree: ``fires`` expands many expressions over a span
as DataFrame operations; ``Cron`` searches forward or back from an instant, for
plans and previews that need a few fires of each of many schedules.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000

#: Fields as (name, lowest, highest), macros, names, years that a search covers.
FIELDS = (("second", 0, 59), ("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 7))
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
WEEKDAYS = "SUN MON TUE WED THU FRI SAT".split()
YEARS = 10

#: One item of a field: any, a value or a range of values, and a step. ``any`` and ``name`` are filled in for each field.
ITEM = r"(?:(?P<any>{any})|(?P<first>{name}[+-]?\d+)(?:-(?P<last>{name}[+-]?\d+))?)(?:/\+?(?P<step>\d+))?"
NAMES = {"month": {n: i for i, n in enumerate(MONTHS, 1)}, "dow": {n: i for i, n in enumerate(WEEKDAYS)}}


@lru_cache(maxsize=None)
def _item(field: str) -> re.Pattern:
    names = "".join(f"{n}|" for n in NAMES.get(field, ()))
    return re.compile(ITEM.format(any=r"[*?]" if field in ("dom", "dow") else r"\*", name=names), re.IGNORECASE | re.ASCII)


def _values(text: str, field: str, low: int, high: int) -> set[int]:
    """The numbers that a field stands for: the union of its items."""
    number = lambda s: NAMES.get(field, {}).get(s.upper()) if s.isalpha() else int(s)
    found: set[int] = set()
    for m in (_item(field).fullmatch(item) for item in text.split(",")):
        if m is None:
            raise ValueError(f"{text!r} is no {field} field")
        step = int(m["step"] or 1)
        # A lone value with a step goes on to the end of the field.
        first = low if m["any"] else number(m["first"])
        last = number(m["last"]) if m["last"] else high if m["any"] or m["step"] else first
        own = range(first, last + 1, step) if step else ()
        if not own or first < low or last > high:
            raise ValueError(f"{m[0]!r} is empty or leaves {low}-{high} in {field}")
        found.update(own)
    return found


def parse(expr: str) -> dict[str, int | bool]:
    """Bit sets by field, and whether a day field takes any day. ValueError if it is malformed or never fires."""
    fields = MACROS.get(expr.strip().lower(), expr).split()
    fields = ["0"] * (len(fields) == 5) + fields
    if len(fields) != len(FIELDS):
        raise ValueError(f"{expr!r} has not 5 or 6 fields")
    sets = {name: _values(text, name, low, high) for text, (name, low, high) in zip(fields, FIELDS, strict=True)}
    sets["dow"] = {d % 7 for d in sets["dow"]}
    free = {f"any_{name}": fields[i] in ("*", "?") for i, name in ((3, "dom"), (5, "dow"))}
    # Only days of the month can rule each other out: some leap year must have one of the months' days.
    if free["any_dow"] and not free["any_dom"] and all((date(2000 + (m == 12), m % 12 + 1, 1) - timedelta(days=1)).day < min(sets["dom"]) for m in sets["month"]):
        raise ValueError(f"{expr!r} never fires")
    return {name: sum(1 << v for v in values) for name, values in sets.items()} | free


def place(name: str | None) -> ZoneInfo:
    """The zone of a name; none or an empty one is UTC. ValueError for others that are not known."""
    if not name:
        return ZoneInfo("UTC")
    try:
        if name != "Local":
            return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):  # a path or a folder's name too
        pass
    raise ValueError(f"unknown time zone {name!r}")


MASKS = T.StructType([*(T.StructField(n, T.LongType()) for n, _, _ in FIELDS), T.StructField("any_dom", T.BooleanType()), T.StructField("any_dow", T.BooleanType()), T.StructField("error", T.StringType())])


@F.pandas_udf(MASKS)
def masks(expr: pd.Series) -> pd.DataFrame:
    """The bit sets of each expression, or the error that it has."""

    def one(text: str | None) -> dict:
        try:
            if text is not None:
                return parse(text) | {"error": None}
            why = "no expression"
        except ValueError as e:
            why = str(e)
        return dict.fromkeys((n for n, _, _ in FIELDS), 0) | {"any_dom": False, "any_dow": False, "error": why}

    known = {t: one(t) for t in expr.unique()}
    return pd.DataFrame([known[t] for t in expr], columns=MASKS.names)


# -- a search from an instant ----------------------------------------------------


@lru_cache(maxsize=2_048)
def changes(zone: str, first: int, last: int) -> list[tuple[int, int, int]]:
    """A zone's changes of offset between two instants, as (instant, offset before, offset after) in microseconds, the first one since ever."""
    where, a, b = place(zone), first // SECOND, last // SECOND
    offset = lambda at: int(datetime.fromtimestamp(at, timezone.utc).astimezone(where).utcoffset().total_seconds())
    rows, was = [(-(1 << 60), offset(a) * SECOND, offset(a) * SECOND)], offset(a)
    half = 43_200
    for start in range(a, b, half):
        stop = min(start + half, b)
        if (now := offset(stop)) != was:
            at = bisect_left(range(start, stop + 1), True, key=lambda t: offset(t) != was) + start  # noqa: B023
            rows.append((at * SECOND, was * SECOND, now * SECOND))
            was = now
    return rows


class Cron:
    """Fire times of an expression in a zone, in microseconds: days that match, and the times of day that every such day has.

    Instants never go back as wall-clock times go on, so a search over wall-clock times finds the next or the last instant.
    """

    def __init__(self, expr: str, zone: str | None = None):
        sets = parse(expr)
        self.zone, self.sets = place(zone).key, sets
        members = lambda name, low, high: [v for v in range(low, high + 1) if sets[name] >> v & 1]
        h, m, s = members("hour", 0, 23), members("minute", 0, 59), members("second", 0, 59)
        self.hours, self.inside = h, [60 * x + y for x in m for y in s]  # a day's times: every hour's, in order

    def _on(self, day: int) -> bool:
        at, sets = date.fromordinal(day), self.sets
        dom, dow = sets["dom"] >> at.day & 1, sets["dow"] >> at.isoweekday() % 7 & 1
        return bool(sets["month"] >> at.month & 1 and (dom and dow if sets["any_dom"] or sets["any_dow"] else dom or dow))

    def _wall(self, wall: int, back: bool = False) -> int | None:
        """The first matching wall-clock second at or after one, or the last at or before it; seconds since the epoch."""
        day, second = divmod(wall, 86_400)
        here = self._in_day(second, back)
        if here is None or not self._on(day + EPOCH):
            step = -1 if back else 1
            here = 3_600 * self.hours[-1] + self.inside[-1] if back else 3_600 * self.hours[0] + self.inside[0]
            for day in range(day + step, day + step * 366 * YEARS, step):  # noqa: B020
                if self._on(day + EPOCH):
                    break
            else:
                return None
        return day * 86_400 + here

    def _in_day(self, second: int, back: bool) -> int | None:
        hour, rest = divmod(second, 3_600)
        if back:
            k = bisect_right(self.hours, hour) - 1
            if k >= 0 and self.hours[k] == hour:
                if (i := bisect_right(self.inside, rest) - 1) >= 0:
                    return 3_600 * hour + self.inside[i]
                k -= 1
            return 3_600 * self.hours[k] + self.inside[-1] if k >= 0 else None
        k = bisect_left(self.hours, hour)
        if k < len(self.hours) and self.hours[k] == hour:
            if (i := bisect_left(self.inside, rest)) < len(self.inside):
                return 3_600 * hour + self.inside[i]
            k += 1
        return 3_600 * self.hours[k] + self.inside[0] if k < len(self.hours) else None

    def _instant(self, wall: int) -> int:
        """The instant of a wall-clock second: the last change that the clock had passed decides the offset; within a gap the change itself."""
        wall *= SECOND
        near = changes(self.zone, *_span(wall))
        at, _, after = next(c for c in reversed(near) if c[0] + c[1] <= wall)
        return max(at, wall - after)

    def _clock(self, at: int) -> int:
        """The latest wall-clock second whose first occurrence an instant has reached: after a change back, all that the clock had shown before."""
        moved, before, after = next(c for c in reversed(changes(self.zone, *_span(at))) if c[0] <= at)
        return max(at + after, moved + before - SECOND) // SECOND

    def after(self, at: int) -> int | None:
        """The first fire strictly after an instant; nothing within YEARS is none."""
        wall = self._clock(at) + 1
        while (wall := self._wall(wall)) is not None:
            if (found := self._instant(wall)) > at:
                return found
            wall += 1
        return None

    def upto(self, at: int, n: int, since: int) -> list[int]:
        """The last ``n`` fires from ``since`` to ``at``, both included, oldest first."""
        found: list[int] = []
        wall = self._clock(at)
        while len(found) < n and (wall := self._wall(wall, back=True)) is not None:
            if (instant := self._instant(wall)) < since:
                break
            if not found or instant < found[-1]:
                found.append(instant)
            wall -= 1
        return found[::-1]


EPOCH = date(1970, 1, 1).toordinal()
_BLOCK = 366 * DAY


def _span(at: int) -> tuple[int, int]:
    """A year's block around a time, with a margin: few blocks serve many times."""
    block = at // _BLOCK
    return (block - 1) * _BLOCK, (block + 2) * _BLOCK


@lru_cache(maxsize=4_096)
def compiled(expr: str, zone: str | None) -> Cron:
    """ValueError if the expression or the zone is none."""
    return Cron(expr, zone)


# -- many expressions over a span ----------------------------------------------------


def _bits(mask: Column, low: int, high: int) -> Column:
    return F.filter(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")), lambda i: F.getbit(mask, i.cast("int")) == 1)


def transitions(zones: list[str], first: int, last: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The changes of each zone that is known."""
    found = []
    for name in zones:
        try:
            found.append((name, changes(place(name).key, first, last)))
        except ValueError:
            continue
    return found


def resolve(wall: Column, moves: Column) -> Column:
    """The instant of a wall-clock time, as in ``Cron``."""
    last = F.element_at(F.filter(moves, lambda c: c["at"] + c["before"] <= wall), -1)
    return F.greatest(last["at"], wall - last["after"])


def _zoned(crons: DataFrame) -> DataFrame:
    return crons.withColumn("zone", F.when(F.coalesce("zone", F.lit("")) == "", "UTC").otherwise(F.col("zone")))


def problems(crons: DataFrame) -> DataFrame:
    """crons: id, expr, zone. (id, error) of those that cannot fire: a malformed expression, an unknown zone."""

    @F.pandas_udf(T.StringType())
    def unknown(zone: pd.Series) -> pd.Series:
        def why(name):
            try:
                place(name)
            except ValueError as e:
                return str(e)

        known = {z: why(z) for z in zone.unique()}
        return pd.Series([known[z] for z in zone], dtype=object)

    found = _zoned(crons).select("id", F.coalesce(masks("expr")["error"], unknown("zone")).alias("error"))
    return found.where("error is not null")


def fires(crons: DataFrame, until: str = "until") -> DataFrame:
    """crons: id, expr, zone, after, ``until`` (microseconds). Returns (id, fire_time), after < fire_time <= until.

    Rows that cannot fire (see ``problems``) have no fires. Distinct zones (IANA has some hundreds) and the two ends of
    time go to the driver, nothing else. On days without a change of the zone, nearly all, an offset holds for the whole
    day and no two wall-clock times are one instant; only the others are resolved time by time and freed of repeats.
    """
    spark = crons.sparkSession
    crons = _zoned(crons)
    span = crons.agg(F.min("after").alias("a"), F.max(until).alias("b"), F.array_sort(F.collect_set("zone")).alias("zones")).first()
    if span["a"] is None or span["b"] is None:
        return crons.select("id", F.lit(0).cast("long").alias("fire_time")).limit(0)
    pad = 400 * DAY
    zones = spark.createDataFrame(transitions(span["zones"], span["a"] - pad, span["b"] + pad), "zone string, changes array<struct<at: long, before: long, after: long>>")
    rows = crons.withColumn("m", masks("expr")).where("m.error is null").join(F.broadcast(zones), "zone")
    # The hours, minutes and seconds of an expression are unfolded once, not at each day or hour.
    rows = rows.select("id", "after", F.col(until).alias("until"), "m", "changes", _bits(F.col("m.hour"), 0, 23).alias("hours"), _bits(F.col("m.minute"), 0, 59).alias("minutes"), _bits(F.col("m.second"), 0, 59).alias("seconds"))
    days = rows.where("after < until").select("*", F.explode(F.sequence(F.floor(F.col("after") / DAY) - 1, F.floor(F.col("until") / DAY) + 1)).alias("day"))
    day_of = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
    bit = lambda field, value: F.getbit(F.col(f"m.{field}"), value) == 1
    dom, dow = bit("dom", F.dayofmonth(day_of)), bit("dow", F.dayofweek(day_of) - 1)
    days = days.where(bit("month", F.month(day_of)) & F.when(F.col("m.any_dom") | F.col("m.any_dow"), dom & dow).otherwise(dom | dow)).drop("m")
    start = F.col("day") * DAY
    days = days.withColumn("moves", F.filter("changes", lambda c: F.abs(c["at"] + c["before"] - start) < 2 * DAY))
    days = days.withColumn("last", F.element_at(F.filter("changes", lambda c: c["at"] + c["before"] <= start), -1))

    def clock(some: DataFrame, shift: Column, slack: int) -> DataFrame:
        """Each wall-clock time less a shift, of hours that may lie between the ends."""
        hours = some.withColumn("h", F.explode("hours")).withColumn("base", start + F.col("h") * HOUR - shift)
        hours = hours.where((F.col("base") > F.col("after") - HOUR - slack) & (F.col("base") <= F.col("until") + slack))
        minutes = hours.select("id", "after", "until", "changes", "seconds", "base", F.explode("minutes").alias("min"))
        return minutes.select("id", "after", "until", "changes", (F.col("base") + F.col("min") * 60 * SECOND).alias("base"), F.explode("seconds").alias("s")).withColumn("at", F.col("base") + F.col("s") * SECOND)

    plain = clock(days.where(F.size("moves") == 0), F.col("last")["after"], 0)
    moved = clock(days.where(F.size("moves") > 0), F.lit(0), 16 * HOUR)  # no zone is further from UTC
    moved = moved.withColumn("at", resolve(F.col("at"), F.col("changes")))
    inside = lambda df: df.where((F.col("at") > F.col("after")) & (F.col("at") <= F.col("until"))).select("id", F.col("at").alias("fire_time"))
    return inside(plain).unionByName(inside(moved).distinct())


@F.udtf(returnType="fire_time: long")
class NextFires:
    """The next ``most`` fires of an expression in a zone after an instant: a table function, for LATERAL joins with a few schedules."""

    def eval(self, expr: str, zone: str, after: int, most: int):
        cron = compiled(expr, zone)
        for _ in range(most):
            after = cron.after(after)
            if after is None:
                return
            yield (after,)
