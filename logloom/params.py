"""Parameters of reports: zones, time ranges, calendar periods. All times are instants in UTC."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, time, timedelta, tzinfo
from zoneinfo import ZoneInfo

SPANS = {"m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def zone(name: str | None) -> tzinfo:
    """``local`` (or none), ``UTC`` or ``Z`` in any case, or a name of the zone database."""
    wanted = (name or "local").strip()
    if wanted.lower() in ("", "local"):
        return datetime.now().astimezone().tzinfo or UTC
    if wanted.lower() in ("utc", "z"):
        return UTC
    try:
        return ZoneInfo(wanted)
    except (KeyError, ValueError, OSError) as e:
        raise ValueError(f"no time zone {name!r}") from e


def instant(text: str, now: datetime, where: tzinfo, until: bool = False) -> datetime:
    """A span back from now (30m, 24h, 7d, 2w), a date (its start; as an end, the next day's), or an ISO time (of the zone, if it tells none)."""
    t = text.strip()
    if m := re.fullmatch(r"(\d+)([mhdwMHDW])", t):
        return now - timedelta(**{SPANS[m[2].lower()]: int(m[1])})
    try:
        if re.fullmatch(r"\d{4}-\d\d-\d\d", t):
            return datetime.combine(date.fromisoformat(t) + timedelta(days=int(until)), time.min, where).astimezone(UTC)
        at = datetime.fromisoformat(t)
    except ValueError as e:
        raise ValueError(f"no time or span: {text!r}") from e
    return (at if at.tzinfo else at.replace(tzinfo=where)).astimezone(UTC)


def time_range(since: str | None, until: str | None, now: datetime | None = None, where: tzinfo = UTC) -> tuple[datetime | None, datetime | None]:
    """Half open: since <= t < until; a date as the end covers its day."""
    now = (now or datetime.now(UTC)).astimezone(UTC)
    a = instant(since, now, where) if since is not None else None
    z = instant(until, now, where, True) if until is not None else None
    if a and z and a >= z:
        raise ValueError("since must be before until")
    return a, z


def period(kind: str, day: date, where: tzinfo) -> tuple[datetime, datetime]:
    """The calendar week (from Monday) or month that holds the day."""
    first = day - timedelta(days=day.weekday()) if kind == "week" else day.replace(day=1)
    last = first + timedelta(days=7) if kind == "week" else (first + timedelta(days=32)).replace(day=1)
    start, end = (datetime.combine(d, time.min, where).astimezone(UTC) for d in (first, last))
    return start, end


def period_before(kind: str, start: datetime, where: tzinfo) -> tuple[datetime, datetime]:
    return period(kind, start.astimezone(where).date() - timedelta(days=1), where)


def local_windows(now: datetime, where: tzinfo) -> dict[str, tuple[datetime | None, datetime | None]]:
    """Today, this week and all time, as the zone has them; today's end is the end of all but the last."""
    today = now.astimezone(where).date()
    start, end, week = (datetime.combine(d, time.min, where).astimezone(UTC) for d in (today, today + timedelta(days=1), today - timedelta(days=today.weekday())))
    return {"today": (start, end), "week": (week, end), "overall": (None, None)}
