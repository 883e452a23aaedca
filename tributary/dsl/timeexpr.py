"""Time expressions: wall-clock text, zones with their gaps and overlaps, and windows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from .syntax import DslError, Query, TimeTerm, WindowTerm, duration_seconds, instant_text

EPOCH = datetime(1970, 1, 1)
DAY = timedelta(days=1)
EXAMPLES = "last:2h, after:14:00, between:14:00-15:00, on:2026-08-13, after:2026-08-13T14:00:00Z"
#: Longest look-back for the day of a bare clock time, and longest window searched for clock changes.
MOST_DAYS_BACK, MOST_DAYS_SCANNED = 366, 400


class TimeProblem(DslError):
    def __init__(self, text: str, why: str = "is not a time"):
        super().__init__(f"{text!r} {why}; for example {EXAMPLES}")


def micros(moment: datetime) -> int:
    """Microseconds since the epoch; naive moments are UTC."""
    if moment.tzinfo:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return (moment - EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


@dataclass(frozen=True)
class Wall:
    """What a text says: an instant, or a local date and/or clock time."""

    instant: int | None = None
    day: date | None = None
    clock: time | None = None


_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?|(\d{2})(\d{2})(\d{2})?|(\d{1,2})(?::(\d{2}))?\s*([aApP])[mM]")
_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})|(\d{4})/(\d{2})/(\d{2})|(\d{4})(\d{2})(\d{2})")
_INSTANT = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)([Zz]|[+-]\d{2}:?\d{2})")


def _clock(text: str) -> time | None:
    m = _CLOCK.fullmatch(text.strip())
    if not m:
        return None
    if m[8]:
        hour = int(m[8]) % 12 + 12 * (m[10].lower() == "p")
        parts = (hour, int(m[9] or 0), 0, 0) if 1 <= int(m[8]) <= 12 else (99, 0, 0, 0)
    else:
        parts = (int(m[1] or m[5]), int(m[2] or m[6]), int(m[3] or m[7] or 0), int(((m[4] or "") + "000000")[:6]))
    try:
        return time(*parts)
    except ValueError:
        return None


def _day(text: str) -> date | None:
    m = _DATE.fullmatch(text.strip())
    try:
        return date(*(int(x) for x in m.groups() if x)) if m else None
    except ValueError:
        return None


def wall(text: str) -> Wall | None:
    """A date, a clock time, both, or an instant with a zone."""
    text = text.strip()
    if m := _INSTANT.fullmatch(text):
        zone = "+00:00" if m[3] in "Zz" else m[3] if ":" in m[3] else m[3][:3] + ":" + m[3][3:]
        try:
            return Wall(instant=micros(datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}")))
        except ValueError:
            return None
    if (clock := _clock(text)) is not None and not re.fullmatch(r"\d{8}", text):
        return Wall(clock=clock)
    if (day := _day(text)) is not None:
        return Wall(day=day)
    head, _, tail = re.sub(r"(?<=\d)[Tt](?=\d)", " ", text, count=1).partition(" ")
    day, clock = _day(head), _clock(tail) if tail else None
    return Wall(day=day, clock=clock) if day and clock else None


@dataclass
class TimeContext:
    """What resolving needs of the data: its range, the zone that is shown, and the clock."""

    first: int | None = None
    last: int | None = None
    zone: str = "UTC"
    now: int | None = None  # anchors last: instead of the newest record
    notes: list[str] = field(default_factory=list)

    @property
    def tz(self) -> ZoneInfo:
        return ZoneInfo(self.zone)


def local(us: int, zone: ZoneInfo) -> datetime:
    return moment(us).replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None)


def instant(naive: datetime, zone: ZoneInfo, late: bool, notes: list[str]) -> int:
    """UTC of a local time. In a gap: when the clock jumped. Twice there: the first, or the last if ``late``."""
    early, after = (micros(naive.replace(tzinfo=zone, fold=f)) for f in (0, 1))
    if early == after:
        return early
    if local(early, zone) != naive:  # it never was
        low, high = min(early, after), max(early, after)
        before = moment(low).replace(tzinfo=timezone.utc).astimezone(zone).utcoffset()
        while high - low > 1:
            mid = (low + high) // 2
            if moment(mid).replace(tzinfo=timezone.utc).astimezone(zone).utcoffset() == before:
                low = mid
            else:
                high = mid
        notes.append(f"{naive:%Y-%m-%d %H:%M} does not exist in {zone.key}: the clock went forward; {instant_text(high)} is used")
        return high
    notes.append(f"{naive:%Y-%m-%d %H:%M} happens twice in {zone.key}; the {'later' if late else 'earlier'} one is used")
    return max(early, after) if late else min(early, after)


def midnight(day: date, zone: ZoneInfo) -> int:
    return instant(datetime.combine(day, time()), zone, False, [])


def _near_day(clock: time, context: TimeContext) -> date:
    """The newest day within the data's range that contains the clock time."""
    zone = context.tz
    if context.last is None:
        at = context.now if context.now is not None else micros(datetime.now(timezone.utc))
        return local(at, zone).date()
    newest = local(context.last, zone).date()
    for back in range(MOST_DAYS_BACK + 1):
        day = newest - back * DAY
        at = instant(datetime.combine(day, clock), zone, False, [])
        if at < (context.first if context.first is not None else at):
            break
        if at <= context.last:
            if back or day != newest:
                context.notes.append(f"{clock:%H:%M} is taken on {day}, the newest day that has it")
            return day
    return newest


def _point(w: Wall, context: TimeContext, end: bool) -> int:
    if w.instant is not None:
        return w.instant
    zone = context.tz
    if w.clock is None:
        return midnight(w.day + DAY if end else w.day, zone)
    day = w.day or _near_day(w.clock, context)
    return instant(datetime.combine(day, w.clock), zone, end, context.notes)


def _between(text: str, context: TimeContext) -> tuple[int, int]:
    for at in (m.start() for m in re.finditer("-", text)):
        left, right = wall(text[:at]), wall(text[at + 1 :])
        if left and right:
            break
    else:
        raise TimeProblem(text, "is not two times joined by a hyphen")
    if right.instant is None and right.day is None and left.day is not None:
        right = replace(right, day=left.day)
    start = _point(left, context, False)
    if right.instant is None and right.day is None:
        right = replace(right, day=local(start, context.tz).date())
    end = _point(right, context, True)
    if end <= start and right.clock is not None:
        context.notes.append(f"{text}: the end is before the start and taken on the next day")
        end = _point(replace(right, day=(right.day or local(start, context.tz).date()) + DAY), context, True)
    if end <= start:
        raise TimeProblem(text, "ends before it starts")
    return start, end


def interval(term: TimeTerm, context: TimeContext) -> tuple[int | None, int | None]:
    """Half-open window of one time term, in microseconds."""
    text = term.expression.strip()
    if term.word == "last":
        seconds = duration_seconds(text)
        if not seconds:
            raise TimeProblem(text, "is not a duration")
        anchor = context.now if context.now is not None else context.last
        if anchor is None:
            anchor = micros(datetime.now(timezone.utc))
        return anchor - round(seconds * 1e6), anchor + 1  # the newest record is inside
    if term.word == "between":
        return _between(text, context)
    found = wall(text)
    if found is None:
        raise TimeProblem(text)
    if term.word == "on":
        if found.day is None or found.clock is not None:
            raise TimeProblem(text, "is not a date")
        return midnight(found.day, context.tz), midnight(found.day + DAY, context.tz)
    if term.word in ("after", "since"):
        return _point(found, context, False), None
    return None, _point(found, context, True)


def _clock_changes(start: int, end: int, context: TimeContext) -> None:
    zone = context.tz
    if end - start > MOST_DAYS_SCANNED * 86400 * 10**6:
        return
    hour, at = 3600 * 10**6, start
    offset = lambda us: moment(us).replace(tzinfo=timezone.utc).astimezone(zone).utcoffset()
    while at < end:
        to = min(at + hour, end)
        if offset(at) != offset(to):
            real, shown = timedelta(microseconds=end - start), local(end, zone) - local(start, zone)
            context.notes.append(f"the clock of {zone.key} changes in this window: {real} of real time look like {shown}")
            return
        at = to


def resolve(query: Query, context: TimeContext) -> Query:
    """``query`` with its time terms replaced by one window (the stats clause stays)."""
    times = [t for t in query.terms if isinstance(t, TimeTerm)]
    if not times:
        return query
    start = end = None
    excluded = []
    for term in times:
        a, b = interval(term, context)
        if term.negated:
            excluded.append((a, b))
            continue
        start = a if start is None else start if a is None else max(start, a)
        end = b if end is None else end if b is None else min(end, b)
    if start is not None and end is not None:
        _clock_changes(start, end, context)
    window = WindowTerm(start, end, tuple(excluded))
    return replace(query, terms=(window, *(t for t in query.terms if not isinstance(t, TimeTerm))))
