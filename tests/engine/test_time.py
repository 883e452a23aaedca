from datetime import datetime

import pytest

from tributary.dsl.syntax import WindowTerm, parse
from tributary.dsl.timeexpr import TimeContext, TimeProblem, micros, resolve, wall


def us(text):
    return micros(datetime.fromisoformat(text))


def window(text, zone="UTC", first="2026-08-12T00:00", last="2026-08-13T14:20", now=None):
    context = TimeContext(us(first), us(last), zone, now)
    out = resolve(parse(text), context)
    term = next(t for t in out.terms if isinstance(t, WindowTerm))
    return term.start, term.end, context.notes, term.excluded


def test_forms():
    assert window("last:90m")[:2] == (us("2026-08-13T12:50"), us("2026-08-13T14:20") + 1)
    assert window("on:2026-08-12")[:2] == (us("2026-08-12"), us("2026-08-13"))
    assert window("before:2026-08-12")[:2] == (None, us("2026-08-13"))
    assert window("since:2pm")[0] == us("2026-08-13T14:00")
    assert window("after:1530")[0] == us("2026-08-12T15:30")  # today has no 15:30 yet
    assert window("22:00-02:00")[:2] == (us("2026-08-12T22:00"), us("2026-08-13T02:00"))
    assert window("after:14:00 before:14:10")[:2] == (us("2026-08-13T14:00"), us("2026-08-13T14:10"))
    assert window('between:"2026-08-13 14:00 - 15:00"')[:2] == (us("2026-08-13T14:00"), us("2026-08-13T15:00"))
    assert window("-last:1h after:2026-08-12")[3] == ((us("2026-08-13T13:20"), us("2026-08-13T14:20") + 1),)
    assert window("last:1h", now=us("2026-09-01"))[1] == us("2026-09-01") + 1


def test_zones():
    assert window("on:2026-08-13", "Europe/Berlin")[:2] == (us("2026-08-12T22:00"), us("2026-08-13T22:00"))
    start, end, *_ = window("on:2026-03-29", "Europe/London", "2026-03-01T00:00", "2026-04-01T00:00")
    assert end - start == 23 * 3600 * 10**6
    gap = window('after:"2026-03-29 01:30"', "Europe/London", "2026-03-01T00:00", "2026-04-01T00:00")
    assert gap[0] == us("2026-03-29T01:00") and "does not exist" in gap[2][0]
    twice = window('between:"2026-10-25 01:30 - 2026-10-25 01:30"', "Europe/London", "2026-10-01T00:00", "2026-11-01T00:00")
    assert twice[:2] == (us("2026-10-25T00:30"), us("2026-10-25T01:30")) and any("happens twice" in n for n in twice[2])
    assert any("the clock of" in n for n in window("last:2d", "Europe/London", "2026-10-01T00:00", "2026-10-26T00:00")[2])


@pytest.mark.parametrize("text", ["14:00", "2026-08-13", "2026/08/13", "20260813", "2026-08-13T14:00", "2026-08-13 14:00:05", "2026-08-13T14:00:00Z", "2026-08-13T14:00:00.5+02:00", "140530", "2pm", "2:15am"])
def test_walls(text):
    assert wall(text) is not None


@pytest.mark.parametrize("text", ["25:00", "2026-13-01", "13pm", "x", "", "14:0"])
def test_no_walls(text):
    assert wall(text) is None


def test_problems():
    for text in ("last:x", "on:noon", "between:x-y", "after:2026-99-01"):
        with pytest.raises(TimeProblem):
            window(text)
