"""What a user may write for windows, intervals and limits."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


@dataclass(frozen=True)
class Window:
    """A trailing window and the equal one before it."""

    text: str
    length: timedelta

    def opens_at(self, now: datetime) -> datetime:
        return now - self.length

    def comparison_opens_at(self, now: datetime) -> datetime:
        return now - 2 * self.length


def _parse(text: str, units: str) -> timedelta:
    m = re.fullmatch(rf"([0-9]+)([{units}])", text)
    if not m or int(m[1]) == 0:
        raise ValueError(f"{text!r}: expected a whole number above zero and one of {', '.join(units)}")
    return timedelta(**{_UNITS[m[2]]: int(m[1])})


def parse_window(text: str) -> Window:
    """<n>h, <n>d or <n>w."""
    return Window(text, _parse(text, "hdw"))


def parse_refresh(text: str) -> timedelta:
    """<n>s, <n>m or <n>h, a minute at least."""
    out = _parse(text, "smh")
    if out < timedelta(minutes=1):
        raise ValueError(f"{text!r}: a refresh takes a minute at least")
    return out


def parse_dashboard_window(text: str) -> Window:
    """7d, 30d or 90d."""
    if text not in ("7d", "30d", "90d"):
        raise ValueError(f"{text!r}: expected 7d, 30d or 90d")
    return parse_window(text)


def positive(text: str, most: int | None = None) -> int:
    """A whole number from 1, up to `most` where it is given."""
    if not re.fullmatch(r"[0-9]+", text) or int(text) < 1 or (most and int(text) > most):
        raise ValueError(f"{text!r}: expected a whole number from 1" + (f" to {most}" if most else ""))
    return int(text)
