"""Reads size and date literals into inclusive integer bounds.

Dates are read against an injected moment and time zone, so that a plan does not depend on the clock.
"""

from __future__ import annotations

import re
from calendar import isleap, monthrange
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta, tzinfo

LOW, HIGH = -(1 << 63), (1 << 63) - 1
DAY = 86_400
#: Units and named sizes (bounds in bytes, inclusive).
UNITS = {"": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
SIZES = {
    "empty": (0, 0), "tiny": (1, 10 << 10), "small": ((10 << 10) + 1, 100 << 10), "medium": ((100 << 10) + 1, 1 << 20), "large": ((1 << 20) + 1, 16 << 20),
    "huge": ((16 << 20) + 1, 128 << 20), "gigantic": ((128 << 20) + 1, HIGH), "unknown": (0, 0),
}
SPANS = (("day", DAY), ("hour", 3600), ("week", 7 * DAY), ("month", 30 * DAY), ("year", 365 * DAY), ("min", 60), ("sec", 1))
SHORT_SPANS = {"d": DAY, "h": 3600, "w": 7 * DAY, "m": 60, "s": 1}
FILETIME_EPOCH, FILETIME_LEAST = 11_644_473_600, 116_444_736_000_000_000

_SIZE = re.compile(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z]*)\s*")
_ISO = re.compile(r"(\d{1,4})-(\d{1,2})(?:-(\d{1,2})(?:T(\d{1,2})(?::(\d{1,2})(?::(\d{1,2}))?)?)?)?")


@dataclass(frozen=True)
class Bounds:
    """lo <= x <= hi, or its complement."""

    lo: int
    hi: int
    outside: bool = False


def compare(lo: int, hi: int, cmp: str) -> Bounds:
    """The values that stand in a relation to the period lo..hi."""
    return {
        "=": Bounds(lo, hi), "!=": Bounds(lo, hi, True), "<": Bounds(LOW, lo - 1), "<=": Bounds(LOW, hi),
        ">": Bounds(hi + 1, HIGH), ">=": Bounds(lo, HIGH),
    }[cmp]


def size_value(text: str) -> tuple[int, int] | None:
    """The bounds in bytes that a size names."""
    if text.strip().lower() in SIZES:
        return SIZES[text.strip().lower()]
    m = _SIZE.fullmatch(text)
    if not m or m[2].lower() not in UNITS:
        return None
    n = int(float(m[1]) * UNITS[m[2].lower()])
    return n, n


def size_bounds(text: str, cmp: str = "=") -> Bounds | None:
    return _bounds(text, cmp, size_value, dash=True)


def _bounds(text: str, cmp: str, read, dash: bool) -> Bounds | None:
    first, mark, last = text.partition("..")
    if not mark and dash and "-" in text[1:] and not read(text):
        cut = text.index("-", 1)
        first, mark, last = text[:cut], "-", text[cut + 1 :]
    if mark:
        a, b = read(first), read(last)
        return Bounds(a[0], b[1]) if a and b else None
    got = read(text)
    return compare(*got, cmp) if got else None


class Dates:
    """Date literals seen from a moment (epoch seconds) in a time zone."""

    def __init__(self, now: int, zone: tzinfo = UTC):
        self.now, self.zone = now, zone

    def _epoch(self, y: int, mo: int = 1, d: int = 1, h: int = 0, mi: int = 0, s: int = 0) -> int:
        return int(datetime(y, mo, d, h, mi, s, tzinfo=self.zone).timestamp())

    def _period(self, at: int, span: int) -> tuple[int, int]:
        return at, at + span - 1

    def _named(self, text: str) -> tuple[int, int] | None:
        today = datetime.fromtimestamp(self.now, self.zone).replace(hour=0, minute=0, second=0, microsecond=0)
        days = {"today": 0, "yesterday": -1, "tomorrow": 1}
        if text in days:
            return self._period(int((today + timedelta(days=days[text])).timestamp()), DAY)
        if text in ("mtd", "thismonth"):
            return self._period(self._epoch(today.year, today.month), 31 * DAY)
        if text == "lastmonth":
            before = today.replace(day=1) - timedelta(days=1)
            return self._period(self._epoch(before.year, before.month), 31 * DAY)
        if text in ("ytd", "thisyear"):
            return self._period(self._epoch(today.year), 366 * DAY)
        return None

    def value(self, text: str) -> tuple[int, int] | None:
        """The period, or the moment as a period of one second, that a literal names; None if it names none."""
        text = text.strip()
        if found := self._named(text.lower()):
            return found
        if m := re.fullmatch(r"([+-]?\d+)\s*([A-Za-z]+)", text):
            unit = SHORT_SPANS.get(m[2].lower()) or next((n for name, n in SPANS if m[2].lower().startswith(name)), None)
            return (self.now - int(m[1]) * unit,) * 2 if unit else None
        try:
            return self._calendar(text)
        except (ValueError, OverflowError):
            return None

    def _calendar(self, text: str) -> tuple[int, int] | None:
        if m := _ISO.fullmatch(text):
            parts = [int(x) for x in m.groups() if x is not None]
            if len(parts) == 2:
                return self._period(self._epoch(*parts), monthrange(*parts)[1] * DAY)
            at = self._epoch(*parts)
            return at, at
        if m := re.fullmatch(r"(\d{4})/(\d{1,2})", text):
            y, mo = int(m[1]), int(m[2])
            return self._period(self._epoch(y, mo), (29 if mo == 2 and isleap(y) else 31) * DAY)
        if re.fullmatch(r"\d{8}", text) and 1000 <= int(text[:4]):
            at = self._epoch(int(text[:4]), int(text[4:6]), int(text[6:]))
            return at, at
        if not re.fullmatch(r"[+-]?\d+", text):
            return None
        n = int(text)
        if n >= FILETIME_LEAST:
            n = n // 10_000_000 - FILETIME_EPOCH
        elif len(text) == 4 and n >= 1970:
            return self._period(self._epoch(n), (366 if isleap(n) else 365) * DAY)
        return (n, n) if n else None  # the epoch's own second stands for no date

    def bounds(self, text: str, cmp: str = "=") -> Bounds | None:
        return _bounds(text, cmp, self.value, dash=False)
