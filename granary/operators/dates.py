"""Which day a run is for: a scheduled run takes it from its interval, a manual one has to state it."""

from __future__ import annotations

from datetime import date, datetime, timedelta


def _midnight(moment: datetime | None, what: str) -> date:
    if moment is None or moment.time() != datetime.min.time():
        raise ValueError(f"{what} has to be at midnight")
    return moment.date()


def _stated(asked: str | None, own: date | None, what: str) -> date:
    """What was asked for, or the schedule's own; a schedule can't be told another."""
    if own is None and asked is None:
        raise ValueError(f"a manual run has to state its {what}")
    if own is not None and asked is not None and date.fromisoformat(asked) != own:
        raise ValueError(f"{what} {asked} isn't that of the interval")
    return own or date.fromisoformat(asked)


def business_date(asked: str | None = None, start: datetime | None = None, end: datetime | None = None, manual: bool = False) -> str:
    """The day of a daily run: the whole day that its interval covers."""
    own = None
    if not manual:
        own = _midnight(start, "the start of the interval")
        if _midnight(end, "the end of the interval") - own != timedelta(1):
            raise ValueError("the interval has to be one day")
    return _stated(asked, own, "business date").isoformat()


def training_cutoff(asked: str | None = None, start: datetime | None = None, end: datetime | None = None, manual: bool = False, effective_from: str | None = None) -> tuple[str, str]:
    """(cutoff, first day in force) of a monthly training: the end of its calendar month, in force from the next day unless told."""
    own = None
    if not manual:
        first, own = _midnight(start, "the start of the interval"), _midnight(end, "the end of the interval")
        if first.day != 1 or (first + timedelta(31)).replace(day=1) != own:
            raise ValueError("the interval has to be a calendar month")
    cutoff = _stated(asked, own, "cutoff")
    return cutoff.isoformat(), date.fromisoformat(effective_from).isoformat() if effective_from else (cutoff + timedelta(1)).isoformat()
