"""Date-window resolution of the analytic reads (driver-side arguments)."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta


def _as_date(value: str | date | None) -> date | None:
    if value is None or value == "":
        return None
    if isinstance(value, date):
        return value
    return date.fromisoformat(value)


def resolve_window(from_date: str | date | None = None, to_date: str | date | None = None,
                   *, default_days: int = 12, today: date | None = None) -> tuple[date, date]:
    """end = to_date or today (UTC); start = from_date or end - (days - 1).

    A reversed window is returned as given; the reads then select nothing.
    """
    today = today or datetime.now(UTC).date()
    end = _as_date(to_date) or today
    start = _as_date(from_date) or end - timedelta(days=max(default_days - 1, 0))
    return start, end


def range_label(start: date, end: date) -> str:
    return f"{start.isoformat()} to {end.isoformat()}"


def validate_range(start_date: str, end_date: str) -> tuple[date, date]:
    """Backfill arguments: both ISO dates and end >= start, else ValueError."""
    try:
        start = date.fromisoformat(start_date)
        end = date.fromisoformat(end_date)
    except (TypeError, ValueError) as exc:
        raise ValueError("Dates must use YYYY-MM-DD format.") from exc
    if end < start:
        raise ValueError("end_date must be on or after start_date.")
    return start, end
