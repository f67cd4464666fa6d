"""Parameters of searches, retention, detection and rules."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

DEFAULT_LIMIT = 100
MAX_LIMIT = 10_000
DEFAULT_RANGE = timedelta(hours=24)

# Named time ranges; an unknown name means the default range.
RELATIVE_RANGES = {
    "1h": timedelta(hours=1),
    "6h": timedelta(hours=6),
    "24h": timedelta(hours=24),
    "7d": timedelta(days=7),
    "30d": timedelta(days=30),
}


def _naive(time: datetime) -> datetime:
    """The time in UTC without a zone, as tables hold it."""
    return time.astimezone(timezone.utc).replace(tzinfo=None) if time.tzinfo else time


@dataclass(frozen=True)
class SearchRequest:
    service: str = ""
    severity: str = ""
    search: str = ""
    start: datetime | None = None
    end: datetime | None = None
    limit: int = 0
    offset: int = 0

    def resolved(self, as_of: datetime) -> SearchRequest:
        """Fill the defaults relative to `as_of` and bound the page size."""
        if self.offset < 0:
            raise ValueError("offset must not be negative")
        end = _naive(self.end or as_of)
        return replace(
            self,
            end=end,
            start=_naive(self.start) if self.start else end - DEFAULT_RANGE,
            limit=min(self.limit, MAX_LIMIT) if self.limit > 0 else DEFAULT_LIMIT,
        )

    @classmethod
    def relative(cls, name: str, as_of: datetime, **filters) -> SearchRequest:
        span = RELATIVE_RANGES.get(name, DEFAULT_RANGE)
        return cls(start=as_of - span, end=as_of, **filters)

    def clamped(self) -> bool:
        """Whether the page is smaller than asked for."""
        return self.limit > MAX_LIMIT

    @property
    def page(self) -> int:
        """Zero-based page number of a resolved request."""
        return self.offset // self.limit


def page_count(total: int, page_size: int) -> int:
    return -(-total // page_size)


@dataclass(frozen=True)
class Retention:
    """Three independent horizons; the archive itself is never expired."""

    route_days: int = 7
    hot_days: int = 30

    def cutoff(self, as_of: datetime) -> datetime:
        return as_of - timedelta(days=self.route_days)


@dataclass(frozen=True)
class DetectionConfig:
    window: timedelta = timedelta(minutes=5)
    min_events: int = 100
    threshold: float = 0.05
    recurring_count: int = 100
    recurring_cooldown: timedelta = timedelta(minutes=15)
    idle_gap: timedelta | None = None
    alert_cooldown: timedelta = timedelta(minutes=15)

    @property
    def fingerprint_gap(self) -> timedelta:
        """Idle time after which a fingerprint is forgotten."""
        return self.idle_gap or 4 * self.window


@dataclass(frozen=True)
class AlertRule:
    id: str
    name: str
    service: str  # empty: every service
    condition: str  # error_rate, event_volume or latency_p99
    threshold: float
    window_minutes: int = 5
    min_events: int = 100
    cooldown_minutes: int = 15
    enabled: bool = True
