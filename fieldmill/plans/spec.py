"""Search specifications: what a catalogue query asks for, apart from how it runs."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class NullPolicy(Enum):
    """LEGACY: an unknown price fails a price filter. CANONICAL: an unknown or zero price passes it. Unknown bedrooms fail and an unknown lease passes under both."""

    LEGACY = "legacy"
    CANONICAL = "canonical"


@dataclass(frozen=True)
class SearchSpec:
    """An absent option adds no clause. Prices are in cents."""

    policy: NullPolicy = NullPolicy.CANONICAL
    min_price: int | None = None
    max_price: int | None = None
    bedrooms: tuple[int, ...] = ()
    max_lease: int | None = None
    locations: tuple[str, ...] = ()
    text: str | None = None
    categories: tuple[str, ...] = ()
    bounds: tuple[float, float, float, float] | None = None
    overscan: float = 0.2
    sort: str = "newest"
    limit: int = 20
    offset: int = 0
    columns: dict = field(default_factory=dict)

    def column(self, name: str) -> str:
        return self.columns.get(name, name)


def from_criteria(criteria: dict, names=lambda locations: locations, **options) -> SearchSpec:
    """A specification from what a user or a model asks for: dollars become cents, areas all the names that they stand for (names), each once."""
    cents = {k: round(criteria[k] * 100) for k in ("min_price", "max_price") if criteria.get(k) is not None}
    given = {k: tuple(criteria[k]) for k in ("bedrooms", "categories") if criteria.get(k)}
    locations = tuple(dict.fromkeys(names(criteria.get("locations") or [])))
    return SearchSpec(**cents, **given, locations=locations, text=criteria.get("text") or None, **options)
