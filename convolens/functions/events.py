"""Domain name -> event type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from . import fixed
from .text import strip


def sanitize_event(label: Column) -> Column:
    """Known event labels pass, all others become the general one."""
    cleaned = strip(F.lower(label))
    known = [name for name, _ in fixed.EVENT_BUCKETS]
    return F.when(cleaned.isin(known), cleaned).otherwise(fixed.GENERAL_EVENT)


def event_of_domain(domain: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Event type of a domain.

    An exact override wins; then the first bucket, in bucket order, one of whose stems occurs.
    Overrides are a small driver-side mapping and become a literal in the plan; for a large
    override table use ``operators.events.with_event_overrides``.
    """
    name = strip(F.lower(domain))
    chain = F.when(F.coalesce(domain, F.lit("")) == "", fixed.GENERAL_EVENT)
    if overrides:
        pairs = [F.lit(part) for k, v in overrides.items() for part in (k.lower(), v.lower())]
        table = F.create_map(*pairs)
        chain = chain.when(F.map_contains_key(table, name), sanitize_event(F.element_at(table, name)))
    for event, stems in fixed.EVENT_BUCKETS:
        chain = chain.when(name.rlike("|".join(stems)), event)
    return chain.otherwise(fixed.GENERAL_EVENT)
