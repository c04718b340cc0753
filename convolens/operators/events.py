"""Event types with a large override table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.events import event_of_domain, sanitize_event
from ..functions.text import strip


def with_event_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add ``event_type``; an override (``domain``, ``event``) wins over the stems.

    Overrides are cut to one row per name. The join carries no hint: Spark broadcasts the table
    only under its own size threshold. Rows without a domain skip the join's hot key.
    """
    table = overrides.groupBy(F.lower("domain").alias("_name")).agg(F.max("event").alias("_event"))
    has_domain = F.coalesce("domain", F.lit("")) != ""
    named = rows.where(has_domain).withColumn("_name", strip(F.lower("domain")))
    event = F.coalesce(
        F.when(F.col("_event").isNotNull(), sanitize_event(F.col("_event"))),
        event_of_domain(F.col("domain")),
    )
    joined = named.join(table, "_name", "left").withColumn("event_type", event)
    rest = rows.where(~has_domain).withColumn("event_type", event_of_domain(F.col("domain")))
    return joined.select(*rows.columns, "event_type").unionByName(rest)
