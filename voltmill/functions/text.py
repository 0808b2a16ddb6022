"""Text, label and time columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Presentation labels.
TECHNOLOGY_LABELS = {"solar": "Solar", "wind": "Eólica", "battery": "Batería"}
CAUSE_LABELS = {
    "soiling": "Suciedad progresiva",
    "yaw_misalignment": "Desalineación de yaw",
    "frozen_sensor": "Sensor congelado",
    "underperformance": "Bajo rendimiento",
}
AGE_NEVER = "sin ejecución"
AGE_UNPARSEABLE = "fecha no interpretable"


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL where the key is unknown."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), column)


def technology_label(column: Column) -> Column:
    return F.coalesce(lookup(column, TECHNOLOGY_LABELS), column)


def cause_label(column: Column) -> Column:
    return F.coalesce(lookup(column, CAUSE_LABELS), F.replace(column, F.lit("_"), F.lit(" ")))


def safe_number(column: Column, digits: int = 1) -> Column:
    """Half-even rounding; missing and non-finite values become 0."""
    value = column.cast("double")
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(broken, F.lit(0.0)).otherwise(F.bround(value, digits))


def age_label(timestamp: Column, now: Column) -> Column:
    """Age of an ISO timestamp string in whole hours or days."""
    parsed = F.try_to_timestamp(timestamp)
    seconds = F.greatest(F.unix_seconds(now) - F.unix_seconds(parsed), F.lit(0))
    hours = F.floor(seconds / 3600)
    return (
        F.when(timestamp.isNull(), AGE_NEVER)
        .when(parsed.isNull(), AGE_UNPARSEABLE)
        .when(hours < 1, "<1 h")
        .when(hours < 48, F.concat(hours.cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" d")))
    )


def redact_path(column: Column, root: str) -> Column:
    """Paths below ``root`` become relative, other absolute paths lose their folders."""
    prefix = root.rstrip("/") + "/"
    name = F.regexp_extract(column, r"([^/\\]+)/*$", 1)
    return (
        F.when(column.startswith(prefix), F.substring(column, len(prefix) + 1, 1_000_000))
        .when(column.startswith("/"), F.concat(F.lit("redacted-local-path/"), name))
        .otherwise(column)
    )


def sanitize_url(column: Column, secret_keys: Sequence[str]) -> Column:
    """Drop secret query parameters and the fragment of a URL."""
    secrets = F.array(*[F.lit(k.lower()) for k in secret_keys])
    whole = F.split_part(column, F.lit("#"), F.lit(1))
    base = F.split_part(whole, F.lit("?"), F.lit(1))
    query = F.when(F.contains(whole, F.lit("?")), F.regexp_extract(whole, r"\?(.*)$", 1))
    kept = F.filter(
        F.split(query, "&"),
        lambda part: (part != "")
        & ~F.array_contains(secrets, F.lower(F.split_part(part, F.lit("="), F.lit(1)))),
    )
    return F.when(query.isNull() | (F.size(kept) == 0), base).otherwise(
        F.concat(base, F.lit("?"), F.array_join(kept, "&"))
    )


def to_local(column: Column, tz: str = "Europe/Madrid") -> Column:
    """Local wall-clock time of a UTC timestamp."""
    return F.from_utc_timestamp(column, tz)


def local_label(column: Column, tz: str = "Europe/Madrid", pattern: str = "dd/MM HH:mm") -> Column:
    return F.date_format(to_local(column, tz), pattern)
