"""JSON fields, instants and stage progress."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from acervo.functions.text import trimmed

# --- fixed values -----------------------------------------------------------
STAGE_PROGRESS = {
    "extracting": 15,
    "chunking": 35,
    "embedding": 55,
    "storing": 85,
    "finalizing": 95,
    "completed": 100,
}
# ----------------------------------------------------------------------------

_FENCE = r"(?is)\A```(?:json)?\s*(.*?)\s*```\z"


def model_json_text(col: Column) -> Column:
    """The JSON body of a model reply, without one surrounding code fence."""
    body = trimmed(col)
    return F.when(body.rlike(_FENCE), F.regexp_extract(body, _FENCE, 1)).otherwise(body)


def parse_model_json(col: Column) -> Column:
    """The reply as a typed value; null when the body is not JSON."""
    return F.try_parse_json(model_json_text(col))


def is_string_array(value: Column) -> Column:
    """True when a typed value is an array holding strings only."""
    items = F.try_variant_get(value, "$", "array<string>")
    return F.coalesce(
        F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
        & ~F.exists(items, lambda x: x.isNull()),
        F.lit(False),
    )


def chunk_ids_from_json(col: Column) -> Column:
    """Array of strings held as JSON text; null unless every item is a string."""
    value = F.try_parse_json(col)
    return F.when(is_string_array(value), F.try_variant_get(value, "$", "array<string>"))


def progress_for(stage: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(STAGE_PROGRESS.items())])
    return F.coalesce(F.try_element_at(table, stage), F.lit(0))


def expires_at(ts: Column, ttl_hours: Column | int) -> Column:
    hours = F.lit(ttl_hours) if isinstance(ttl_hours, int) else ttl_hours
    return ts + F.make_dt_interval(F.lit(0), hours)


def is_expired(expiry: Column, as_of: Column) -> Column:
    """An entry that expires at this very instant has expired."""
    return expiry <= as_of


def parse_iso_instant(col: Column) -> Column:
    """Instant of an ISO-8601 text, null when it is not a valid date."""
    return F.try_to_timestamp(col)
