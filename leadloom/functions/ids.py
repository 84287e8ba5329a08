"""Deterministic identifiers; the hashed text is a JSON list with ', ' between items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import col


def json_string(c: Column | str) -> Column:
    """JSON string literal of a text value; null becomes ``null``."""
    text = F.to_json(F.array(col(c).cast("string")))
    body = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(col(c).isNull(), F.lit("null")).otherwise(body)


def json_number(c: Column | str) -> Column:
    """JSON text of an integer column."""
    return F.coalesce(col(c).cast("bigint").cast("string"), F.lit("null"))


def stable_id(*json_parts: Column) -> Column:
    """SHA-256 over the JSON list of already rendered parts."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *json_parts), F.lit("]")), 256)


def row_id(*parts: Column | str) -> Column:
    """Stable id of text parts."""
    return stable_id(*[json_string(p) for p in parts])


def lead_identity(company: Column | str, reference: Column | str) -> Column:
    """Tenant-scoped lead id: ``LC-`` and the first 20 hex digits."""
    return F.concat(F.lit("LC-"), F.substring(row_id(company, reference), 1, 20))
