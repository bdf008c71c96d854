"""Status families and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted states
LINK_STATES = ["pending", "parsing", "parsed", "failed"]
EXPORT_STATES = ["pending", "exporting", "done", "failed"]

# fixed values: families used by the inbox
READY_LINK = ["ready", "indexed", "parsed", "done", "completed"]
EXPORTED_LINK = ["exported", "done", "completed"]
ACTIVE_LINK = ["queued", "pending", "parsing", "processing", "syncing"]
ACTIVE_EXPORT = ["queued", "pending", "exporting", "processing", "running"]


def normal_status(status: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("queued")))


def is_ready(status: Column) -> Column:
    return normal_status(status).isin(READY_LINK)


def is_exported(status: Column) -> Column:
    return normal_status(status).isin(EXPORTED_LINK)


def is_active(status: Column) -> Column:
    return normal_status(status).isin(ACTIVE_LINK)


def is_active_export(status: Column) -> Column:
    return normal_status(status).isin(ACTIVE_EXPORT)


def parse_state(status: Column, allowed: list[str]) -> Column:
    """Canonical state, or null where the text names none."""
    return F.when(F.lower(status).isin(allowed), F.lower(status))


def state_error(status: Column, allowed: list[str], kind: str) -> Column:
    return F.when(parse_state(status, allowed).isNull(),
                  F.concat(F.lit(f"Unknown {kind}: "), F.coalesce(F.lower(status), F.lit("null"))))
