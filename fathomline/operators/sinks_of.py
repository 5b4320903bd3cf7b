"""Exports as steps of a query: written, read back and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..runtime import Scratch
from ..sources import sinks


def round_trip(rows: DataFrame, scratch: Scratch, key: str) -> DataFrame:
    """``rows`` after a trip through a manifest; a ledger with its digest must agree."""
    manifest, ledger = scratch.path("manifest"), scratch.path("ledger")
    sinks.write_manifest(rows, manifest, key)
    again = sinks.read_back(rows.sparkSession, manifest, rows.schema)
    sinks.content_digest(rows).write.json(ledger)
    kept = rows.sparkSession.read.json(ledger).first()
    if sinks.content_digest(again).first().digest != kept.digest:
        raise ValueError("the manifest does not agree with its ledger")
    return again
