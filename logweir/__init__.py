"""Service log events on PySpark: ingest, search, rollups and detection."""

from logweir.session import configure, workspace

__all__ = ["configure", "workspace"]
