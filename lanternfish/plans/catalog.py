"""Imports every plan module and exposes the complete registry."""

from __future__ import annotations

from . import forecast, ingest, pages, quality, reports, scalars, storage  # noqa: F401
from .registry import QUERIES, SQL_TWINS

__all__ = ["QUERIES", "SQL_TWINS"]
