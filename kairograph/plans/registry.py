"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import codes, files, forecasts, graphs, layers, samples, scoring, streams, temporal, texts  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
