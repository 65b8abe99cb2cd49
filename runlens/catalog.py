"""The registered queries over run telemetry, evidence and plans, and their SQL."""

from __future__ import annotations

from runlens.queries import QUERIES, SQL, evidence, review, settings, telemetry

__all__ = ["QUERIES", "SQL", "evidence", "review", "settings", "telemetry"]
