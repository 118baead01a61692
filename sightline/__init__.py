"""Observation-graph analytics expressed as Spark DataFrame jobs."""

from sightline.session import build_session, stage_table

__all__ = ["build_session", "stage_table"]
