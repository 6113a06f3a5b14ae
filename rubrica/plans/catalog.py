"""All queries of the engine with their SQL for DuckDB."""

from rubrica.plans.queries import ORACLES, QUERIES, mapping, photos, quota, scoring, state

__all__ = ["ORACLES", "QUERIES", "mapping", "photos", "quota", "scoring", "state"]
