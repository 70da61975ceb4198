"""The registered queries and their SQL."""

from __future__ import annotations

from scanloom.plans import analysis_queries, calibration_queries, catalog_queries, detector_queries, language_queries, pointing_queries, sample_queries, signal_queries, split_queries, stream_queries

MODULES = (catalog_queries, sample_queries, calibration_queries, split_queries, detector_queries, language_queries, stream_queries, pointing_queries, analysis_queries, signal_queries)


def united(parts: list[dict]) -> dict:
    """One dictionary of several; a name that two of them have is an error, as one query would hide the other."""
    out: dict = {}
    for part in parts:
        if twice := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


QUERIES = united([m.QUERIES for m in MODULES])
ORACLE_SQL = united([m.ORACLE_SQL for m in MODULES])
