"""The queries run over the test tables, each beside the SQL that gives the same answer."""

from flowtables.workload import flows, history, ingest, streams, xmlflows  # noqa: F401
from flowtables.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
