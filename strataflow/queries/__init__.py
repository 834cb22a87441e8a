"""All queries of the engine, with their SQL."""

from strataflow.queries import graphs, knowledge, records, relational, retrieval, temporal
from strataflow.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graphs", "knowledge", "records", "relational", "retrieval", "temporal"]
