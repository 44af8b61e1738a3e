"""Registered queries and the SQL that must agree with them."""

from . import block_queries, chain_queries, metrics_queries, people_queries, state_queries, stream_queries

QUERIES: dict = {}
ORACLES: dict = {}
for part in (metrics_queries, people_queries, state_queries, block_queries, chain_queries, stream_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
