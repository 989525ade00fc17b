"""All queries of the graph engine."""

from __future__ import annotations

from netquarry.cluster import ship
from netquarry.plans import crawl_queries, graph_queries, source_queries

_PARTS = [graph_queries, crawl_queries, source_queries]


def _shipped(f):
    def run(spark, sf_dir):
        return f(ship(spark), sf_dir)

    return run


QUERIES = {k: _shipped(f) for p in _PARTS for k, f in p.QUERIES.items()}
ORACLES = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
