"""Every query of the library with its SQL twin."""

from __future__ import annotations

from trajgraph.plans import queries_compare, queries_graphs, queries_labels, queries_polylines

QUERIES, ORACLES = {}, {}
for _module in (queries_labels, queries_polylines, queries_compare, queries_graphs):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.SQL
