"""The queries of the subpackage, gathered."""

from __future__ import annotations

from lociflow.llm import q_clusters, q_language, q_leaks, q_mapping, q_packing, q_vectors
from lociflow.plans.base import Registry

R = Registry()
for _m in (q_vectors, q_clusters, q_mapping, q_packing, q_leaks, q_language):
    R.queries |= _m.R.queries
    R.sql |= _m.R.sql
