"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from marlstone.plans import registry
from marlstone.plans import chunks, evaluation, graphs, histories, lifecycle, policies, relational, reports, retrieval, rules, service, streams  # noqa: F401  (registration)

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
