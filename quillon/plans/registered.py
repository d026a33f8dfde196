"""All registered queries: importing this module registers them."""

from quillon.plans import flow_queries, mart_queries, queries, scalar_queries, state_queries  # noqa: F401
from quillon.plans.registry import ORACLE, QUERIES  # noqa: F401
