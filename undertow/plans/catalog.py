"""All registered queries."""

from undertow.plans import (  # noqa: F401  (importing registers)
    catalog_records,
    catalog_aggregates,
    catalog_joins,
    catalog_grid,
    catalog_series,
    catalog_graph,
    catalog_portfolio,
    catalog_tests,
    catalog_models,
    catalog_plans,
)
from undertow.plans.registry import ORACLES, QUERIES  # noqa: F401
