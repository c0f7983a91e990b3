"""All registered queries."""
from barflow.plans import (  # noqa: F401
    chart_queries, indicator_queries, live_queries, model_queries, outcome_queries, rule_queries, scan_queries, table_queries)
from barflow.plans.registry import ORACLES, QUERIES  # noqa: F401
