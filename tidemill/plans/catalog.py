"""Imports every module that registers core queries."""

from tidemill.plans import engine_queries, ensemble_queries, metric_queries, panel_queries, problems, relational_queries, research_queries, stat_queries, validation_queries, window_queries  # noqa: F401
from tidemill.plans.registry import CORE  # noqa: F401
