"""All registered queries of the structure and design tables, by name."""

from .plans import constraint_plans, files, graph_plans, residue_plans, score_plans  # noqa: F401
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
