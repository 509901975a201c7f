"""The registered queries; importing the package enters them all."""

from weftline.plans import code_plans, custom_plans, edit_plans, event_plans, graph_plans, name_plans, ranking_plans, repo_plans, retrieval_plans, search_plans, shape_plans, source_plans, sqlite_plans, summary_plans, text_plans
from weftline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "code_plans", "custom_plans", "edit_plans", "event_plans", "graph_plans", "name_plans", "ranking_plans", "repo_plans", "retrieval_plans", "search_plans", "shape_plans", "source_plans", "sqlite_plans", "summary_plans", "text_plans"]
