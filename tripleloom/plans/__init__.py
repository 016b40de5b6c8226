"""From a mapping declaration to the expressions Spark runs for it."""

from .mapping import MappingPlan, TripleRule, expand, plan_mapping, template_key

__all__ = ["MappingPlan", "TripleRule", "expand", "plan_mapping", "template_key"]
