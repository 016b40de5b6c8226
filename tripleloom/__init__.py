"""Semantic mapping and triple analytics on Spark."""

from .model import Mapper, MappingSpec, schemes_frame, specs_frame
from .plans import MappingPlan, plan_mapping
from .session import build_session
from .workspace import Workspace

__all__ = [
    "Mapper",
    "MappingPlan",
    "MappingSpec",
    "Workspace",
    "build_session",
    "plan_mapping",
    "schemes_frame",
    "specs_frame",
]
