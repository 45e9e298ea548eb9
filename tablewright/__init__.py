"""Tabular preparation, profiling and model selection on Spark DataFrames."""

from tablewright.operators import OPERATIONS
from tablewright.plans import FittedPlan, apply_operations, standard_chain
from tablewright.session import build_session
from tablewright.sources import TableSource
from tablewright.workspace import Workspace

__all__ = [
    "OPERATIONS", "FittedPlan", "TableSource", "Workspace", "apply_operations", "build_session", "standard_chain",
]
__version__ = "0.1.0"
