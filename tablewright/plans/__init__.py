"""Chains of operations and their fitted form."""

from tablewright.plans.chain import FittedPlan, apply_operations, validate_specs
from tablewright.plans.standard import standard_chain

__all__ = ["FittedPlan", "apply_operations", "standard_chain", "validate_specs"]
