"""Cleaning, transforming and feature operations."""

from tablewright.operators.base import OPERATIONS, Operation, make_operation
from tablewright.operators.columns import (
    ConvertDtype, DropColumns, FilterRows, KeepColumns, RenameColumns, coerce_numeric,
)
from tablewright.operators.derive import CreateBins, CreateDifference, CreateProduct, CreateRatio
from tablewright.operators.encoding import EncodeCategorical
from tablewright.operators.missing import DropNa, FillNa
from tablewright.operators.rows import DropDuplicates, HeadRows, SampleRows
from tablewright.operators.scaling import ScaleNumeric

__all__ = [
    "OPERATIONS", "Operation", "make_operation", "ConvertDtype", "CreateBins", "CreateDifference",
    "CreateProduct", "CreateRatio", "DropColumns", "DropDuplicates", "DropNa", "EncodeCategorical",
    "FillNa", "FilterRows", "HeadRows", "KeepColumns", "RenameColumns", "SampleRows", "ScaleNumeric",
    "coerce_numeric",
]
