"""The usual cleaning order, from a flat set of options."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any


def standard_chain(
    *,
    target: str | None = None,
    dropna: bool = False,
    fillna: str | None = None,
    fillna_value: Any = None,
    drop_columns: Sequence[str] | None = None,
    keep_columns: Sequence[str] | None = None,
    drop_duplicates: bool = False,
    filter: str | None = None,
    scale: str | None = None,
    encode: str | None = None,
    sample: int | None = None,
    head: int | None = None,
    ratio: tuple[str, str, str] | None = None,
    product: tuple[str, str, str] | None = None,
    difference: tuple[str, str, str] | None = None,
    bins: tuple[str, int] | None = None,
    order: Sequence[str] | None = None,
) -> list[dict[str, Any]]:
    """Operation specs in the fixed order: missing values, columns, rows, scaling,
    encoding, sampling, new columns. Scaling leaves the target in its own units.
    """
    if fillna == "constant" and fillna_value is None:
        raise ValueError("fillna='constant' needs fillna_value")
    ordered = {"order": list(order)} if order else {}
    fill = {"method": fillna, "value": fillna_value if fillna == "constant" else None}
    if fillna in ("ffill", "bfill"):
        fill.update(ordered)
    steps = [
        (dropna, "dropna", {}),
        (fillna, "fillna", fill),
        (drop_columns, "drop_columns", {"columns": list(drop_columns or [])}),
        (keep_columns, "keep_columns", {"columns": list(keep_columns or [])}),
        (drop_duplicates, "drop_duplicates", {}),
        (filter, "filter_rows", {"condition": filter}),
        (scale, "scale_numeric", {"method": scale, "exclude": [target] if target else None}),
        (encode, "encode_categorical", {"method": encode}),
        (sample, "sample_rows", {"n": sample, "key": list(order) if order else None}),
        (head, "head_rows", {"n": head, **ordered}),
        (ratio, "create_ratio", dict(zip(("numerator", "denominator", "new_column"), ratio or ()))),
        (product, "create_product", dict(zip(("col1", "col2", "new_column"), product or ()))),
        (difference, "create_difference", dict(zip(("col1", "col2", "new_column"), difference or ()))),
        (bins, "create_bins", dict(zip(("column", "bins"), bins or ()))),
    ]
    return [{"op": name, **params} for wanted, name, params in steps if wanted]
