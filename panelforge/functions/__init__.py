from .scalars import (
    correlation, drop_null_rows, known, log_growth, nan_to_zero, null_to_zero, percent_to_fraction, present, ratio, row_total,
)

__all__ = [
    "correlation", "drop_null_rows", "known", "log_growth", "nan_to_zero", "null_to_zero", "percent_to_fraction", "present",
    "ratio", "row_total",
]
