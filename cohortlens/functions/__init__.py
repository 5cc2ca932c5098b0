"""Column expressions shared by the jobs (all built-in, codegen-friendly)."""

from cohortlens.functions.dates import age_months, days_between, month_of, month_spine
from cohortlens.functions.rates import (
    pct, ratio, round_div, round_float_as_numeric, to_double,
)

__all__ = ["age_months", "days_between", "month_of", "month_spine", "pct", "ratio", "round_div",
           "round_float_as_numeric", "to_double"]
