"""delimir: exact delimited-text scanning, filtering and projection on Spark."""

from .plans.errors import DelimitedError
from .plans.options import ColumnarOptions, CountOptions, Options, RowsOptions, RowViewOptions

__all__ = ["ColumnarOptions", "CountOptions", "DelimitedError", "Options", "RowViewOptions", "RowsOptions"]
