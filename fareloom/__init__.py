"""fareloom: analytics for a two-sided ride marketplace, written on the Spark DataFrame API.

Every operator takes DataFrames and returns a DataFrame, which can be written to a table, joined
further or streamed from. Some write intermediate tables to the shared folder when they are called.
"""

from fareloom.sources.marketplace import Marketplace

__all__ = ["Marketplace"]
