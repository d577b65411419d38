"""assayer: audit and repair of tabular data, expressed as Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame.  Nothing depends
on physical row order and nothing caps rows: where the meaning needs an order,
the caller names key columns.
"""

__version__ = "0.1.0"
