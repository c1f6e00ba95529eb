"""An analytics engine for tabular datasets, declared on Spark DataFrames."""
