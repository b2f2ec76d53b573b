"""A code-lineage graph engine on Spark DataFrames."""
