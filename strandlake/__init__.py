"""strandlake: evidence-driven gene-set analytics on PySpark DataFrames."""
