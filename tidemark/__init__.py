"""Change analytics on Spark: leak-free datasets, scores and reports from tables of changes."""
