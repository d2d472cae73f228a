"""Graph-shaped, conflict-merged data and training-data pipelines on Spark DataFrames."""
