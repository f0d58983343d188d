"""Function-level program matching as Spark jobs: DataFrames in, DataFrames out."""
