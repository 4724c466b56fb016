"""Record matching, data validation and dependency planning over Spark DataFrames."""
