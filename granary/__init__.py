"""granary: integer-record buckets queried with typed expressions on Spark DataFrames."""
