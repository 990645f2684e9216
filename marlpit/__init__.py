"""Feature, monitoring, governance and training-data operators over Spark DataFrames."""
