"""ligature: shared-attribute linkage and cluster analytics on Spark DataFrames."""
