"""Take-off analytics on Spark: drawing sets as relations, answered with DataFrames."""
