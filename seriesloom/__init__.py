"""seriesloom: keyed, ordered event series as Spark DataFrames."""
