"""Training-corpus analytics on Spark: DataFrame operators, sources, sinks and streaming jobs."""
