"""lumaflow: Spark-first analytics over time-indexed media and text corpora."""
