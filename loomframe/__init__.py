"""loomframe: Spark-first analytics over labelled sparse tables."""
