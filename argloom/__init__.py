"""A Spark-first engine for text-derived knowledge and argument graphs."""
