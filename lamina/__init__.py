"""A Spark-first engine for layered documents, their history and their search."""
