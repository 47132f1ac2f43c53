"""spanloom: a Spark-first engine for source-tree retrieval and corpus processing."""
