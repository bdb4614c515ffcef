"""docmill: document analytics, retrieval and corpus operators on PySpark."""
