"""lumenframe: a Spark-first engine for visual-data, vector and text analytics."""
