"""Commerce analytics as Spark jobs: tables, metrics, features, streams and governance."""
