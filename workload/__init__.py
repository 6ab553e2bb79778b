"""The checked queries: inputs, Spark side and SQL side."""
