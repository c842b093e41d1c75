"""Raw log lines that Spark derives from the given tables, for queries and tests."""
