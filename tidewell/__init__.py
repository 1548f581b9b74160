"""A lakehouse engine on PySpark: bundle parsing, as-of joins, versioned tables, quality rules, streams."""
