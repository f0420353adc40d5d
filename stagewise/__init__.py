"""stagewise: iterative, multi-stage analytics as plain Spark DataFrame plans."""
