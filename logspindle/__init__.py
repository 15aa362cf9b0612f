"""logspindle: Spark-first transforms for security and infrastructure logs."""
