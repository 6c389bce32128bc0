"""Branch-first SQL transformation over snapshot-versioned tables, on Spark."""
