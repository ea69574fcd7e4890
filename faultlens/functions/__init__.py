"""Column-level helpers (built-in Spark expressions only)."""
