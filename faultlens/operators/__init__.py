"""DataFrame -> DataFrame operators, keyed by incident ``uuid``."""
