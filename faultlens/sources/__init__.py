"""Sources: schemas, readers for the raw telemetry layout, and the views the
tests and bench build from the driver tables."""
