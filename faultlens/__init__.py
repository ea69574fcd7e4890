"""faultlens: Spark-native incident evidence engine.

Every operator is a ``DataFrame -> DataFrame`` function keyed by incident
(``uuid``), so one incident and many thousands run through the same plan.
"""

__version__ = "0.1.0"
